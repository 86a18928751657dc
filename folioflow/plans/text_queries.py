"""Queries over documents, conversations and benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, joins, terms
from ..sources.tables import lines, table


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated_lines(table(spark, sf_dir, "documents"))


def dup_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.primaries(docs, "text", "doc_id").select("doc_id", F.col("primary").alias("primary_id"))


def dominant_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dominant_value(table(spark, sf_dir, "documents"), "lang", F.col("n_chars"), "source")


def term_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_tokens(table(spark, sf_dir, "documents"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.identifiers("text").alias("x"))
    return docs.filter(F.size("x") > 0).select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", " ").alias("identifiers"))


def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = lines(table(spark, sf_dir, "documents"))
    shapes = {"n_headings": T.is_heading("line"), "n_markers": T.is_list_marker("line"), "n_terminal": T.has_terminal_boundary("line"), "n_ends": T.ends_sentence("line"), "n_tiny": T.is_tiny_label("line")}
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), *(F.count_if(x).alias(k) for k, x in shapes.items()))


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.is_skip_page("text").alias("is_skip"), T.is_disclaimer("text").alias("is_disclaimer"))


def next_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.continued_lines(lines(table(spark, sf_dir, "documents")))


def merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.merged_islands(joins.continued_lines(lines(table(spark, sf_dir, "documents"))))


def ngram_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _cached(docs: DataFrame) -> DataFrame:
    """The English documents as if they had been translated before."""
    return docs.filter("lang = 'en'").select(F.sha2("text", 256).alias("identity"), F.concat(F.lit("t"), "doc_id").alias("translation"))


def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return joins.reuse(docs.select("doc_id", F.sha2("text", 256).alias("identity")), _cached(docs)).select("doc_id", "translation")


def cache_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return joins.missing(docs.select("doc_id", F.sha2("text", 256).alias("identity")), _cached(docs), "identity").select("doc_id")


def request_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a request: system text apart, the other turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    system, rest = F.filter("turns", lambda t: t["role"] == "system"), F.filter("turns", lambda t: t["role"] != "system")
    return each.select(
        "conv_id", F.array_join(F.transform(system, lambda t: t["text"]), "\n\n").alias("system"), F.array_join(F.transform(rest, lambda t: t["role"]), ",").alias("roles"),
        F.size(rest).cast("long").alias("n_messages"), F.greatest(F.lit(256), F.least(F.lit(8192), 2 * F.length(F.array_join(F.transform(rest, lambda t: t["text"]), "")))).cast("long").alias("max_tokens"),
    )


def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return joins.audit(docs.select("doc_id"), labels.select("doc_id"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        repeated_lines, dup_primary, dominant_lang, term_topk, identifiers, line_shapes, page_flags, next_lines, merge_islands,
        ngram_containment, cache_reuse, cache_missing, request_shape, label_audit,
    )
}

_LIGHT = r"(?is)<\s*/?\s*(?:b|strong|i|em|sup|sub|span|a)\b[^>]*>"


def _collapsed(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '{_LIGHT}', '', 'g'), '\s+', ' ', 'g'))"


_LINES = r"""
    lines as (
        select doc_id, source, i - 1 as line_no, parts[i] as line
        from (select doc_id, source, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, source, string_split(text, chr(10)) as parts from documents))
        where trim(parts[i]) <> ''
    )
"""
_PAIRS = rf"""
    {_LINES}, l as (
        select doc_id, line_no, line, lead(line_no) over w as next_no, lead(line) over w as next_line from lines window w as (partition by doc_id order by line_no)
    ), p as (
        select doc_id, line_no, next_no, {_collapsed('line')} as t, regexp_extract(next_line, '\p{{L}}') as c from l where next_no is not null
    ), q as (
        select doc_id, line_no, next_no, not (t = '' or (regexp_matches(t, '\p{{P}}$') and not regexp_matches(t, '[,，、]$'))) as dangling,
            c <> '' and lower(c) = c and upper(c) <> c as lower_start from p
    ), pairs as (select * from q where dangling or lower_start)
"""

ORACLES = {
    "repeated_lines": r"""
        with l as (select source, doc_id, trim(regexp_replace(x, '[ \t\r]+', ' ', 'g')) as line
                   from (select source, doc_id, unnest(string_split(text, chr(10))) as x from documents))
        select source, line, count(distinct doc_id) as n_docs, count(*) as n_lines from l
        where length(line) between 4 and 120 group by 1, 2 having count(distinct doc_id) >= 3
    """,
    "dup_primary": "select doc_id, min(doc_id) over (partition by text) as primary_id from documents",
    "dominant_lang": """
        with s as (select source, lang, sum(greatest(n_chars::double, 0.1)) as weight from documents where lang is not null group by 1, 2)
        select source, lang, weight from s qualify row_number() over (partition by source order by weight desc, lang desc) = 1
    """,
    "term_topk": r"""
        with w as (select doc_id, regexp_replace(unnest(string_split_regex(text, '[\x20\x09-\x0D]+')), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') as term from documents)
        select term, count(*) as n, count(distinct doc_id) as n_docs, min(doc_id) as first_doc from w
        where regexp_full_match(term, '[A-Z][A-Z0-9&.-]{1,15}|[A-Z][A-Za-z]{2,}') group by 1 order by n desc, term limit 500
    """,
    "identifiers": rf"""
        with x as (select doc_id, list_sort(regexp_extract_all({_collapsed('text')}, '(?i)(?:https?://|www\.)[^\s<>"'']+|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}|\b10\.\d{{4,9}}/[^\s<>"'']+')) as x from documents)
        select doc_id, len(x) as n, array_to_string(x, ' ') as identifiers from x where len(x) > 0
    """,
    "line_shapes": rf"""
        with {_LINES}, c as (
            select doc_id, line, {_collapsed('line')} as t, trim(regexp_replace(line, '\s+', ' ', 'g')) as m, trim(line) as h from lines
        ), f as (
            select doc_id,
                length(h) between 1 and 130 and len(regexp_extract_all(h, '\p{{L}}')) >= 4 and 5 * len(regexp_extract_all(h, '\p{{Lu}}')) >= 4 * len(regexp_extract_all(h, '\p{{L}}')) as heading,
                length(m) between 1 and 12 and regexp_full_match(m, '[•▪●◦⁃∙\-*·]+|\(?\d{{1,3}}[.)]\)?|\(?[A-Za-z][.)]\)?|\(?[ivxlcdmIVXLCDM]{{1,8}}[.)]\)?') as marker,
                regexp_matches(t, '[.!?。！？]["''’”）)\]]*$') as terminal,
                regexp_matches(line, '\p{{P}}\s*$') and not regexp_matches(line, '[,，、]\s*$') as ends,
                len(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9''/-]*')) as n_words, length(t) as n
            from c
        )
        select doc_id, count(*) as n_lines, count_if(heading)::bigint as n_headings, count_if(marker)::bigint as n_markers, count_if(terminal)::bigint as n_terminal, count_if(ends)::bigint as n_ends,
            count_if(n_words > 0 and ((n_words <= 1 and n <= 12) or (n_words <= 2 and n <= 18)))::bigint as n_tiny
        from f group by 1
    """,
    "page_flags": rf"""
        with d as (select doc_id, text, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x)), lambda x: x <> '') as l from documents)
        select doc_id,
            len(l) <= 10 and len(list_filter(l[1:3], lambda x: length(x) <= 80 and regexp_matches(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[ \t\-–—:;]+|[ \t\-–—:;]+$', '', 'g'),
                '(?i)^(?:section\s+)?(?:\d+(?:\.\d+)*[.):]?\s*)?(?:bibliography|references|index|endnotes?|glossary|acronyms|abbreviations)(?:\s*(?:&|and)\s*(?:further\s+reading|notes|references))?$'))) > 0 as is_skip,
            regexp_matches(text, '(?im)^(\s*\*?\s*(disclaimer|copyright|all rights reserved|legal notice|terms of use|this (document|report|paper|publication) (is|was|has been)|the views expressed|the opinions expressed|for informational purposes only|not intended as|source:|sources?:|\[\d+\]|footnote|endnote))')
                or regexp_matches(text, '(?m)^\s*©') as is_disclaimer
        from d
    """,
    "next_lines": f"with {_PAIRS} select doc_id, line_no, next_no, dangling, lower_start from pairs",
    "merge_islands": f"""
        with {_PAIRS}, o as (
            select doc_id, line_no, next_no, case when lag(next_no) over (partition by doc_id order by line_no) = line_no then 0 else 1 end as opens from pairs
        ), n as (select doc_id, line_no, next_no, sum(opens) over (partition by doc_id order by line_no) as island from o)
        select doc_id, min(line_no) as first_no, max(next_no) as last_no, count(*) + 1 as n_lines from n group by doc_id, island
    """,
    "ngram_containment": r"""
        with w as (
            select 0 as side, doc_id as id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents
            union all select 1, item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') from benchmark
        ), g as (select distinct side, id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as gram from w where len(w) >= 8)
        select d.id as doc_id, b.id as item_id, count(*) as n_shared from g d join g b on d.gram = b.gram and d.side = 0 and b.side = 1 group by 1, 2
    """,
    "cache_reuse": """
        with c as (select sha256(text) as identity, min('t' || doc_id) as translation from documents where lang = 'en' group by 1 having count(*) = 1)
        select doc_id, translation from documents left join c on sha256(text) = identity
    """,
    "cache_missing": "select doc_id from documents where sha256(text) not in (select sha256(text) from documents where lang = 'en')",
    "request_shape": """
        select conv_id, coalesce(string_agg(text, chr(10) || chr(10) order by turn) filter (where role = 'system'), '') as system,
            coalesce(string_agg(role, ',' order by turn) filter (where role <> 'system'), '') as roles, count(*) filter (where role <> 'system') as n_messages,
            greatest(256, least(8192, 2 * coalesce(sum(length(text)) filter (where role <> 'system'), 0)))::bigint as max_tokens
        from conversations group by 1
    """,
    "label_audit": """
        with e as (select doc_id, count(*) as n from documents group by 1), o as (select doc_id, count(*) as n from labels group by 1)
        select coalesce(e.doc_id, o.doc_id) as doc_id, coalesce(e.n, 0) as n_expected, coalesce(o.n, 0) as n_observed,
            case when coalesce(e.n, 0) = coalesce(o.n, 0) then 'ok' when o.n is null then 'lost' when e.n is null then 'added' else 'changed' end as verdict
        from e full join o on e.doc_id = o.doc_id
    """,
}
