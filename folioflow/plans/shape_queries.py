"""Queries over shapes of text: lines, labels, markup, rules of what is translated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, mathtext, numbers, validation
from ..functions import text as T
from ..operators import layout, policy, terms
from ..sources.tables import lines, table
from . import sql

_MARKUP_STEPS = [
    *((shape, put) for name, as_name in (("b", "b"), ("strong", "b"), ("sup", "sup")) for shape, put in (
        (rf"(?is)&lt;\s*{name}\b[^&]*&gt;", f"<{as_name}>"), (rf"(?is)&lt;\s*/\s*{name}\s*&gt;", f"</{as_name}>"), (rf"(?is)<\s*{name}\b[^>]*>", f"<{as_name}>"), (rf"(?is)<\s*/\s*{name}\s*>", f"</{as_name}>"))),
    (r"(?is)&lt;\s*br\s*/?\s*&gt;|</?\s*br\b[^>]*>", "\n"), (rf"(?is)<\s*/?\s*(?:{'|'.join(fixed.WRAPPER_TAGS)})\b[^>]*>", ""), (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "),
]


def _normalised_sql(x: str) -> str:
    out = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    for shape, put in _MARKUP_STEPS:
        out = f"regexp_replace({out}, {sql.quoted(shape)}, {sql.quoted(put)}, 'g')"
    return out


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without light tags, as one line, and with the markup of a translation."""
    shown = F.md5(T.plain_text("html")), F.md5(T.joined_lines(F.split("html", "\n"))), F.md5(validation.normalised("html"))
    return table(spark, sf_dir, "pages").select("page_id", *(x.alias(n) for x, n in zip(shown, ("plain", "joined", "normalised"), strict=True)))


def reasoning_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with reasoning put into them, closed in most and open in every fifth."""
    inside = F.concat(F.lit("<think>"), "role", F.lit("\n?"), F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "").otherwise("</think> "))
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.without_reasoning(F.concat(F.lit(" "), "text", inside, "role")).alias("text"))


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as so many paragraphs as their id asks for."""
    want = (F.col("doc_id") % 4 + 1).cast("int")
    split = table(spark, sf_dir, "documents").select("doc_id", policy.split_paragraphs("text", want).alias("p"))
    return split.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "¶")).alias("paragraphs"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of contents for each brand of parts, and one that lost a page number."""
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    each = table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").groupBy("p_brand").agg(rows.alias("r"))
    toc = lambda page: F.array_join(F.transform("r", lambda x: F.concat(x["p_name"], F.lit(" . . . . "), page(x["p_partkey"]).cast("string"))), " ")
    return each.select("p_brand", toc(lambda k: k).alias("toc"), toc(lambda k: F.when(k % 70 == 0, k + 1).otherwise(k)).alias("other"))


def toc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir).select("p_brand", F.posexplode(T.toc_entries("toc")).alias("pos", "e")).select("p_brand", F.col("pos").cast("long").alias("pos"), F.col("e.label").alias("label"), F.col("e.page").alias("page"))


def toc_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir).select("p_brand", validation.toc_reason("toc", "other").alias("reason"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as authors: what of an entry stays and what is translated, and whether it leads an entry or a paragraph."""
    k = F.col("c_custkey")
    entry = F.concat(F.when(k % 7 == 0, "by ").otherwise(""), F.initcap("c_mktsegment"), F.lit(", "), F.substring("c_name", 1, 1), F.when(k % 3 == 0, ". and others").otherwise("."), F.lit(" ("), (F.lit(1850) + k % 170).cast("string"), F.lit("). Notes on the market of "), F.lower("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", entry.alias("t"))
    parts = policy.reference_parts("t")
    return rows.select("c_custkey", T.is_reference_lead("t").alias("is_lead"), parts["lead"].alias("lead"), parts["rest"].alias("rest"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cited = F.concat(F.when(k % 2 == 0, F.concat((k % 90).cast("string"), F.lit(". "))).otherwise(""), F.initcap("c_mktsegment"), F.when(k % 3 == 0, " & Sons").when(k % 3 == 1, " et al.").otherwise(" others"), F.lit(" ("), (F.lit(1790) + k % 250).cast("string"), F.lit(")"), F.when(k % 5 == 0, ", pp. 3-4.").when(k % 5 == 1, " of late").otherwise("."))
    return table(spark, sf_dir, "customer").select("c_custkey", cited.alias("t")).select("c_custkey", T.is_short_citation("t").alias("is_citation"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an order's fields: structured ones, and those that are an identifier alone."""
    k = F.col("o_orderkey")
    row = F.when(k % 4 == 0, F.concat_ws(" ", "o_orderstatus", k.cast("string"), F.upper("o_orderpriority"))).when(k % 4 == 1, F.concat_ws("-", F.lit("ORD"), k.cast("string"), F.upper("o_orderstatus"))).when(
        k % 4 == 2, F.concat(F.lit("[1] http://orders.example/"), k.cast("string"), F.lit(" ;"))).otherwise(F.concat(F.lit("doi 10."), (10_000 + k % 90_000).cast("string"), F.lit("/x"), k.cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", row.alias("t"))
    return rows.select("o_orderkey", T.is_structured_row("t").alias("is_row"), T.is_identifier_only("t").alias("is_identifier"), mathtext.is_identifier_line("t").alias("is_address"))


def lead_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a number, a letter or a bullet put before them; which of them lead a paragraph."""
    n = F.col("line_no").cast("long") % 6
    led = F.concat(F.when(n == 0, "1.2) ").when(n == 1, "(iv) ").when(n == 2, "• ").when(n == 3, "(1999) ").when(n == 4, "b.").otherwise(""), "line")
    each = lines(table(spark, sf_dir, "documents")).select("source", n.alias("kind"), T.is_paragraph_lead(led).alias("is_lead"))
    return each.groupBy("source", "kind").agg(F.count("*").alias("n"), F.count_if("is_lead").alias("n_leads"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    own = F.initcap("p_name")
    label = F.when(k % 8 == 0, F.concat(own, F.lit(" Ltd"))).when(k % 8 == 1, F.concat(F.lit("Dr "), own)).when(k % 8 == 2, F.concat(own, F.lit(", (974) 555-"), k.cast("string"))).when(k % 8 == 3, F.concat(F.lit("Chapter "), k.cast("string"))).when(
        k % 8 == 4, F.element_at(F.array(*map(F.lit, fixed.SHORT_LABELS)), (k % len(fixed.SHORT_LABELS) + 1).cast("int"))).when(k % 8 == 5, F.upper("p_type")).when(k % 8 == 6, F.concat(F.lit("2.1 "), "p_name")).otherwise(own)
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("t"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as labels: contact lines, proper names, short labels, tiny ones."""
    flags = {"is_contact": policy.is_contact_line("t"), "is_name": policy.is_proper_name("t"), "is_label": policy.is_short_label("t"), "is_tiny": T.is_tiny_label("t")}
    return _labels(spark, sf_dir).select("p_partkey", *(x.alias(n) for n, x in flags.items()))


def math_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, and formulae made of a line's number and source: how many are mathematics."""
    n = F.col("line_no").cast("long") % 6
    made = F.when(n == 0, F.concat(F.lit("x = "), F.col("line_no").cast("string"), F.lit(" + y"))).when(n == 1, F.concat(F.lit("sin("), "source", F.lit(")"))).when(n == 2, F.concat(F.lit("\\frac{a}{b} "), "line")).when(n == 3, F.concat(F.substring("line", 1, 30), F.lit(" ≤ ab2"))).otherwise(F.col("line"))
    each = lines(table(spark, sf_dir, "documents")).select("doc_id", n.alias("kind"), T.is_math_text(made).alias("m"))
    return each.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.count_if("m").alias("n_math"))


def translatable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = lines(table(spark, sf_dir, "documents"))
    return each.groupBy("source", F.coalesce(T.translatable_rule("line"), F.lit("translate")).alias("rule")).agg(F.count("*").alias("n"))


def untranslated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 400 characters or more of which under a quarter is in lines that would be translated."""
    each = lines(table(spark, sf_dir, "documents")).select("doc_id", F.length("line").alias("n"), T.translatable_rule("line").alias("rule"))
    sums = each.groupBy("doc_id").agg(F.sum("n").alias("n_chars"), F.sum(F.when(F.col("rule").isNull(), F.col("n")).otherwise(0)).alias("n_translatable"))
    return sums.filter((F.col("n_chars") >= 400) & (4 * F.col("n_translatable") < F.col("n_chars")))


def prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as boxes of their length: body prose, and those with more symbols than such prose carries."""
    each = lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line").alias("content"), F.lit(0.0).alias("y0"), (11.0 * F.ceil(F.length("line") / 94)).alias("y1"), (9.0 + F.col("line_no") % 3).alias("fontsize"))
    risk = layout.formula_risk(F.regexp_count("content", F.lit("[%$#]")))
    return each.groupBy("doc_id").agg(F.count_if(layout.is_body_prose(F.lit(10.5))).alias("n_prose"), F.count_if(risk).alias("n_risk"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders in several spellings, in Chinese."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    spelt = F.when(k % 5 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 5 == 1, F.date_format(d, "M/d/yyyy")).when(k % 5 == 2, F.concat(F.date_format(d, "d"), F.lit("-"), F.date_format(d, "MMM"), F.lit("-"), F.date_format(d, "yyyy"))).when(
        k % 5 == 3, F.concat(F.date_format(d, "d"), F.lit(" "), F.date_format(d, "MMMM"), F.lit(" "), F.date_format(d, "yyyy"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.full_date(spelt).alias("date"))


FIXED = {"high": "高", "low": "低", "not specified": "未指定"}


def fixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_linenumber")
    label = F.when(k % 5 == 0, F.concat(F.lit("Band "), F.col("l_linenumber").cast("string"), F.lit(" (x)"))).when(k % 5 == 1, F.concat(F.col("l_linenumber").cast("string"), F.lit(".5 times"))).when(k % 5 == 2, "Not  Specified").when(k % 5 == 3, "LOW").otherwise("other")
    return table(spark, sf_dir, "lineitem").groupBy(F.coalesce(policy.fixed_label(label, FIXED), F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


def sizes_and_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts as sizes of type, and their keys as colours."""
    color = (F.col("p_partkey") * 66_051 % 16_777_216).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", T.font_bucket(F.col("p_retailprice") / 100).alias("bucket"), T.is_light_gray(color).alias("is_gray"))


def raised_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat("p_name", F.lit("<sup> "), F.col("p_size").cast("string"), F.lit(" </sup> &lt;sup&gt;*&lt;/sup&gt; <SUP class='a'><b>x</b></SUP><sup></sup>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(validation.raised_marks(made), "|").alias("marks"))


def term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.candidates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        page_texts, reasoning_free, paragraph_split, toc_rows, toc_verdicts, references, citations, codes, lead_lines, labels, math_texts, translatable_rules, untranslated_share, prose_lines, dates, fixed_labels, sizes_and_colors, raised_marks,
        term_candidates,
    )
}

_TOC = """
    c as (
        select p_brand, string_agg(p_name || ' . . . . ' || p_partkey, ' ' order by p_partkey) as toc, string_agg(p_name || ' . . . . ' || (case when p_partkey % 70 = 0 then p_partkey + 1 else p_partkey end), ' ' order by p_partkey) as other
        from part where p_partkey % 10 = 0 group by 1
    )
"""
_LEADER = r"(?:[.…·]\s*){4,}\s*(\d+)\b"
_ENTRY = """(case when c_custkey % 7 = 0 then 'by ' else '' end || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ', ' || c_name[1] || case when c_custkey % 3 = 0 then '. and others' else '.' end
    || ' (' || (1850 + c_custkey % 170) || '). Notes on the market of ' || lower(c_mktsegment))"""
_LABEL = f"""case p_partkey % 8 when 0 then own || ' Ltd' when 1 then 'Dr ' || own when 2 then own || ', (974) 555-' || p_partkey when 3 then 'Chapter ' || p_partkey
    when 4 then ([{', '.join(map(sql.quoted, fixed.SHORT_LABELS))}])[p_partkey % {len(fixed.SHORT_LABELS)} + 1] when 5 then upper(p_type) when 6 then '2.1 ' || p_name else own end"""
_WORDS = r"list_transform(regexp_extract_all({x}, '\p{{L}}+(?:[''’\-]\p{{L}}+)*\.?'), lambda w: regexp_replace(w, '\.+$', ''))"
_BARE = r"regexp_replace({x}, '\p{{L}}+(?:[''’\-]\p{{L}}+)*\.?', '', 'g')"


def words(x: str) -> str:
    return _WORDS.format(x=x)


def bare(x: str) -> str:
    return _BARE.format(x=x)


def capitalised(ws: str, also: list[str] = ()) -> str:
    allowed = sql.names([*policy.NAME_CONNECTORS, *also])
    return rf"len(list_filter({ws}, lambda w: not (w = '' or lower(w) in {allowed} or regexp_matches(w, '^\p{{Lu}}')))) = 0"


def label_steps(columns: str, base: str) -> str:
    """CTEs r and w over base (columns, p: collapsed text), for the flags below."""
    return rf"""
        r as (select {columns}, p, regexp_replace(p, '\(\+?\d[\d\s/-]{{0,14}}\)[\s\d/-]*|\d[\d\s/]*-[\d\s/-]*\d', ' ', 'g') as no_phone, regexp_replace(p, '[.;]+$', '') as name, regexp_replace(p, '^\s*(?:\d+(?:\.\d+)*|[A-Za-z])\s*[:.)]\s*', '') as bare from {base}),
        w as (select {columns}, p, no_phone, name, bare, {_WORDS.format(x='no_phone')} as cw, {_WORDS.format(x='name')} as nw, {_WORDS.format(x='bare')} as bw, lower(regexp_replace(bare, '^[ \t:;,.!?]+|[ \t:;,.!?]+$', '', 'g')) as key from r)
    """


IS_CONTACT = rf"(length(p) <= 120 and no_phone <> p and len(cw) between 1 and 8 and {capitalised('cw', policy.ORGANISATION_WORDS)} and regexp_matches({_BARE.format(x='no_phone')}, '^[\s,;:.&''’()\[\]/\\-]*$'))"
IS_NAME = rf"""(length(name) between 1 and 80 and len(nw) between 1 and 8 and {capitalised('nw')} and regexp_matches({_BARE.format(x='name')}, '^[\s,&''’\-]*$') and (
    len(list_filter(nw, lambda x: lower(x) in {sql.names(policy.ORGANISATION_WORDS)})) > 0 or (len(nw) >= 2 and lower(nw[1]) in {sql.names(policy.HONORIFICS)})
    or (len(nw) = 1 and regexp_matches(nw[1], '^\p{{Lu}}') and regexp_matches(nw[1], '[^\x00-\x7f]')) or (len(nw) = 1 and regexp_full_match(nw[1], '\p{{Lu}}{{9,24}}')) or regexp_matches(name, ',\s*[A-Z][A-Z0-9&.\-]{{1,11}}\s*$')
    or (len(nw) >= 2 and len(list_filter(nw[1:len(nw) - 1], lambda x: lower(x) not in {sql.names(policy.NAME_CONNECTORS)})) = 0 and regexp_matches(nw[len(nw)], '^\p{{Lu}}'))
    or (len(nw) = 2 and contains(nw[1], '-') and len(list_filter(nw, lambda x: not regexp_matches(x, '^\p{{Lu}}'))) = 0)))"""
IS_LABEL = rf"""(length(p) between 1 and 100 and key <> '' and (
    key in {sql.names(fixed.SHORT_LABELS)} or regexp_matches(bare, '(?i)^(?:date|place|urgency)\s*:\s*\S|^(?:ceo|head\s+of|partner)\b(?:\s*,|\s+)|^see\s+chapter\s+\d+(?:\.\d+)*\.?$')
    or regexp_matches(bare, '(?i)^(?:annex|annexure|appendix|chapter|section|part|figure|table|chart)\s+[A-Z0-9][A-Za-z0-9.\-]*(?:\s*:)?$') or regexp_matches(p, '^\s*\d+(?:\.\d+)*\s+[A-Za-z]') or (bare <> p and regexp_matches(bare, '[A-Za-z]'))
    or (len(bw) >= 2 and len(list_filter(bw[2:], lambda x: regexp_matches(x, '^\p{{Ll}}') and lower(x) not in {sql.names('and at by da de der di for from in of on the to van von with'.split())})) > 0)
    or (len(bw) = 1 and regexp_matches(bw[1], '^\p{{Ll}}') and regexp_matches(p, '[.!?]\s*$'))))"""
IS_TINY = f"(length(p) <= 18 and len({sql.english_words('p')}) > 0 and ((len({sql.english_words('p')}) <= 1 and length(p) <= 12) or len({sql.english_words('p')}) <= 2))"
_IDENTIFIER_LINES = "|".join(fixed.IDENTIFIER_LINES)

ORACLES = {
    "page_texts": rf"""
        select page_id, md5({sql.plain('html')}) as plain, md5({_normalised_sql('html')}) as normalised,
            md5(array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda l: {sql.squeezed('l')}), lambda l: l <> ''), ' ')) as joined from pages
    """,
    "reasoning_free": r"""
        with t as (select conv_id, turn, ' ' || text || '<think>' || role || chr(10) || '?' || case when (conv_id + turn) % 5 = 0 then '' else '</think> ' end || role as t from conversations)
        select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', ''), '^\s+|\s+$', '', 'g') as text from t
    """,
    "paragraph_split": rf"""
        with t as (select doc_id, doc_id % 4 + 1 as want, {_normalised_sql('text')} as t from documents),
        c as (select doc_id, want, list_filter(list_transform(string_split_regex(t, '\n\s*\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as blocks,
            list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as l from t),
        p as (select doc_id, want, case when want > 1 and len(blocks) <> want and len(l) = want then l else blocks end as p from c),
        o as (select doc_id, case when want <= 1 then case when len(p) = 0 then [''] else p end
            when len(p) > want then list_concat(p[1:want - 1], [array_to_string(p[want:], ' ')]) else list_concat(p, list_transform(range(0, want - len(p)), lambda i: '')) end as p from p)
        select doc_id, len(p) as n, md5(array_to_string(p, '¶')) as paragraphs from o
    """,
    "toc_rows": rf"""
        with {_TOC}, e as (select p_brand, string_split_regex({sql.collapsed('toc')}, '{_LEADER}') as l, regexp_extract_all({sql.collapsed('toc')}, '{_LEADER}', 1) as g from c),
        r as (select p_brand, l, g, unnest(range(1, len(g) + 1)) as i from e) select p_brand, i - 1 as pos, trim(l[i]) as label, g[i] as page from r where trim(l[i]) <> ''
    """,
    "toc_verdicts": f"with {_TOC} select p_brand, case when toc <> other then 'page numbers changed' end as reason from c",
    "references": rf"""
        with e as (select c_custkey, {_ENTRY} as t from customer),
        m as (select c_custkey, t, length(t) >= 18 and regexp_matches(t, '^\p{{Lu}}') and regexp_matches(t, '\((?:18\d\d|19\d\d|20[0-2]\d)\)') as is_lead, regexp_extract(t, '^(.*\((?:18\d\d|19\d\d|20[0-2]\d)\)\. )(.*)$', ['lead', 'rest']) as r from e)
        select c_custkey, is_lead, case when is_lead then r.lead end as lead, case when is_lead then r.rest end as rest from m
    """,
    "citations": rf"""
        with e as (select c_custkey, case when c_custkey % 2 = 0 then (c_custkey % 90) || '. ' else '' end || upper(c_mktsegment[1]) || lower(c_mktsegment[2:])
            || case c_custkey % 3 when 0 then ' & Sons' when 1 then ' et al.' else ' others' end || ' (' || (1790 + c_custkey % 250) || ')' || case c_custkey % 5 when 0 then ', pp. 3-4.' when 1 then ' of late' else '.' end as p from customer)
        select c_custkey, {sql.short_citation('p')} as is_citation from e
    """,
    "codes": rf"""
        with e as (select o_orderkey, case o_orderkey % 4 when 0 then o_orderstatus || ' ' || o_orderkey || ' ' || upper(o_orderpriority) when 1 then 'ORD-' || o_orderkey || '-' || upper(o_orderstatus)
            when 2 then '[1] http://orders.example/' || o_orderkey || ' ;' else 'doi 10.' || (10000 + o_orderkey % 90000) || '/x' || o_orderkey end as p from orders)
        select o_orderkey, {sql.structured_row('p')} as is_row, {sql.identifier_only('p')} as is_identifier, regexp_matches(p, {sql.quoted(_IDENTIFIER_LINES)}) as is_address from e
    """,
    "lead_lines": rf"""
        with {sql.LINES}, p as (select source, line_no % 6 as kind, {sql.collapsed("(case line_no % 6 when 0 then '1.2) ' when 1 then '(iv) ' when 2 then '• ' when 3 then '(1999) ' when 4 then 'b.' else '' end || line)")} as p from lines),
        f as (select source, kind, (regexp_matches(p, '^(?:(?:\d+(?:\.\d+)*|[A-Za-z]|[ivxlcdmIVXLCDM]{{1,8}})[.)]|\((?:\d+(?:\.\d+)*|[A-Za-z]|[ivxlcdmIVXLCDM]{{1,8}})\))\s+\S') and not regexp_matches(p, '^\((?:18|19|20)\d{{2}}\)\s')) or regexp_matches(p, '^[•▪●◦⁃∙\-*·]+\s+\S') as is_lead from p)
        select source, kind, count(*) as n, count_if(is_lead)::bigint as n_leads from f group by 1, 2
    """,
    "labels": f"""
        with n as (select p_partkey, p_name, p_type, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as own from part),
        l as (select p_partkey, {_LABEL} as p from n), {label_steps('p_partkey', 'l')} select p_partkey, {IS_CONTACT} as is_contact, {IS_NAME} as is_name, {IS_LABEL} as is_label, {IS_TINY} as is_tiny from w
    """,
    "math_texts": rf"""
        with {sql.LINES}, t as (select doc_id, line_no % 6 as kind, {sql.math_source(r"case line_no % 6 when 0 then 'x = ' || line_no || ' + y' when 1 then 'sin(' || source || ')' when 2 then '\frac{a}{b} ' || line when 3 then line[1:30] || ' ≤ ab2' else line end")} as t from lines)
        select doc_id, kind, count(*) as n, count_if({sql.math_text('t')})::bigint as n_math from t group by 1, 2
    """,
    "translatable_rules": rf"""
        with {sql.LINES}, c as (select source, {sql.collapsed('line')} as p from lines), r as ({sql.rule('source', 'c')})
        select source, coalesce(rule, 'translate') as rule, count(*) as n from r group by 1, 2
    """,
    "untranslated_share": rf"""
        with {sql.LINES}, c as (select doc_id, length(line) as n, {sql.collapsed('line')} as p from lines), r as ({sql.rule('doc_id, n', 'c')}),
        s as (select doc_id, sum(n)::bigint as n_chars, coalesce(sum(n) filter (where rule is null), 0)::bigint as n_translatable from r group by 1) select * from s where n_chars >= 400 and 4 * n_translatable < n_chars
    """,
    "prose_lines": rf"""
        with {sql.LINES}, e as (select doc_id, {sql.collapsed('line')} as p, 11.0 * ceil(length(line) / 94) as high, 9 + line_no % 3 as size, len(regexp_extract_all(line, '[%$#]')) as s from lines),
        c as (select doc_id, high, size, s, len(regexp_extract_all(p, '[A-Za-z][A-Za-z''’-]*')) as n, len(regexp_extract_all(p, '[A-Za-z]{{4,}}')) as w from e)
        select doc_id, count_if(n >= 8 and size >= 0.92 * 10.5 and (n >= 12 or high > 1.6 * greatest(1.2 * size, 8)))::bigint as n_prose, count_if(s > case when w < 4 then 0 else least(8, 2 + w // 60) end)::bigint as n_risk from c group by 1
    """,
    "dates": """
        select o_orderkey, case when o_orderkey % 5 < 4 then case when o_orderkey % 5 = 0 and day(o_orderdate) <= 12 then year(o_orderdate) || '年' || day(o_orderdate) || '月' || month(o_orderdate) || '日'
            else year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' end end as date from orders
    """,
    "fixed_labels": """
        with k as (select (l_orderkey + l_linenumber) % 5 as k, l_linenumber as n from lineitem)
        select case k when 0 then '第' || n || '档 (x)' when 1 then n || '.5倍' when 2 then '未指定' when 3 then '低' else 'none' end as label, count(*) as n from k group by 1
    """,
    "sizes_and_colors": """
        with c as (select p_partkey, greatest(p_retailprice / 100, 1) as s, (p_partkey * 66051 % 16777216)::bigint as c from part), r as (select p_partkey, s, c >> 16 & 255 as r, c >> 8 & 255 as g, c & 255 as b from c)
        select p_partkey, round_even(2 * s, 0) / 2 as bucket, r + g + b >= 375 and greatest(r, g, b) - least(r, g, b) <= 28 as is_gray from r
    """,
    "raised_marks": "select p_partkey, p_size || '|*|x' as marks from part",
}
