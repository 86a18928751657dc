r"""Personal data: patterns for identifiers, and terms that give an identifier away.

Identifiers are emails, addresses of hosts, card numbers and phone numbers; each distinct one is a protected entity e.
Terms t are the words of the documents that hold it. Over the whole corpus

    IC(e) = log2(D / df(e))                      what it takes to know the entity
    PMI(t; e) = log2(D * n(t, e) / (df(t) * df(e)))   how much of that the term reveals

where D, df and n(t, e) count documents. A term with PMI >= disclosure * IC that is with the entity in `support` documents or
more is replaced wherever it stands in them: by its beginning if that discloses less (generalised), by nothing otherwise
(removed). Since n(t, e) <= df(e), only terms with df(t) <= df(e)**disclosure * D**(1 - disclosure) can pass, so pairs are made
of those alone.

Patterns are written so that Java's matcher neither recurses nor tries the inside of a run again, with the same leftmost
matches as the plain ones: a match may start only where no character of its first class is before it, or where the last match
ended. Positions come from the pieces between matches, so a text is passed over once for each kind, whatever it holds.

Results: null texts hold nothing; repeated rows each get a row, and count as documents of the corpus; a row with a null doc_id
is read like any other. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind to be looked for.
NEEDS = {"email": "@", "ip": None, "card": None, "phone": "+"}
#: Words of three letters or more that are no part of an identifier.
TERM = r"(?<![\p{L}\p{N}@_%+.-])\p{L}{3,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
BEGINNING = 4
_BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """Sums up to and with each number. By blocks, since an array grows by being copied."""
    empty = F.array().cast("array<bigint>")

    def add(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + x))

    def join(blocks: Column) -> Column:
        offsets = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), empty, add)
        return let(offsets, lambda of: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(of, i - 1), F.lit(0))))))

    starts = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(starts, lambda k: F.aggregate(F.slice(numbers, k * _BLOCK + 1, F.lit(_BLOCK)), empty, add))
    return F.when(F.size(numbers) == 0, empty).otherwise(let(blocks, join))


def located(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, value>>, in code points."""

    def place(parts: Column, values: Column) -> Column:
        size = F.transform(values, lambda v, i: (F.length(parts[i]) + F.length(v)).cast("bigint"))
        return let(
            running_sums(size),
            lambda ends: F.transform(values, lambda v, i: F.struct((ends[i] - F.length(v)).alias("start"), ends[i].alias("end"), v.alias("value"))),
        )

    return let(F.split(text, pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: place(parts, values)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Of a string of digits."""

    def worth(d: Column, i: Column) -> Column:
        twice = 2 * d.cast("int")
        return F.when(i % 2 == 0, d.cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) == 0) | ((F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


_FOUND = "array<struct<start bigint, end bigint, value string>>"


def found(kind: str, text: Column) -> Column:
    """Valid matches of a kind."""
    spans = F.filter(located(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    held = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike(PATTERNS[kind])
    return F.when(held, spans).otherwise(F.array().cast(_FOUND))


def _beginning(term: Column) -> Column:
    return F.concat(F.left(term, F.lit(BEGINNING)), F.lit("*"))


def _entity(kind: str, value: Column) -> Column:
    return F.xxhash64(F.lit(kind), F.lower(value) if kind == "email" else _digits(value))


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, rid, the spans of each kind (array<struct<start, end>>), the entities, and the text where there are any."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", "t", *(found(k, F.col("t")).alias(k) for k in PATTERNS))

    def values(kind: str) -> Column:
        return F.transform(kind, lambda s: _entity(kind, s["value"]))

    spans = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in PATTERNS]
    rows = rows.select("doc_id", "t", *spans, F.array_distinct(F.concat(*map(values, PATTERNS))).alias("entities"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *PATTERNS, "entities", F.when(F.size("entities") > 0, F.col("t")).alias("t"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df_t) of all words and their beginnings."""
    words = F.transform(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TERM), F.lit(0)), lambda w: F.lower(w))
    both = let(F.array_distinct(words), lambda ws: F.concat(ws, F.array_distinct(F.transform(ws, _beginning))))
    return docs.select(F.explode(both).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))


def rare_words(marked: DataFrame, df_t: DataFrame, bound: float, most_broadcast: int = 100_000) -> DataFrame:
    """(rid, term, start, end, df_t): each place of each word, of documents with entities, that is in at most `bound` documents;
    a beginning has the null place."""

    def both(found: Column) -> Column:
        words = F.transform(found, lambda w: F.struct(F.lower(w["value"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))
        nowhere = F.lit(None).cast("bigint")
        begun = F.transform(F.array_distinct(F.transform(words, lambda w: _beginning(w["term"]))), lambda b: F.struct(b.alias("term"), nowhere.alias("start"), nowhere.alias("end")))
        return F.concat(words, begun)

    words = marked.filter(F.size("entities") > 0).select("rid", F.explode(let(located(F.col("t"), TERM), both)).alias("x")).select("rid", "x.*")
    rare = df_t.filter(F.col("df_t") <= bound)
    if rare.count() <= most_broadcast:
        return words.join(F.broadcast(rare), "term")
    # The commonest go first, so that none of them gathers in a task of the join: at most most_broadcast terms are above that share.
    total = df_t.agg(F.sum("df_t")).first()[0]
    common = df_t.filter(F.col("df_t") > max(bound, total / most_broadcast)).select("term")
    return words.join(F.broadcast(common), "term", "left_anti").join(rare, "term")


def disclosing_terms(docs: DataFrame, marked: DataFrame, *, disclosure: float = 0.8, support: int = 3, most_broadcast: int = 100_000) -> DataFrame | None:
    """(rid, start, end, put): places of terms to replace; None if nothing is to be. marked: of identifiers(docs)."""
    n_docs = marked.count()
    entities = marked.select("rid", F.explode("entities").alias("e"))
    df_e = written(entities.groupBy("e").agg(F.count("*").alias("df_e")).filter((F.col("df_e") >= support) & (F.col("df_e") < n_docs)), "entities")
    n_entities, most = df_e.agg(F.count("*"), F.max("df_e")).first()
    if not n_entities:
        return None

    def most_df(of) -> Column | float:
        return of**disclosure * float(n_docs) ** (1 - disclosure) * (1 + 1e-9)

    words = written(rare_words(marked, written(term_counts(docs), "term-counts"), most_df(most), most_broadcast), "rare-words")
    entities = entities.join(F.broadcast(df_e) if n_entities <= most_broadcast else df_e, "e")  # beyond the bound it is a shuffled join
    held = words.select("rid", "term", "df_t").distinct().join(entities, "rid").filter(F.col("df_t") <= most_df(F.col("df_e")))
    held = written(held.select("rid", "e", "term", "df_t", "df_e"), "held-terms")  # read twice below
    pairs = held.groupBy("e", "term", "df_t", "df_e").agg(F.count("*").alias("n"))
    revealed = F.log2(F.col("n") * n_docs / (F.col("df_t") * F.col("df_e")))
    told = pairs.filter((F.col("n") >= support) & (revealed >= disclosure * F.log2(n_docs / F.col("df_e"))))
    told = written(told.select("e", "term"), "told-terms")
    beginnings = told.filter(F.col("term").endswith("*")).select("e", F.col("term").alias("beginning"))
    full = told.filter(~F.col("term").endswith("*")).withColumn("beginning", _beginning(F.col("term")))
    kept = full.join(beginnings.withColumn("told", F.lit(True)), ["e", "beginning"], "left")
    put = F.when(F.col("told").isNull(), F.concat(F.left("term", F.lit(BEGINNING)), F.lit("…"))).otherwise("")
    by_document = held.select("rid", "e", "term").join(kept.select("e", "term", put.alias("put")), ["e", "term"]).groupBy("rid", "term").agg(F.min("put").alias("put"))
    return words.filter("start is not null").join(by_document, ["rid", "term"]).select("rid", "start", "end", "put")


def personal_data(docs: DataFrame, *, disclosure: float = 0.8, support: int = 3) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end, put>> by kind (email, ip, card, phone, term), then start, and
    sanitised: the text with put in the place of each span, null where there is none.
    """
    marked = written(identifiers(docs), "identifiers")
    told = disclosing_terms(docs, marked, disclosure=disclosure, support=support)
    if told is None:
        told = docs.sparkSession.createDataFrame([], "rid long, start long, end long, put string")
    terms = told.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "put"))).alias("terms"))

    def named(kind: str, spans: Column, put) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), put(s).alias("put")))

    base = [named(k, F.col(k), lambda s, k=k: F.lit(f"[{k}]")) for k in PATTERNS]
    of_terms = F.coalesce(F.col("terms"), F.array().cast("array<struct<start bigint, end bigint, put string>>"))
    rows = marked.join(terms, "rid", "left").select("doc_id", "t", F.concat(*base, named("term", of_terms, lambda s: s["put"])).alias("spans"))
    return rows.select("doc_id", "spans", F.when(F.size("spans") > 0, sanitised(F.col("t"), F.col("spans"))).alias("sanitised"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced; of spans that overlap the one that starts first (then the longest) is."""

    def build(ordered: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, s: Column) -> Column:
            between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(between, s["put"])).alias("parts")))

        return F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("order"), s["end"].alias("end"), s["put"].alias("put"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, build))
