"""Joins that are loops elsewhere: caches, neighbours, containment, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, ends_sentence, let


def cache_identity(*columns: str) -> Column:
    """Hash of the named values as JSON with its keys in order; nulls are kept as such."""
    ordered = F.struct(*(F.col(c) for c in sorted(columns)))
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def reuse(current: DataFrame, cached: DataFrame, identity: str = "identity", value: str = "translation") -> DataFrame:
    """current with the cached value where exactly one candidate has its identity, null otherwise."""
    one = cached.groupBy(identity).agg(F.count("*").alias("__n"), F.first(value).alias(value)).filter("__n = 1").drop("__n")
    return current.join(one, identity, "left")


def missing(current: DataFrame, cached: DataFrame, *keys: str) -> DataFrame:
    return current.join(cached.select(*keys), list(keys), "left_anti")


def checkpoint_reuse(current: DataFrame, saved: DataFrame, valid: Column | None = None) -> DataFrame:
    """Saved translations whose signature and text hash are those of the segment now, and that still hold (`valid`, over doc_id, seg_id,
    source and translation): doc_id, seg_id, translation."""
    now = current.select("doc_id", "seg_id", "signature", F.sha2("source", 256).alias("sha"), "source")
    same = now.join(saved, ["doc_id", "seg_id", "signature", "sha"])
    return (same if valid is None else same.filter(valid)).select("doc_id", "seg_id", "translation")


def continued_lines(lines: DataFrame) -> DataFrame:
    """Pairs of lines (doc_id, line_no, next_no) where a sentence runs on: the first has no final punctuation, or the next starts
    in lower case. lines: doc_id, line_no, line, none blank."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    pairs = lines.select("doc_id", "line_no", "line", F.lead("line_no").over(w).alias("next_no"), F.lead("line").over(w).alias("next_line")).filter("next_no is not null")
    first = F.regexp_extract("next_line", r"\p{L}", 0)
    dangling, lower = ~ends_sentence(collapsed("line")), (first != "") & (F.lower(first) == first) & (F.upper(first) != first)
    return pairs.select("doc_id", "line_no", "next_no", dangling.alias("dangling"), lower.alias("lower_start")).filter("dangling or lower_start")


def merged_islands(pairs: DataFrame) -> DataFrame:
    """Runs of continued lines: doc_id, first_no, last_no, n_lines. Pairs only link a line to the next, so components are islands."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opens = F.coalesce((F.lag("next_no").over(w) != F.col("line_no")).cast("int"), F.lit(1))
    numbered = pairs.withColumn("opens", opens).withColumn("island", F.sum("opens").over(w))
    return numbered.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_no"), F.max("next_no").alias("last_no"), (F.count("*") + 1).alias("n_lines")).drop("island")


def word_grams(text: Column, n: int = 8) -> Column:
    """Runs of n words in lower case, as array<struct<a, b>> of two 64-bit hashes of the words."""

    def of(words: Column) -> Column:
        def run(i: Column) -> Column:
            own = [words[i + k] for k in range(n)]
            return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(n), *own).alias("b"))

        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), run))

    return let(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), ""), of)


def containment(docs: DataFrame, passages: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, item_id, n_shared): documents that share runs of n words with a passage, and how many distinct ones.

    Both sides meet on the two hashes of the run (128 bits, so that no two runs are taken for one); runs aren't built as strings. Spark
    broadcasts the passages' side if its size allows, else both are shuffled. Repeats fall away among the runs that met.
    """
    sides = [df.select(key, F.explode(word_grams(F.col("text"), n)).alias("g")).select(key, "g.*") for df, key in ((docs, "doc_id"), (passages, "item_id"))]
    met = sides[0].join(sides[1].distinct(), ["a", "b"]).groupBy("doc_id", "item_id", "a", "b").agg(F.lit(1))
    return met.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))


def glossary_hits(docs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, source, target, n, first_offset): whole-term occurrences of glossary entries (source, target, ord).

    Documents and terms meet on the first word of the term (its first run of Latin letters and digits), then the whole term is looked
    for. A term without any such word, which is rare, is held against all documents.
    """
    term = F.concat(F.lit(r"(?<![A-Za-z0-9])"), F.regexp_replace("source", r"([\\.^$|?*+()\[\]{}-])", r"\\$1"), F.lit(r"(?![A-Za-z0-9])"))
    terms = glossary.withColumns({"pattern": term, "__word": F.regexp_extract("source", "[A-Za-z0-9]+", 0)})
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__rid"))
    words = rows.select("__rid", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("__word"))
    met = words.join(terms.filter("__word <> ''"), "__word").drop("__word")
    pairs = rows.join(met, "__rid").drop("__rid")
    wordless = terms.filter("__word = ''").drop("__word")
    if not wordless.isEmpty():
        pairs = pairs.unionByName(docs.select("doc_id", "text").join(wordless, F.contains("text", "source")))
    n = F.regexp_count("text", F.col("pattern"))
    return pairs.withColumn("n", n).filter("n > 0").select("doc_id", "source", "target", "n", (F.regexp_instr("text", F.col("pattern")) - 1).alias("first_offset"), "ord")


def box_overlap(a: str, b: str) -> Column:
    """Area that boxes a and b (structs x0, y0, x1, y1) share."""
    w = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    h = F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def touching(texts: DataFrame, boxes: DataFrame, padding: float = 0.0) -> DataFrame:
    """Pairs of a text and a box of the same page that overlap by more than nothing; both have doc_id, page_no, box."""
    b = boxes.withColumnRenamed("box", "other")
    meets = (
        (F.col("box.x0") < F.col("other.x1") + padding) & (F.col("other.x0") - padding < F.col("box.x1"))
        & (F.col("box.y0") < F.col("other.y1") + padding) & (F.col("other.y0") - padding < F.col("box.y1"))
    )
    return texts.join(b, ["doc_id", "page_no"]).filter(meets).withColumn("shared", box_overlap("box", "other"))


def outside_tables(images: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Images of which no table holds more than that share."""
    area = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    inside = touching(images, tables.select("doc_id", "page_no", "box")).filter(F.col("shared") > share * area).select("doc_id", "page_no", "elem_idx")
    return images.join(inside, ["doc_id", "page_no", "elem_idx"], "left_anti")


def nearest_right(markers: DataFrame, targets: DataFrame, page_width: Column) -> DataFrame:
    """For each detached list marker the best text to its right: doc_id, page_no, marker_idx, target_idx, score.

    At most max(5 em, 12 % of the page, 42) away, overlapping by 35 % of the lesser height or with centres within max(.65 em, 6);
    score = distance of centres + a tenth of the gap, the least wins, then the earlier element.
    """
    page, corners = ["doc_id", "page_no"], ["x0", "y0", "x1", "y1"]
    box = lambda side: [F.col(f"box.{c}").alias(f"{side}_{c}") for c in corners]
    m = markers.select(*page, F.col("elem_idx").alias("marker_idx"), *box("m"), F.greatest(5 * F.col("fontsize"), 0.12 * page_width, F.lit(42.0)).alias("reach"), F.greatest(0.65 * F.col("fontsize"), F.lit(6.0)).alias("close"))
    t = targets.filter(F.length("content") >= 8).select(*page, F.col("elem_idx").alias("target_idx"), *box("t")).distinct()
    # of the elements of one box the first wins, or the second where the first is the marker itself
    of_box = Window.partitionBy(*page, *(f"t_{c}" for c in corners)).orderBy("target_idx")
    t = t.withColumn("r", F.row_number().over(of_box)).filter("r <= 2").drop("r")
    # a marker and a target meet in bands of the page that both reach into, and count in the first of these
    m_centre, t_centre = (F.col("m_y0") + F.col("m_y1")) / 2, (F.col("t_y0") + F.col("t_y1")) / 2
    m = m.withColumns({"m_bands": _bands(F.least("m_y0", m_centre - F.col("close")), F.greatest("m_y1", m_centre + F.col("close"))), "columns": _bands(F.col("m_x1"), F.col("m_x1") + F.col("reach"))})
    t = t.withColumns({"t_bands": _bands(F.least("t_y0", t_centre), F.greatest("t_y1", t_centre)), "column": _band(F.col("t_x0"))})
    m = m.withColumn("band", F.explode("m_bands")).withColumn("column", F.explode("columns")).withColumn("m_bands", F.col("m_bands")[0]).drop("columns")
    t = t.withColumn("band", F.explode("t_bands")).withColumn("t_bands", F.col("t_bands")[0])
    gap = F.col("t_x0") - F.col("m_x1")
    high = F.least(F.col("m_y1") - F.col("m_y0"), F.col("t_y1") - F.col("t_y0"))
    shared = F.greatest(F.least("m_y1", "t_y1") - F.greatest("m_y0", "t_y0"), F.lit(0.0)) / F.greatest(high, F.lit(1e-6))
    centre = F.abs(m_centre - t_centre)
    near, level = (gap >= 0) & (gap <= F.col("reach")), (shared >= 0.35) | (centre <= F.col("close"))
    once = F.col("band") == F.greatest("m_bands", "t_bands")
    met = m.join(t, [*page, "band", "column"]).filter(once & (F.col("marker_idx") != F.col("target_idx")) & near & level)
    best = met.groupBy(*page, "marker_idx").agg(F.min(F.struct((centre + 0.1 * gap).alias("score"), "target_idx")).alias("best"))
    return best.select(*page, "marker_idx", "best.target_idx", "best.score")


def _band(at: Column, size: float = 64.0, most: int = 1000) -> Column:
    """The band that a coordinate lies in; those far off the page share the outermost, so that a box has 2 * most + 1 at most."""
    return F.floor(F.least(F.greatest(at / size, F.lit(-1.0 * most)), F.lit(1.0 * most)))


def _bands(low: Column, high: Column) -> Column:
    return F.sequence(_band(F.least(low, high)), _band(F.greatest(low, high)))


def nearest_above(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """The closest group above each line on its page (as-of on y): doc_id, page_no, line_idx, group_idx.

    One pass in order of y over the distinct heights of a page; of groups that end at one height the first stands for all.
    """
    page = ["doc_id", "page_no"]
    ends = groups.filter("group_y1 is not null").groupBy(*page, F.col("group_y1").alias("y")).agg(F.min("group_idx").alias("group_idx"))
    ends = ends.select(*page, "y", F.struct(F.col("y").alias("group_y1"), F.col("group_idx")).alias("group"))
    starts = lines.select(*page, F.col("line_y0").alias("y")).filter("y is not null").distinct().withColumn("group", F.lit(None).cast(ends.schema["group"].dataType))
    # at one height the group comes first, and it counts as above
    above = F.last("group", ignorenulls=True).over(Window.partitionBy(*page).orderBy("y", F.col("group").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = ends.unionByName(starts).withColumn("above", above).filter("group is null and above is not null").select(*page, F.col("y").alias("line_y0"), "above")
    rows = lines.join(found, [*page, "line_y0"])
    return rows.groupBy(*page, "line_idx").agg(F.max_by("above.group_idx", F.struct("above.group_y1", -F.col("above.group_idx"))).alias("group_idx"))


def audit(expected: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """keys with n_expected, n_observed and verdict: ok, lost, added or changed count."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("n_expected"))
    o = observed.groupBy(*keys).agg(F.count("*").alias("n_observed"))
    both = e.join(o, list(keys), "full").fillna(0, ["n_expected", "n_observed"])
    verdict = F.when(F.col("n_expected") == F.col("n_observed"), "ok").when(F.col("n_observed") == 0, "lost").when(F.col("n_expected") == 0, "added").otherwise("changed")
    return both.withColumn("verdict", verdict)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the words of a (an array of words) that b has too; null for no words."""
    return F.when(F.size(F.array_distinct(a)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def start_of(text: Column | str) -> Column:
    """What the first letter or figure of a text is: lower, upper, digit, cjk, letter, or none."""
    first = F.regexp_extract(collapsed(text), r"[\p{L}\p{N}]", 0)
    return (
        F.when(first == "", "none").when(first.rlike(r"^\p{Ll}"), "lower").when(first.rlike(r"^\p{Lu}"), "upper").when(first.rlike(r"^\p{N}"), "digit").when(first.rlike("^[\u2e80-\u9fff]"), "cjk").otherwise("letter")
    )


def merge_violations(decisions: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, decision_idx, invariant) of accepted merges that the source's elements don't bear out.

    decisions: doc_id, decision_idx, decision, kind, reason, source_page, source_element, destination_page, destination_element,
    destination_start, source_orientation, destination_orientation; elements: doc_id, page_no, elem_idx, layout_class, content.
    """

    def side(name: str) -> DataFrame:
        return elements.select("doc_id", F.col("page_no").alias(f"{name}_page"), F.col("elem_idx").alias(f"{name}_element"), F.col("layout_class").alias(f"{name}_layout"), F.col("content").alias(f"{name}_text"))

    taken = decisions.filter("decision = 'accepted'")
    for name in ("source", "destination"):
        taken = taken.join(side(name), ["doc_id", f"{name}_page", f"{name}_element"], "left")
    start = start_of("destination_text")
    dangles = ~ends_sentence(collapsed("source_text"))
    turned = F.coalesce(F.col("source_orientation") != F.col("destination_orientation"), F.lit(False))
    invariant = (
        F.when(~F.coalesce(F.col("kind"), F.lit("cross-page-merge")).isin("cross-page-merge"), "unknown-merge-kind")
        .when(F.coalesce(F.col("reason") != "accepted", F.lit(True)), "accepted-reason")
        .when(F.col("source_text").isNull() | F.col("destination_text").isNull(), "merge-evidence-missing")
        .when((F.col("source_layout") != "body") | (F.col("destination_layout") != "body"), "body-layout")
        .when(F.coalesce("destination_start", F.lit("none")) != start, "destination-start-metadata-mismatch")
        .when(~dangles & (start != "lower"), "complete-source")
        .when(turned, "page-orientation")
    )
    return taken.select("doc_id", "decision_idx", invariant.alias("invariant")).filter("invariant is not null")
