"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule looks at statistics of a text and votes good (1), bad (-1) or abstains (0). Documents with the same votes are
alike, so the votes are counted by pattern (at most 2 ** number of rules, as a rule votes one way) and a model of
independent rules is fitted to the counts: how often each rule is right. The posterior probability of good replaces the
demand that all rules pass.

Statistics are DataFrame functions on one row at a time; nothing is shuffled but the counts of patterns.

Results: null texts have no words and fail the base; repeated rows are judged alike; all documents that fail the base are
not kept, whatever the posterior. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of that many words that the text has twice or more.

    Windows are told apart by 64-bit hashes: a text of n words has a false twin with a chance of about n * n / 2**65, 1e-11 at 20,000 words.
    """

    def places(sorted_grams: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            h = x["h"]
            return F.coalesce(h == F.get(sorted_grams, i - 1)["h"], F.lit(False)) | F.coalesce(h == F.get(sorted_grams, i + 1)["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(sorted_grams, twin), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def of_grams(grams: Column) -> Column:
        numbered = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        slow = let(F.sort_array(numbered), lambda s: let(places(s), covered))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(slow)

    def of_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - window)
        return let(F.transform(starts, lambda i: F.xxhash64(*(hashes[i + k] for k in range(window)))), of_grams)

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, and the statistics that the base and the rules need; no text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(_WORD))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", "t", words_of(F.col("t")).alias("w"), lines.alias("l"))
    solid = F.array_join("w", "")
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        F.regexp_count(solid, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count(solid, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(solid, F.lit(r"!!|\?\?|[!?][.,]")).cast("long").alias("n_shouts"),
        F.regexp_count(solid, F.lit(r"[.?!]")).cast("long").alias("n_stops"),
        F.regexp_count(solid, F.lit(r"[^\p{L}\p{M}]")).cast("long").alias("n_not_letters"),
        F.size(F.filter("l", lambda x: x.rlike(r"[.?!:;][\x20\x09-\x0D\"')\]]*$"))).cast("long").alias("n_ended"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name and vote of each rule, over the statistics. Detectors of one kind of junk vote bad or abstain; rules that vote
    good ask for several things at once, so that text of one kind of junk doesn't look good to all but one rule."""
    c = F.col
    n = F.greatest("n_words", F.lit(1))
    long_enough = c("n_words") >= 30
    plain = (50 * c("n_symbols") <= n) & (100 * c("n_not_letters") <= 8 * c("word_chars")) & (10 * c("n_capitals") <= 2 * c("word_chars"))
    varied = (20 * c("n_repeat_words") <= n) & (2 * c("n_distinct") >= n)
    bad = {
        "symbols": 10 * c("n_symbols") > n,
        "letters": long_enough & (100 * c("n_not_letters") > 15 * c("word_chars")),
        "line_ends": long_enough & (10 * c("n_ended") < 3 * c("n_lines")),
        "repeated_lines": 3 * c("n_dup_lines") > c("n_lines"),
        "repeated_words": 100 * c("n_repeat_words") > 15 * n,
        "capitals": long_enough & (5 * c("n_capitals") > 2 * c("word_chars")),
        "shouting": 20 * c("n_shouts") > n,
        "few_words": long_enough & (4 * c("n_distinct") < n),
        "stops": long_enough & ((100 * c("n_stops") < n) | (c("n_stops") > n)),
    }
    good = {
        "prose": plain & varied & (c("n_words") > 0),
        "sentences": plain & (10 * c("n_ended") >= 7 * c("n_lines")) & (2 * c("n_stops") <= n) & (c("n_stops") > 0),
        "fresh_lines": plain & (c("n_lines") >= 3) & (c("n_dup_lines") == 0) & varied,
    }
    return {k: F.when(x, -1).otherwise(0) for k, x in bad.items()} | {k: F.when(x, 1).otherwise(0) for k, x in good.items()}


@dataclass
class LabelModel:
    """How often each rule is right when it votes; abstaining says nothing.

    prior is the chance of good before any vote. It stays even: with a prior learned from the corpus, the votes of a rule
    that no other rule joins would count for less the commoner good documents are, until the rule is taken for chance.
    """

    prior: float
    accuracies: list[float]

    @classmethod
    def fit(cls, patterns: dict[tuple[int, ...], int], n_rules: int, *, prior: float = 0.5, rounds: int = 200, start: float = 0.8, weight: float = 20.0) -> LabelModel:
        """EM over counts of vote patterns; a Beta prior of that weight holds rules to be right as often as `start`."""
        model = cls(prior, [start] * n_rules)
        for _ in range(rounds):
            right, cast = [start * weight] * n_rules, [weight] * n_rules
            for votes, n in patterns.items():
                good = model.posterior(votes)
                for r, v in enumerate(votes):
                    if v:
                        cast[r] += n
                        right[r] += n * (good if v > 0 else 1 - good)
            after = cls(prior, [min(max(a / b, 0.5), 0.999) for a, b in zip(right, cast, strict=True)])
            moved, model = sum(abs(a - b) for a, b in zip(after.accuracies, model.accuracies, strict=True)), after
            if moved < 1e-9:
                break
        return model

    def log_odds(self) -> tuple[float, list[float]]:
        """Of good: the prior's, and what a vote of each rule adds in its direction."""
        return math.log(self.prior / (1 - self.prior)), [math.log(a / (1 - a)) for a in self.accuracies]

    def posterior(self, votes: tuple[int, ...]) -> float:
        start, of = self.log_odds()
        return 1 / (1 + math.exp(-(start + sum(o * v for o, v in zip(of, votes, strict=True)))))


def weak_quality(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, votes,
    quality (the posterior probability of good) and kept."""
    votes = rules()
    stats = written(text_statistics(docs).withColumn("base_failed", base_failed()).withColumns({f"vote_{k}": v for k, v in votes.items()}), "quality")
    names = [f"vote_{k}" for k in votes]
    patterns = {tuple(r)[:-1]: r["count"] for r in stats.groupBy(*names).count().collect()}  # at most 2 ** number of rules
    start, odds = LabelModel.fit(patterns, len(names)).log_odds()
    total = F.lit(start)
    for name, of in zip(names, odds, strict=True):
        total = total + F.col(name) * F.lit(of)
    quality = 1 / (1 + F.exp(-total))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.struct(*(F.col(f"vote_{k}").alias(k) for k in votes)).alias("votes"), quality.alias("quality"),
        (~F.col("base_failed") & (quality >= least)).alias("kept"),
    )
