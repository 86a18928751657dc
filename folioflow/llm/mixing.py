"""Mixing to target weights with soft membership.

A naive Bayes classifier over binned statistics of the text learns domains from the labels table, and gives every document d
its posteriors p[d, k]. With t[d] tokens and a rate r[d] >= 0 (how often the document is read), domain k is expected to have
sum over d of t[d] * p[d, k] * r[d] tokens. Rates are fitted by projected gradient to

    minimise  sum over k of (that sum - target[k])**2 / target[k],   0 <= r <= most,   from r = 1

with steps scaled by 1 / t[d], and momentum. A step needs one number a domain from the corpus and adds one vector to the rates' recipe, so
no document comes to the driver. A rate depends on p alone, so the fit runs over the distinct p, of which the bins of the
statistics bound the number, and goes on until the targets are met or the error stands still; what is missed then is warned of and
in the result. Targets are as asked for. There is no greatest rate unless the caller sets one.

All that reads documents is DataFrame functions. Labels without a domain don't teach; of a document's labels toxic counts before high,
and high before low; with no label at all the posteriors are even.
Results: null or blank texts have no tokens, so their rate moves no total; repeated rows each get the same rate; a row with a null
doc_id isn't labelled. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, without, written

DOMAINS = ("high", "low", "toxic")
#: Edges of the bins of each statistic.
EDGES = {
    "n_tokens": (10, 50, 200, 1000),
    "mean_length": (2.5, 4.0, 5.5, 7.0, 9.0),
    "symbols": (0.005, 0.03, 0.1, 0.3),
    "capitals": (0.02, 0.05, 0.1, 0.4),
    "shouts": (0.002, 0.02, 0.2),
    "distinct": (0.1, 0.25, 0.4, 0.55, 0.7),
    "same_lines": (0.01, 0.1, 0.3),
    "lexicon": (0.5, 1.5, 2.5),
}
STEM = 5


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, or else high or low quality."""
    domain = F.when(F.max("toxic") == 1, "toxic").when(F.max("quality") == 1, "high").when(F.max("quality") == 0, "low")
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(domain.alias("domain")).filter("domain is not null")


def _letters(text: Column) -> Column:
    """Distinct words in lower case, cut to their stems."""
    return F.array_distinct(F.transform(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.left(w, F.lit(STEM))))


def toxic_stems(docs: DataFrame, domains: DataFrame, *, sample: int = 20_000, most: int = 300, least_share: float = 0.02, odds: float = 15.0) -> list[str]:
    """Beginnings of words that toxic labelled documents have more often; of at most `sample` of them by hash of the id."""
    picked = hashed_sample(domains, "doc_id", sample, 3)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).join(F.broadcast(picked), "doc_id")  # at most `sample` ids
    sizes = {bool(r.y): r["count"] for r in rows.groupBy((F.col("domain") == "toxic").alias("y")).count().collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_other:
        return []
    each = rows.select((F.col("domain") == "toxic").alias("y"), F.explode(_letters(F.col("t"))).alias("stem")).filter(F.length("stem") >= 3)
    counts = each.groupBy("stem").agg(F.count_if("y").alias("toxic"), F.count_if(~F.col("y")).alias("other"))
    ratio = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("other") + 0.5) / (n_other + 1))
    best = counts.filter((F.col("toxic") >= max(4, least_share * n_toxic)) & (ratio >= odds))
    return [r.stem for r in best.orderBy(F.desc("toxic"), "stem").limit(most).collect()]


def binned(docs: DataFrame, stems: list[str]) -> DataFrame:
    """(doc_id, tokens, bins array<int>), without the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(x) > 0)
    words = F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "")
    rows = rows.select(
        "doc_id", "t", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).alias("n_distinct"),
        F.size(lines).alias("n_lines"), F.size(F.array_distinct(lines)).alias("n_distinct_lines"),
    )
    n, size = F.greatest("tokens", F.lit(1)), F.greatest(F.length("t"), F.lit(1))

    def share(pattern: str, of: Column) -> Column:
        return F.regexp_count("t", F.lit(pattern)) / of

    stats = {
        "n_tokens": F.col("tokens"), "mean_length": size / n, "symbols": share(r"[#*$%&|<>]", n), "capitals": share(r"\p{Lu}", size), "shouts": share(r"[!?]", n),
        "distinct": F.col("n_distinct") / n, "same_lines": 1 - F.col("n_distinct_lines") / F.greatest("n_lines", F.lit(1)),
        "lexicon": F.size(F.array_intersect(_letters(F.col("t")), F.array(*map(F.lit, stems)))) if stems else F.lit(0),
    }
    bins = [sum(((stats[k] >= e).cast("int") for e in edges), F.lit(0)) for k, edges in EDGES.items()]
    return rows.select("doc_id", "tokens", F.array(*bins).alias("bins"))


def posteriors(rows: DataFrame, domains: DataFrame, names: tuple[str, ...] = DOMAINS) -> DataFrame:
    """rows with p array<double>, one for each name: naive Bayes over the bins."""
    known = rows.join(domains, "doc_id").select("domain", F.posexplode("bins").alias("f", "b"))
    counts = {(r.domain, r.f, r.b): r["count"] for r in known.groupBy("domain", "f", "b").count().collect()}  # statistics x bins x domains
    of = {k: sum(n for (d, f, _), n in counts.items() if d == k and f == 0) for k in names}
    scores = []
    for k in names:
        score = F.lit(math.log((of[k] + 1) / (sum(of.values()) + len(names))))
        for f, edges in enumerate(EDGES.values()):
            n_bins = len(edges) + 1
            table = [math.log((counts.get((k, f, b), 0) + 0.5) / (of[k] + 0.5 * n_bins)) for b in range(n_bins)]
            score = score + F.element_at(F.array(*map(F.lit, table)), F.element_at("bins", f + 1) + 1)
        scores.append(score)
    rows = rows.withColumn("s", F.array(*scores)).withColumn("s", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    return rows.withColumn("p", F.transform("s", lambda x: x / F.aggregate("s", F.lit(0.0), lambda a, b: a + b))).drop("s")


def _after(state: Column, steps: list[list[float]], most: float) -> Column:
    """state struct(rate, ahead) after these steps, each a vector by domain and then the momentum.

    Projected gradient from the point ahead; the rate stays between zero and `most`.
    """

    def step(now: Column, g: Column) -> Column:
        down = F.aggregate(F.zip_with("p", g, lambda p, x: p * F.coalesce(x, F.lit(0.0))), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
        rate = F.least(F.lit(most), F.greatest(F.lit(0.0), now["ahead"] - down))
        return F.struct(rate.alias("rate"), (rate + F.element_at(g, -1) * (rate - now["rate"])).alias("ahead"))

    if not steps:
        return state
    return F.aggregate(F.array(*(F.array(*map(F.lit, g)) for g in steps)), state, step)


def _descend(targets: list[float], scale: list[float], longest: float, total, step, rounds: int, tolerance: float, patience: int) -> list[float]:
    """Steps until each target is met to the tolerance, or `patience` of them have brought next to nothing; warns of what is
    missed, as shares of the targets, and returns it. total(): the domains' totals at the point ahead; step(vector) moves the rates."""
    last, least, idle, pace, miss = math.inf, math.inf, 0, 1.0, []
    for _ in range(rounds if longest else 0):
        miss = [(t - target) / s for t, target, s in zip(total(), targets, scale, strict=True)]
        if max(map(abs, miss)) < tolerance:
            break
        error = sum(m * m * s for m, s in zip(miss, scale, strict=True))
        idle = idle + 1 if least - error < 1e-10 * sum(scale) else 0
        if idle >= patience:
            break  # the least there is
        if error > last:
            pace = 1.0  # the momentum leads astray: it starts anew
        least, last, faster = min(least, error), error, (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        step([*(x / longest for x in miss), (pace - 1) / faster])
        pace = faster
    if max(map(abs, miss), default=0.0) >= tolerance:
        warnings.warn("targets missed by " + ", ".join(f"{m:+.3%}" for m in miss), stacklevel=3)
    return miss or [0.0] * len(targets)


def fit_rates(
    rows: DataFrame, targets: list[float], *, most: float = math.inf, rounds: int = 20_000, tolerance: float = 1e-4, fold: int = 12, patience: int = 10, most_local: int = 300_000
) -> DataFrame:
    """rows (tokens, p) with a rate of at most `most`, and missed (array<double>: by what share each target is). Up to most_local distinct p are fitted on the driver; beyond, each step is a pass over
    them, and after `fold` steps the rates so far are written, so that the recipe stays short."""
    n = len(targets)
    scale = [max(t, 1e-6 * sum(targets), 1e-9) for t in targets]
    groups = written(rows.groupBy("p").agg(F.sum("tokens").alias("tokens")), "rate-groups")
    gram = groups.agg(*(F.coalesce(F.sum(F.col("tokens") * F.element_at("p", i + 1) * F.element_at("p", j + 1)), F.lit(0.0)) for i in range(n) for j in range(n))).first()
    longest = max((sum(gram[i * n + j] / math.sqrt(scale[i] * scale[j]) for j in range(n)) for i in range(n)), default=0.0)  # bounds the greatest eigenvalue
    if groups.count() <= most_local:
        own = groups.collect()
        p, tokens = np.array([g.p for g in own]).reshape(-1, n), np.array([g.tokens for g in own], float)
        now = {"rate": np.ones(len(own)), "ahead": np.ones(len(own))}

        def step(g: list[float]) -> None:
            rate = np.clip(now["ahead"] - p @ np.array(g[:-1]), 0.0, most)
            now.update(rate=rate, ahead=rate + g[-1] * (rate - now["rate"]))

        missed = _descend(targets, scale, longest, lambda: (tokens * now["ahead"]) @ p, step, rounds, tolerance, patience)
        rates = rows.sparkSession.createDataFrame([(g.p, float(r)) for g, r in zip(own, now["rate"], strict=True)], "p array<double>, rate double")
        return rows.join(F.broadcast(written(rates, "fitted-rates")), "p").withColumn("missed", F.array(*map(F.lit, map(float, missed))))
    at = {"rows": groups.withColumn("state", F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))), "steps": []}

    def total() -> list[float]:
        ahead = at["rows"].withColumn("now", _after(F.col("state"), at["steps"], most)["ahead"])
        return list(ahead.agg(*(F.sum(F.col("tokens") * F.element_at("p", k + 1) * F.col("now")) for k in range(n))).first())

    def far_step(g: list[float]) -> None:
        at["steps"].append(g)
        if len(at["steps"]) == fold:
            at.update(rows=written(at["rows"].withColumn("state", _after(F.col("state"), at["steps"], most)), "rates"), steps=[])

    missed = _descend(targets, scale, longest, total, far_step, rounds, tolerance, patience)
    rated = rows.join(at["rows"].select("p", _after(F.col("state"), at["steps"], most)["rate"].alias("rate")), "p")
    return rated.withColumn("missed", F.array(*map(F.lit, map(float, missed))))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *, reference: str | None = None, budget: float | None = None, most_rate: float = math.inf) -> DataFrame:
    """One row per document: doc_id, tokens, domain, p_<name> and missed_<name> for each domain, rate and copies.

    weights: share of tokens of each domain. The targets are weights * budget; without a budget it is such that the
    reference domain keeps its expected tokens. missed_<name>: by what share of it the domain's target is missed, the same on all
    rows. copies: the rate as a whole number, rounded up by the hash of the id as often as the fraction says.
    """
    names = tuple(weights)
    domains = domain_of(labels)
    features = written(binned(docs, toxic_stems(docs, domains)), "mix-features")
    rows = written(posteriors(features, domains, names), "posteriors")
    have = rows.agg(*(F.coalesce(F.sum(F.col("tokens") * F.element_at("p", k + 1)), F.lit(0.0)) for k in range(len(names)))).first()
    if budget is None:
        at = names.index(reference or names[0])
        budget = have[at] * sum(weights.values()) / weights[names[at]]
    targets = [w / sum(weights.values()) * budget for w in weights.values()]
    fitted = fit_rates(rows, targets, most=most_rate)
    best = reduce(lambda a, k: F.when(F.element_at("p", k + 1) == F.array_max("p"), names[k]).otherwise(a), reversed(range(len(names))), F.lit(None).cast("string"))
    even = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(F.col("rate") + 1e-9) + (even < F.col("rate") - F.floor(F.col("rate") + 1e-9)).cast("long")).cast("long")
    own = [F.element_at(column, k + 1).alias(f"{prefix}_{name}") for column, prefix in (("p", "p"), ("missed", "missed")) for k, name in enumerate(names)]
    return fitted.select("doc_id", "tokens", best.alias("domain"), *own, "rate", copies.alias("copies"))


def sampled_to_mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """The rows of docs that have a copy in the mixture, with all their columns, once each: a document isn't repeated here, so rates
    are fitted under one."""
    return without(docs, mixed(docs, labels, weights, most_rate=1.0, **options).filter("copies = 0 and doc_id is not null"))
