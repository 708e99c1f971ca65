"""Operator 3: soft-membership mixing to target weights; DataFrame functions only."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, keep, once, read, release, small

#: Labelled ids that the classifier is fitted on (those of the least hashes), and those of each domain that are besides,
#: so that no domain is left out however rare.
SAMPLE_ROWS, DOMAIN_ROWS = 5000, 50
#: Buckets of hashed words.
BUCKETS = 4096
#: Words of evidence that a posterior rests on at most, so that memberships stay soft however long a text is.
EVIDENCE = 12
#: Steps of the projected gradient at most; it ends at this error, a share of all tokens, or when the error moves by less than
#: the share STALLED of itself in STALLS steps on end. Rates are written every WRITTEN steps.
STEPS, WRITTEN = 200, 16
ENOUGH, STALLED, STALLS = 1e-5, 0.005, 3
#: Terms up to which the steps of a rate are written out in one expression; beyond that a fold takes their place.
TERMS = 512


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+; splitting at one plain character needs no regular expression."""
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def numbers(values: list[float]) -> Column:
    """An array constant; a string that the planner folds once, as thousands of literals would be slow to build."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def fit_classifier(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict:
    """A multinomial model of hashed words for each domain, from the documents that the label table lists.

    Rows without an id or a domain are left out. Every domain with a labelled row is one of the model; priors are shares of
    all labelled rows. What comes to the driver is BUCKETS counts and a number of rows for each domain.
    """
    listed = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain")).where("domain is not null")
    named = keep(named.join(listed, "doc_id"), "domains")
    found = named.groupBy("domain").agg(F.count("*").alias("n")).collect()
    hashed = F.xxhash64("doc_id")
    place = F.row_number().over(Window.partitionBy("domain").orderBy(hashed, "doc_id"))
    rare = named.withColumn("place", place).where(F.col("place") <= DOMAIN_ROWS).select("doc_id")
    picked = listed.orderBy(hashed, "doc_id").limit(sample_rows).union(rare).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain"), "text").join(small(picked, 12), "doc_id").where("domain is not null")
    sizes = keep(rows.select("domain", F.transform(words_of(F.col("text")), bucket_of).alias("b")), "labelled")
    domains = sorted(r.domain for r in found)
    total = sum(r.n for r in found)
    counts = sizes.select("domain", F.explode("b").alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n"))
    table = {d: [0.5] * BUCKETS for d in domains}
    for r in counts.collect():
        table[r.domain][r.b] += r.n
    release(sizes)
    release(named)
    logs = {d: [math.log(x) - math.log(sum(v)) for x in v] for d, v in table.items()}
    mean = [sum(logs[d][b] for d in domains) / len(domains) for b in range(BUCKETS)] if domains else []
    return {
        "domains": domains,
        "prior": [math.log(r.n / total) for r in sorted(found, key=lambda r: r.domain)],
        "weights": [[round(logs[d][b] - mean[b], 6) for b in range(BUCKETS)] for d in domains],
    }


def memberships(model: dict, buckets: Column) -> Column:
    """Posterior of each domain (array of double) from an array of word buckets; the prior for texts without words.

    Mean log odds a word, times the number of words up to EVIDENCE.
    """
    n = F.size(buckets)

    def logit(prior: float, weights: list[float]) -> Column:
        w = numbers(weights)
        total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(w, b))
        return F.lit(prior) + F.when(n > 0, total / n * F.least(n, F.lit(EVIDENCE))).otherwise(0.0)

    odds = F.array(*(logit(a, w) for a, w in zip(model["prior"], model["weights"], strict=True)))
    scaled = once(odds, lambda x: once(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m))))
    return once(scaled, lambda x: once(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), lambda s: F.transform(x, lambda v: v / s)))


def with_memberships(docs: DataFrame, model: dict) -> DataFrame:
    """Rows (doc_id, n_tokens, p) of docs; n_tokens counts the words of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(words_of(F.col("text")), bucket_of).alias("b"))
    return rows.select("doc_id", F.size("b").cast("long").alias("n_tokens"), memberships(model, F.col("b")).alias("p"))


def rate_of(p: Column, steps: list[list[float]]) -> Column:
    """The rate of a document after these gradient steps: it starts at 1 and is cut off at 0 after each."""
    return moved(F.lit(1.0), p, steps)


def moved(rate: Column, p: Column, steps: list[list[float]]) -> Column:
    """A rate after further steps."""
    if sum(map(len, steps)) > TERMS:
        less = lambda step: F.aggregate(F.zip_with(p, step, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return F.aggregate(F.array(*map(numbers, steps)), rate, lambda acc, step: F.greatest(F.lit(0.0), acc - less(step)))
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.get(p, F.lit(d)) * F.lit(s) for d, s in enumerate(step) if s), F.lit(0.0)))
    return rate


def fit_rates(soft: DataFrame, domains: list[str], targets: Mapping[str, float] | None = None, tokens: float | None = None, smoothing: float | None = None) -> list[list[float]]:
    """Gradient steps (one number for each domain) whose rates bring the expected domain tokens to the targets.

    Minimises the sum over domains of (expected tokens - target)^2 over the tokens squared by membership, over rates of
    documents that are not negative: every step sums the table in parallel, sends the driver one number for each domain,
    and moves a document's rate by its memberships, until the error is ENOUGH. Targets that are not met are reported by a
    warning. targets are weights (equal if None) and tokens their total (as now if
    None). With smoothing, the weights are the present shares to that power and the total is such that no domain shrinks.
    """
    if unknown := sorted(set(targets or {}) - set(domains)):
        raise ValueError(f"targets name unknown domains: {unknown}")
    k = len(domains)
    p = [F.get("p", F.lit(d)) for d in range(k)]
    first = soft.agg(*(F.sum(F.col("n_tokens") * p[d]) for d in range(k)), *(F.sum(F.col("n_tokens") * p[d] * p[d]) for d in range(k))).first()
    now, curve = [x or 0.0 for x in first[:k]], [x or 0.0 for x in first[k:]]
    total = sum(now)
    if not total:
        return []
    if smoothing is not None:
        share = [(x / total) ** smoothing for x in now]
        scale = max(x / s for x, s in zip(now, share, strict=True) if s)
        goal = [scale * s for s in share]
    else:
        wanted = [float((targets or {}).get(d, 0.0)) if targets else 1.0 for d in domains]
        goal = [w / sum(wanted) * (tokens or total) for w in wanted]
    # Memberships add up to 1, so now is also the row sums of the domains' Gram matrix, tokens times membership times
    # membership: with row sums of the scaled matrix of 1.8 at most, under 2, no step overshoots however domains overlap.
    size = [min(0.9 / c, 1.8 / x) if c else 0.0 for x, c in zip(now, curve, strict=True)]
    steps: list[list[float]] = []
    state, fresh = soft.withColumn("rate", F.lit(1.0)), []
    last, stalls = math.inf, 0
    while True:
        error = [x - g for x, g in zip(now, goal, strict=True)]
        worst = max(map(abs, error))
        stalls = stalls + 1 if abs(last - worst) <= STALLED * worst else 0
        if worst <= ENOUGH * total or stalls >= STALLS or len(steps) >= STEPS:
            break
        last = worst
        step = [e * x for e, x in zip(error, size, strict=True)]
        steps.append(step)
        fresh.append(step)
        rates = state.select("n_tokens", "p", moved(F.col("rate"), F.col("p"), fresh).alias("rate"))
        if len(fresh) == WRITTEN:
            older, state, fresh = state, keep(rates, "rates"), []
            release(older)
            rates = state
        now = [x or 0.0 for x in rates.select((F.col("n_tokens") * F.col("rate")).alias("t"), "p").agg(*(F.sum(F.col("t") * p[d]) for d in range(k))).first()]
    release(state)
    if worst > ENOUGH * total:
        at = max(range(k), key=lambda d: abs(error[d]))
        warnings.warn(f"targets not met after {len(steps)} steps: {domains[at]!r} has {now[at]:.0f} expected tokens for a target of {goal[at]:.0f}", stacklevel=2)
    return steps


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] | None = None, tokens: float | None = None, domain_col: str = "lang") -> DataFrame:
    """Rows (doc_id, n_tokens, memberships map, rate), one for each row of docs.

    rate says how often a document is to be taken, 0 for never; over all rows, tokens times rate times membership adds
    up to the domain's target. Null and empty texts have no tokens and the prior's memberships; null ids and repeated rows
    pass through; a target of a domain without a labelled row is a ValueError; with no labelled rows, or no tokens at all, every rate is 1. Further columns are not read.
    """
    model = fit_classifier(docs, labels, domain_col)
    if not model["domains"] and not targets:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"), F.create_map().cast("map<string,double>").alias("memberships"), F.lit(1.0).alias("rate"))
    soft = keep(with_memberships(docs, model), "memberships")
    steps = fit_rates(soft, model["domains"], targets, tokens)
    names = F.array(*map(F.lit, model["domains"]))
    return soft.select("doc_id", "n_tokens", F.map_from_arrays(names, "p").alias("memberships"), rate_of(F.col("p"), steps).alias("rate"))


def repeat_to_mix(docs: DataFrame, labels: DataFrame, smoothing: float = 0.7, domain_col: str = "lang") -> DataFrame:
    """docs with the rows of rarer domains repeated: shares move to their power smoothing and no row is lost.

    A row comes rate times on average: the whole part of its rate, and once more if a hash of its id and text falls under
    the rest; at least once. Columns are those of docs.
    """
    model = fit_classifier(docs, labels, domain_col)
    if not model["domains"]:
        return docs
    soft = keep(with_memberships(docs, model), "memberships")
    steps = fit_rates(soft, model["domains"], smoothing=smoothing)
    rate = once(F.transform(words_of(F.col("text")), bucket_of), lambda b: once(memberships(model, b), lambda p: rate_of(p, steps)))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(1 << 20)
    times = F.greatest(F.lit(1), F.floor(rate + draw).cast("int"))
    return docs.select("*", F.explode(F.sequence(F.lit(1), times)).alias("_copy_of_mix")).drop("_copy_of_mix")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", F.map_entries("memberships").alias("memberships"), "rate")


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict = {}
