"""Operator 4: quality rules: base counts, and a log-likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read, ship, small
from .near_dedup import mix

#: Buckets of hashed n-grams, and the orders of the n-grams.
BUCKETS = 1 << 16
ORDERS = (1, 2)
#: Added to every bucket's count, as a share of the bucket's even share of the total.
SMOOTHING = 0.01
#: Width of the steps between which the threshold is chosen, and the span that they cover.
STEP, SPAN = 0.005, 4.0
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repeats count.
REPEAT = 5

TOKEN = re.compile(r"\w+|[^\w\s]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k hashes."""
    n = max(0, len(hashes) - k + 1)
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = mix(h * _MULT + hashes[i : i + n])
    return h


def hashes_of(words: list) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text; null is empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at [\x20\x09-\x0D] only
    n = len(words)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    twice = 0
    for line in text.split("\n"):
        if line in seen:
            twice += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    repeated = 0
    if n > REPEAT:
        _, back, count = np.unique(rolling(hashes_of(words), REPEAT), return_inverse=True, return_counts=True)
        often = np.flatnonzero(count[back] > 1)
        if len(often):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, often, 1)
            np.add.at(edge, often + REPEAT, -1)
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    return n, len(text) - blanks, sum(map(text.count, SYMBOLS)), twice, repeated


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the n-grams of words and of runs of other marks."""
    tokens = hashes_of(TOKEN.findall(text or ""))
    return np.concatenate([rolling(tokens, k) for k in ORDERS]).astype(np.int64) & (BUCKETS - 1)


def log_ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | raw), both smoothed; all zero if either has seen nothing."""
    if not raw.sum() or not trusted.sum():
        return np.zeros(BUCKETS)
    share = lambda c: (c / c.sum() + SMOOTHING / BUCKETS) / (1 + SMOOTHING)
    return np.log(share(trusted)) - np.log(share(raw))


def fit_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratios from the n-grams of all documents (raw) and of all that labels calls good (trusted).

    Tasks count into arrays of BUCKETS numbers and send each bucket that they met once; the sums, BUCKETS rows, come to the
    driver. The labels are broadcast if they are small, and joined by a shuffle if not.
    """
    ship(docs.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for text, good in zip(frame["text"], frame["good"], strict=True):
                c = np.bincount(ngram_buckets(text), minlength=BUCKETS)
                raw += c
                if good:
                    trusted += c
        met = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": met, "raw": raw[met], "trusted": trusted[met]})

    good = labels.where("doc_id is not null and quality > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("good")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(good, 16), "doc_id", "left").select("text", F.col("good").isNotNull().alias("good"))
    sums = rows.mapInPandas(count, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], trusted[sums["bucket"]] = sums["raw"], sums["trusted"]
    return log_ratios(raw, trusted)


def measure(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Rows (doc_id, the base counts, llr), one for each row of docs: llr is the mean log ratio of a text's n-grams, 0 without."""
    ship(docs.sparkSession)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = [base_counts(t) for t in frame["text"]]
            llr = [float(ratios[b].mean()) if len(b := ngram_buckets(t)) else 0.0 for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), **{n: [c[i] for c in counts] for i, n in enumerate(names)}, "llr": llr})

    fields = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", llr double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, fields)


def choose_threshold(bins: list[tuple[int, int, int]]) -> float:
    """The step that parts good from bad labels best, from (bin, good rows, bad rows); errors count by their class's size.

    Of equal steps the lowest, which keeps most; without rows of both classes nothing is rejected.
    """
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return -float("inf")
    best, at, lost, caught = 0.0, -float("inf"), 0, 0
    for k, g, b in sorted(bins):
        lost, caught = lost + g, caught + b
        gain = caught / bad - 4 * lost / good  # a good document lost weighs more than a bad one kept
        if gain > best + 1e-12:
            best, at = gain, (k + 1) * STEP
    return at


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr), one for each row.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated 5-word windows. kept: not base_failed and
    llr at or above the threshold, which is chosen once from all labelled rows. Both passes read whole texts of all
    rows; nothing is shuffled but bucket counts and labels.

    Null and empty texts have no words and fail. Null ids and repeated rows pass through, a null id is never labelled; an id
    with several labels is good if one says so. With no labels, ratios are 0 and only the base rules reject. Empty
    tables give no rows; further columns are not read.
    """
    measured = keep(measure(docs, fit_ratios(docs, labels)), "measured")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("good"))
    clipped = F.least(F.greatest(F.col("llr"), F.lit(-SPAN)), F.lit(SPAN))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    measured = measured.withColumn("base_failed", failed)
    bins = measured.where("not base_failed").join(marks, "doc_id").groupBy(F.floor(clipped / STEP).alias("k")).agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    threshold = choose_threshold([(r.k, r.g, r.b) for r in bins.collect()])
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_llr": op4_quality_llr}
ORACLES: dict = {}
