"""Operator 7: near-duplicate documents by min-max hashing, with links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read, ship, small
from .hubs import pairs_with, settle

#: Permutations; each gives a minimum and a maximum, so the signature has twice as many values.
PERMUTATIONS = 40
#: Values in a band. 80 values make 20 bands of 4: a pair at similarity 0.85 shares no band with chance 4e-7, at 0.8 with
#: 3e-5.
BAND = 4
BANDS = 2 * PERMUTATIONS // BAND
#: 64-bit words of the bitmap that a set is hashed into, to bound what two sets share.
WORDS = 32
#: Shingles that are hashed at once.
CHUNK = 1 << 13

_MIX1, _MIX2, _MIX3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of text, A-Z lower-cased (bytes methods do just that)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words that of the whole sequence; without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, np.uint64(min(k, len(words))))
    for i in range(min(k, len(words))):
        h = mix(h * _MIX3 + words[i : i + n])
    return np.unique(h)


_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * _MIX3) | np.uint64(1)
_B = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64) * _MIX3)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, minima first."""
    low, high = np.full(PERMUTATIONS, np.uint64(2**64 - 1)), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        h = hashes[i : i + CHUNK, None] * _A + _B
        low, high = np.minimum(low, h.min(0)), np.maximum(high, h.max(0))
    return np.concatenate((low, high))


# A band takes its values from as many permutations.
_ORDER = np.array([(j % 2) * PERMUTATIONS + (i * BAND + j) % PERMUTATIONS for i in range(BANDS) for j in range(BAND)])
_ORDER = np.concatenate((_ORDER[: PERMUTATIONS], (_ORDER[: PERMUTATIONS] + PERMUTATIONS) % (2 * PERMUTATIONS)))


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig[_ORDER].reshape(-1, BAND)
    h = np.arange(len(rows), dtype=np.uint64)
    for i in range(BAND):
        h = mix(h * _MIX3 + rows[:, i])
    return h.view(np.int64)


def _frames(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked when 100 * |A and B| >= similarity * |A or B| for their shingle sets; component_id is the smallest
    id reachable over links and kept marks that document. Documents of equal sets (128-bit sums of the set) become one
    node before anything else. Nodes meet in the buckets of their bands; in a bucket, a few documents a round are
    compared with those of other components by their full sets, until the bucket is one component or each of its
    documents has been compared. So a bucket of n copies costs about n comparisons, not n squared, and yet no pair that
    shares a bucket goes unsettled: it is compared, or joined already over others.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text with fewer words than a shingle is one shingle; a null,
    empty or blank text has none and is linked with nothing. Rows that repeat an id are one node. A row with a null id
    is never linked and is kept with a null component. Empty tables give no rows; further columns are not read.
    """
    ship(docs.sparkSession)

    def prints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, h1, h2, keys = [], [], [], []
            for text in frame["text"]:
                s = shingles(text, shingle)
                n.append(len(s))
                h1.append(int(mix(s + _MIX3).sum().view(np.int64)))
                h2.append(int(mix(s ^ _MIX2).sum().view(np.int64)))
                keys.append(bands(signature(s)) if len(s) else None)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n": n, "h1": h1, "h2": h2, "bands": keys})

    printed = keep(_frames(docs, id_col, text_col).mapInPandas(prints, "doc_id long, n long, h1 long, h2 long, bands array<long>"), "signatures")
    linked = printed.where("doc_id is not null and n > 0")
    classes = keep(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = linked.join(classes, ["h1", "h2"]).where("doc_id = node").select("node", "n", F.explode("bands").alias("bucket"))
    shared = nodes.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = keep(nodes.join(shared, "bucket"), "buckets")
    roots = _resolve(members, printed, docs, shingle, similarity, id_col, text_col)

    named = classes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    out = printed.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    root = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.col("doc_id").eqNullSafe(root).alias("kept"))


def _resolve(members: DataFrame, printed: DataFrame, docs: DataFrame, shingle: int, similarity: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, root) of the components that the documents of members (node, n, bands, bucket) make.

    s bounds what a node can share with another: its size at first, then the number of its shingles that any other
    node still in question has too; bits is a bitmap of these. |A and B| is at most s of either less the bits that only
    its bitmap has. A pair with 100 * m < similarity * (|A| + |B| - m) for such a bound m cannot be linked and is not
    compared, and a node with 100 * s < similarity * n is out. From then on bands has the buckets of a node, and band the place of
    this one, and a pair is weighed only in the first bucket that its two share.
    """

    def full_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"node": frame["doc_id"], "hashes": [shingles(t, shingle).view(np.int64) for t in frame["text"]]})

    active = members.select(F.col("node").alias("doc_id")).distinct()
    sets = keep(_frames(docs, id_col, text_col).join(small(active, 16), "doc_id", "left_semi").mapInPandas(full_sets, "node long, hashes array<long>"), "sets")

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield frame.loc[good, ["a", "b"]]

    def bitmaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shared = [np.setdiff1d(x, [] if y is None else y, assume_unique=True) for x, y in zip(frame["hashes"], frame["alone"], strict=True)]
            bits = []
            for x in shared:
                row = np.zeros(64 * WORDS, np.uint8)
                row[x.astype(np.int64) & (64 * WORDS - 1)] = 1
                bits.append(np.packbits(row).view(np.int64))
            yield pd.DataFrame({"node": frame["node"], "s": list(map(len, shared)), "bits": bits})

    def supported(now: DataFrame) -> DataFrame:
        held = keep(sets.join(small(now.select("node").distinct(), 12), "node", "left_semi"), "open-sets")
        alone = held.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.collect_list("h").alias("alone"))
        counted = held.join(alone, "node", "left").mapInPandas(bitmaps, "node long, s long, bits array<long>")
        own = printed.select(F.col("doc_id").alias("node"), "bands")
        counted = counted.join(own.join(small(now.select("node").distinct(), 12), "node", "left_semi"), "node")
        # An id with several texts has no bitmap and no bands of its own.
        alone_ = lambda c: F.when(F.count("*") == 1, F.first(c)).alias(c)
        counted = keep(counted.groupBy("node").agg(F.max("s").alias("s"), alone_("bits"), alone_("bands")), "counted")
        joined = now.drop("s", "bits", "bands", "band").join(small(counted, 8 * WORDS + 8 * BANDS + 64), "node").where(F.col("s") * 100 >= F.col("n") * similarity)
        return joined.withColumn("band", F.array_position("bands", F.col("bucket")).cast("int") - 1)

    def close(mine, hubs) -> Column:
        enough = lambda m: m * 100 >= (mine("n") + hubs("n") - m) * similarity
        only = lambda x, y: sum((F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(WORDS)), F.lit(0))
        tight = F.least(mine("s") - only(mine("bits"), hubs("bits")), hubs("s") - only(hubs("bits"), mine("bits")))
        met = reduce(or_, ((mine("band") > k) & (F.get(mine("bands"), F.lit(k)) == F.get(hubs("bands"), F.lit(k))) for k in range(BANDS - 1)))
        return F.when(~enough(F.least(mine("s"), hubs("s"))) | F.coalesce(met, F.lit(False)), False).otherwise(F.coalesce(enough(tight), F.lit(True)))

    # The node that has least of its own is the likeliest to be what the others were copied from.
    own = (F.col("n") - F.col("s")) / F.col("n")
    given = members.withColumn("s", F.col("n")).withColumns({c: F.lit(None).cast("array<long>") for c in ("bits", "bands")}).withColumn("band", F.lit(None).cast("int"))
    return settle(
        given, ["n", "s", "bits", "bands", "band"], close,
        lambda pairs: keep(pairs_with(pairs, sets, "hashes").mapInPandas(confirm, "a long, b long").distinct(), "links"), [own], supported,
    )


def op7_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), shingle=3, similarity=85)


QUERIES = {"op7_minmax_near_dedup": op7_minmax_near_dedup}
ORACLES: dict = {}
