"""What the training-data operators share: table reads, tables kept in the shared folder, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Tables up to this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

#: The six characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spoolyard/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table made by keep(); the caller is sure that nothing reads it any more."""
    path = getattr(df, "_kept_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its rows, counted first, fit BROADCAST_BYTES; beyond that the planner shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated a single time, as a lambda's variable."""
    return F.get(F.transform(F.array(value), then), 0)


def without_blanks(text: Column) -> Column:
    """text less every character of [\\x20\\x09-\\x0D]; byte search, much faster than a regular expression."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


#: Edges that one task joins in memory (16 bytes each); more are joined by distributed rounds with the same result.
EDGES_IN_A_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the smallest node reachable.

    Up to EDGES_IN_A_TASK edges are joined in one task. Beyond that, the large-star and small-star rewrites alternate (each
    node links its larger, or its smaller, neighbours to the least of them) until an iteration changes nothing: every
    iteration is a partial aggregation and a join on the node, which the skew join splits, and each result is a table in
    the shared folder. Loops, repeats and nulls in edges are ignored; without edges the result is empty.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    now = keep(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= EDGES_IN_A_TASK:
        ship(edges.sparkSession)
        return now.coalesce(1).mapInPandas(_join_edges, "node long, root long")
    return star_components(now)


def _join_edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(root), "root": [find(x) for x in list(root)]}, dtype="int64")


def star_components(now: DataFrame) -> DataFrame:
    """components() by distributed rounds, of distinct edges with a > b."""
    total = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, "large")
        release(now)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        both = large.join(low, "a")
        now = keep(
            both.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct(),
            "small",
        )
        release(large)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).first()
        if seen == total:
            break
        total = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
