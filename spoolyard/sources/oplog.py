"""Operation logs: schemas, adapters from tables, checks that turn bad rows into rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DATA_TYPE_MISMATCH, QUEUE_NOT_FOUND

OPS = "op_seq long, ts timestamp_ntz, queue_id string, op string, shard int, pointer long, data string"
FIELDS = ("op_seq", "ts", "queue_id", "op", "shard", "data")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame, shards: int = 1) -> DataFrame:
    """signup, view: load; click: reload; purchase, error: fire. Five queues by user; shard by event where there are several."""
    op = F.when(F.col("event_type").isin("signup", "view"), "load").when(F.col("event_type") == "click", "reload").otherwise("fire")
    return events.select(
        F.col("event_id").alias("op_seq"),
        "ts",
        F.concat(F.lit("Q"), (F.col("user_id") % 5).cast("string")).alias("queue_id"),
        op.alias("op"),
        (assign_shard(F.col("event_id"), shards) if shards > 1 else F.lit(None).cast("int")).alias("shard"),
        F.concat_ws("_", "event_type", "props").alias("data"),
    )


def from_table(rows: DataFrame, order: str, queue: Column, data: Column, op: Column | None = None, shards: int = 1) -> DataFrame:
    """Any table as a log of loads (or of op): order must be unique."""
    seq = F.col(order).cast("long")
    return rows.select(
        seq.alias("op_seq"), F.lit(None).cast("timestamp_ntz").alias("ts"), queue.cast("string").alias("queue_id"), (F.lit("load") if op is None else op).alias("op"),
        (assign_shard(seq, shards) if shards > 1 else F.lit(None).cast("int")).alias("shard"), data.cast("string").alias("data"),
    )


def assign_shard(op_seq: Column, shards: int) -> Column:
    """Shards in turn: any choice is an outcome of a random one, and this one replays."""
    return F.pmod(op_seq, F.lit(shards)).cast("int")


def unknown_queues(ops: DataFrame, queues: DataFrame) -> DataFrame:
    """Rejects of operations on queues that are not registered. The registry is small and its size is left to the planner."""
    missing = ops.join(queues.select("queue_id").distinct(), "queue_id", "left_anti")
    message = F.concat(F.lit("Queue not found for identifier "), F.col("queue_id"))
    return missing.select("op_seq", "queue_id", "op", F.lit(QUEUE_NOT_FOUND).alias("error_code"), message.alias("message"))


def type_rejects(ops: DataFrame, queues: DataFrame) -> DataFrame:
    """Rejects of loads and reloads whose data is not of the queue's type; null data is of no type."""
    writes = ops.where(F.col("op").isin("load", "reload")).join(queues.select("queue_id", "data_type"), "queue_id")
    number = F.when(F.col("data_type") == "int", F.col("data").try_cast("int").cast("long")).otherwise(F.col("data").try_cast("bigint"))
    wrong = F.col("data").isNull() | (F.col("data_type").isin("int", "long") & number.isNull())
    return writes.where(wrong).select("op_seq", "queue_id", "op", F.lit(DATA_TYPE_MISMATCH).alias("error_code"), F.concat_ws(" ", F.lit("expected"), "data_type").alias("message"))
