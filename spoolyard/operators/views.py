"""Views of queue state: dense metadata, active shards, peek, delete, expiry, draining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import shard_label

NUMBERS = ("fire_counter", "load_counter", "fire_pointer", "load_pointer")
ACTIVE = "load_counter > fire_counter and load_pointer > fire_pointer"


def metadata(counters: DataFrame, queues: DataFrame) -> DataFrame:
    """A row for every shard of every queue (queue_id, shards), zeros where nothing happened."""
    dense = queues.select("queue_id", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    seen = counters.withColumn("shard", F.coalesce("shard", F.lit(0)))
    joined = dense.join(seen, ["queue_id", "shard"], "left")
    return joined.select("queue_id", shard_label(F.col("shard")).alias("shard_key"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in NUMBERS))


def totals(meta: DataFrame) -> DataFrame:
    return meta.groupBy("queue_id").agg(*(F.sum(n).cast("long").alias(n) for n in NUMBERS))


def active(meta: DataFrame) -> DataFrame:
    return meta.where(ACTIVE)


def backlog(meta: DataFrame) -> DataFrame:
    """load_pointer - fire_pointer: what is pending, an overcount where there are holes."""
    return meta.withColumn("pending", F.col("load_pointer") - F.col("fire_pointer"))


def peek(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items of the requests (queue_id, pointers map<int, array<long>>): distinct, missing ones left out, no state change.

    Shard 0 of an unsharded queue may be asked for as 0 or, in a request without shards, by key null's stand-in -1.
    """
    flat = wanted.select("queue_id", F.explode("pointers").alias("shard", "list")).select("queue_id", "shard", F.explode("list").alias("pointer")).distinct()
    flat = flat.select("queue_id", F.when(F.col("shard") < 0, None).otherwise(F.col("shard")).alias("asked"), "pointer")
    same = (F.coalesce(slots["shard"], F.lit(0)) == F.coalesce(flat["asked"], F.lit(0))) & (slots["queue_id"] == flat["queue_id"]) & (slots["pointer"] == flat["pointer"])
    return slots.join(flat, same, "left_semi").select("queue_id", "shard", F.col("pointer").alias("fire_pointer"), "data").distinct()


def without(slots: DataFrame, deleted: DataFrame) -> DataFrame:
    """Slots less the deleted (queue_id, shard, pointer); a key that is not there is no error."""
    same = (slots["queue_id"] == deleted["queue_id"]) & slots["shard"].eqNullSafe(deleted["shard"]) & (slots["pointer"] == deleted["pointer"])
    return slots.join(deleted, same, "left_anti")


def live(slots: DataFrame, modified_at: Column, ttl_s: int, as_of: Column) -> DataFrame:
    """Slots whose time to live has not run out at as_of; -1 is for ever, an entry is gone exactly at its end."""
    if ttl_s < 0:
        return slots
    return slots.where(modified_at + F.make_dt_interval(secs=F.lit(ttl_s)) > as_of)


def drain(pending: DataFrame, k: int) -> DataFrame:
    """The next k items of each queue: by rank in the shard, then shard, so that every shard loses its oldest ones.

    A shard gives k items at most, which prunes it before its queue is ranked.
    """
    rank = F.row_number().over(Window.partitionBy("queue_id", "shard").orderBy("pointer"))
    heads = pending.withColumn("rank", rank).where(F.col("rank") <= k)
    turn = F.row_number().over(Window.partitionBy("queue_id").orderBy("rank", "shard"))
    return heads.withColumn("turn", turn).where(F.col("turn") <= k).select("queue_id", F.col("turn").cast("long").alias("turn"), "shard", F.col("pointer").alias("fire_pointer"), "data")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Registry rows by queue_id: new ones replace old ones, those not named stay."""
    return old.join(new.select("queue_id"), "queue_id", "left_anti").unionByName(new)
