"""Replay of a log of loads, reloads and fires by window functions: pointers, failed fires, and who fired what.

It holds for logs without holes (no delete, no expiry before firing); operators.fold is for the others.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NOTHING_TO_FIRE
from .dedup import KEY, accepted

LANE = ("queue_id", "shard")


def numbered(ops: DataFrame, dedupe: bool = True, key: tuple[str, ...] = KEY, lane: tuple[str, ...] = LANE) -> DataFrame:
    """Accepted operations with pointer and failed.

    Loads and reloads count one pointer sequence in a lane (queue, shard; farm too where there is one). A fire on an empty lane
    changes nothing: with S the running sum of +1 for a write and -1 for a fire, the fires that failed so far are max(0, -min S),
    and a fire failed if that rose. A successful fire's pointer counts the successful ones. All windows share a partitioning
    and an order, so there is one exchange and one sort.
    """
    rows = _counted(ops, dedupe, key)
    in_order = Window.partitionBy(*lane).orderBy("op_seq")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    fire = F.col("op") == "fire"
    rows = rows.withColumn("balance", F.sum(F.when(fire, -1).otherwise(1)).over(so_far))
    rows = rows.withColumn("fails", F.greatest(F.lit(0), -F.min("balance").over(so_far)))
    rows = rows.withColumn("failed", fire & (F.col("fails") > F.lag("fails", 1, 0).over(in_order)))
    good = fire & ~F.col("failed")
    pointer = F.when(~fire, F.sum((~fire).cast("long")).over(so_far)).when(good, F.sum(good.cast("long")).over(so_far))
    return rows.withColumn("pointer", pointer).drop("balance", "fails")


def _counted(ops: DataFrame, dedupe: bool, key: tuple[str, ...]) -> DataFrame:
    rows = accepted(ops, key) if dedupe else ops
    return rows.where(F.col("op").isin("load", "reload", "fire"))


def numbered_by_chunks(ops: DataFrame, span: int, dedupe: bool = True, key: tuple[str, ...] = KEY, lane: tuple[str, ...] = LANE) -> DataFrame:
    """What numbered() gives, for lanes too hot for one task: a lane is cut into chunks of span op_seq each.

    The balance, its least value and the counts are prefix sums and minima. Each chunk sums its own rows, a window over one row
    a chunk adds up what stands before each, and the rows of a chunk are finished from there. Only that window sees a lane whole.
    """
    fire = F.col("op") == "fire"
    rows = _counted(ops, dedupe, key).withColumn("_chunk", F.floor(F.col("op_seq") / span))
    inside = Window.partitionBy(*lane, "_chunk").orderBy("op_seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    # Cells are dealt once, and the sums of each meet its rows where they are.
    rows = rows.repartition(*lane, "_chunk")
    rows = rows.withColumn("_balance", F.sum(F.when(fire, -1).otherwise(1)).over(so_far)).withColumn("_low", F.min("_balance").over(so_far))
    rows = rows.withColumn("_fires", F.sum(fire.cast("long")).over(so_far)).withColumn("_writes", F.sum((~fire).cast("long")).over(so_far))
    cells = rows.groupBy(*lane, "_chunk").agg(F.sum(fire.cast("long")).alias("f"), F.sum((~fire).cast("long")).alias("w"), F.min("_low").alias("low"))
    before = Window.partitionBy(*lane).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_f0", F.coalesce(F.sum("f").over(before), F.lit(0))).withColumn("_w0", F.coalesce(F.sum("w").over(before), F.lit(0)))
    cells = cells.withColumn("_low0", F.least(F.lit(0), F.min(F.col("low") + F.col("_w0") - F.col("_f0")).over(before)))
    cell = [*lane, "_chunk"]
    cells = cells.select(*(F.col(c).alias(f"_of_{c}") for c in cell), "_f0", "_w0", F.coalesce("_low0", F.lit(0)).alias("_low0"))
    rows = rows.join(cells, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cell)))
    rows = rows.withColumn("_fails", -F.least(F.col("_low0"), F.col("_low") + F.col("_w0") - F.col("_f0")))
    rows = rows.withColumn("failed", fire & (F.col("_fails") > F.coalesce(F.lag("_fails").over(inside), -F.col("_low0"))))
    pointer = F.when(~fire, F.col("_w0") + F.col("_writes")).when(~F.col("failed"), F.col("_f0") + F.col("_fires") - F.col("_fails"))
    rows = rows.withColumn("pointer", pointer.cast("long"))
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def ledger(log: DataFrame, *carried: str, lane: tuple[str, ...] = LANE) -> DataFrame:
    """One row for each slot (queue_id, shard, pointer, data, load_seq, fire_seq) and each failed fire (pointer null), from
    numbered(), with carried columns of the write. A slot and its fire meet by a grouping that the lanes' partitioning serves, so
    nothing is shuffled again."""
    fire = F.col("op") == "fire"
    alone = F.when(F.col("failed"), F.col("op_seq"))
    of_write = lambda c, name: F.max(F.when(~fire, F.col(c))).alias(name)
    return log.groupBy(*lane, "pointer", alone.alias("alone")).agg(
        of_write("data", "data"), of_write("op_seq", "load_seq"), F.max(F.when(fire, F.col("op_seq"))).alias("fire_seq"), *(of_write(c, c) for c in carried)
    ).drop("alone")


def fired(log: DataFrame) -> DataFrame:
    """Every fire: op_seq, queue_id, shard, fire_pointer, data, load_seq, or the error of a fire on an empty lane."""
    error = F.when(F.col("pointer").isNull(), NOTHING_TO_FIRE)
    return ledger(log).where("fire_seq is not null").select(
        F.col("fire_seq").alias("op_seq"), *LANE, F.col("pointer").alias("fire_pointer"), "data", "load_seq", error.alias("error")
    )


def slots(log: DataFrame, *carried: str) -> DataFrame:
    """Slots as loads and reloads filled them: fired ones too, which stay readable until deleted."""
    return ledger(log, *carried).where("load_seq is not null")


def pending(log: DataFrame) -> DataFrame:
    return slots(log).where("fire_seq is null").drop("fire_seq")


def counters(log: DataFrame, *by: str) -> DataFrame:
    """load_counter, fire_counter, load_pointer, fire_pointer for each lane (or for by); reloads count a fire back."""
    count = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).cast("long")
    is_op = lambda op: F.col("op") == op
    good: Column = is_op("fire") & ~F.col("failed")
    return log.groupBy(*(by or LANE)).agg(
        count(is_op("load")).alias("load_counter"),
        (count(good) - count(is_op("reload"))).alias("fire_counter"),
        count(~is_op("fire")).alias("load_pointer"),
        count(good).alias("fire_pointer"),
    )
