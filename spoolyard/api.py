"""Queues as objects: load, reload, fire, delete, peek and metadata over a LogStore, one commit an operation or batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import TYPES, QueueConfig, check_shards
from .errors import ACTION_DENIED_PARALLEL_ATTEMPT, DATA_TYPE_MISMATCH, NOTHING_TO_FIRE, QUEUE_NOT_FOUND, QUEUE_UNPREPARED, QueueError, guarded
from .operators import views
from .sources.store import ROWS, LogStore

OK, SKIPPED, HOLE = "ok", "skipped", "hole"


@dataclass(frozen=True)
class Item:
    """What was fired or peeked; shard is None in an unsharded queue."""

    data: object
    fire_pointer: int
    shard: int | None
    queue_id: str


def dense(df: DataFrame, order: str, name: str | None = None) -> tuple[DataFrame, int]:
    """df with the places 0, 1, ... of its rows in the order of a unique long column, as that column or as another, and their number.

    Rows are sorted by ranges, so no task sees all; what comes to the driver is a count for each range. df should be persisted.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()).persist()
    part = F.shiftrightunsigned("_id", 33)
    sizes = {r.p: r.k for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("k")).collect()}
    heads, total = [], 0
    for p in sorted(sizes):
        heads.append((p, total))
        total += sizes[p]
    if not heads:
        return ranged.withColumn(name or order, F.col(order)).drop("_id"), 0
    base = F.create_map(*(F.lit(x) for row in heads for x in row))[part]
    return ranged.withColumn(name or order, (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + base).cast("long")).drop("_id"), total


class Queue:
    """A named queue of one type in a farm. State is what the committed log says; each commit sees all before it. Errors are QueueErrors."""

    @guarded
    def __init__(self, config: QueueConfig, store: LogStore, clock: Callable[[], int] = lambda: time.time_ns() // 1000):
        self.config, self.store, self.clock = config, store, clock
        stored = store.settings().get(self._key)
        shards = check_shards(stored, config.shards)
        if shards != stored and not store.try_commit(store.version(), None, put={self._key: shards}):
            raise QueueError(ACTION_DENIED_PARALLEL_ATTEMPT, "the queue is being opened elsewhere")

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @property
    def _key(self) -> str:
        return f"shards:{self.config.farm_id or ''}:{self.config.queue_id}"

    def _own(self, log: DataFrame) -> DataFrame:
        if self._key not in self.store.settings():
            raise QueueError(QUEUE_UNPREPARED, "the store does not know the queue")
        return log.where((F.col("queue_id") == self.config.queue_id) & F.col("farm_id").eqNullSafe(F.lit(self.config.farm_id)))

    def _current(self, log: DataFrame, now: int) -> DataFrame:
        """Own rows that counters and pointers are made of: all, or where they expire those since a shard was last idle for meta_ttl."""
        rows = self._own(log).where("op <> 'delete' and result <> 'skipped'")
        ttl = self.config.meta_ttl * 1_000_000
        if not self.config.meta_expires or ttl < 0:
            return rows
        after = Window.partitionBy("shard").orderBy(F.desc("op_seq"))
        idle = F.lag("ts_us", 1, now).over(after) - F.col("ts_us") >= ttl
        idle = F.max(idle.cast("int")).over(after.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("idle", idle).where("idle = 0").drop("idle")

    def _counters(self, log: DataFrame, now: int) -> DataFrame:
        op, ok = F.col("op"), F.col("result") == OK
        count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
        writes = op.isin("load", "reload") & ok
        return self._current(log, now).groupBy("queue_id", "shard").agg(
            count((op == "load") & ok).alias("load_counter"),
            (count((op == "fire") & ok) - count(op == "reload")).alias("fire_counter"),
            F.max(F.when(writes, F.col("pointer")).otherwise(0)).alias("load_pointer"),
            F.max(F.when(op == "fire", F.col("pointer")).otherwise(0)).alias("fire_pointer"),
        )

    def _slots(self, log: DataFrame, now: int) -> DataFrame:
        """Live slots, fired or not: the last write of each pointer, unless it was deleted after that or has expired."""
        own = self._own(log)
        wrote = F.col("op").isin("load", "reload") & (F.col("result") == OK)
        last = own.where(wrote | (F.col("op") == "delete")).groupBy("queue_id", "shard", "pointer")
        slots = last.agg(F.max_by(F.struct("op", "data", "ts_us"), "op_seq").alias("last")).where("last.op <> 'delete'")
        if self.config.record_ttl >= 0:
            slots = slots.where(F.col("last.ts_us") + self.config.record_ttl * 1_000_000 > now)
        return slots.select("queue_id", "shard", "pointer", F.col("last.data").alias("data"))

    def _pending(self, log: DataFrame, now: int) -> DataFrame:
        done = self._counters(log, now).select(F.col("shard").alias("of"), "fire_pointer")
        slots = self._slots(log, now)
        joined = slots.join(F.broadcast(done), slots["shard"].eqNullSafe(done["of"]))  # a row a shard
        return joined.where("pointer > fire_pointer").drop("of", "fire_pointer")

    def _check(self, data: object) -> None:
        if not self.config.accepts(data):
            raise QueueError(DATA_TYPE_MISMATCH, f"expected {self.config.data_type}, got {type(data).__name__}")

    def _append(self, values: DataFrame, op: str) -> tuple[int, int]:
        """Commit rows (n long, data string) in the order of n; how many were written and how many skipped."""
        ordered, total = dense(values.persist(), "n")
        ordered = ordered.persist()

        def make(version: int, log: DataFrame):
            now, own = self.clock(), self._own(log)
            seq = (log.agg(F.max("op_seq")).first()[0] or 0) + 1
            rows, n_rows, skipped = ordered.withColumn("k", F.col("n")), total, None
            if op == "load" and self.config.dedupe:
                known = own.where((F.col("op") == "load") & (F.col("result") == OK) & (F.col("client_id") == self.config.client_id))
                if self.config.record_ttl >= 0:
                    known = known.where(F.col("ts_us") + self.config.record_ttl * 1_000_000 > now)
                firsts = ordered.groupBy("data").agg(F.min("n").alias("n")).join(known.select("data").distinct(), "data", "left_anti").select("n")
                places, n_rows = dense(firsts, "n", "k")
                rows = ordered.join(places, "n")
                skipped = ordered.join(firsts, "n", "left_anti").withColumn("result", F.lit(SKIPPED))
            before, shards = own.where("result = 'ok' and op in ('load', 'reload')").count(), self.config.shards
            shard = F.pmod(F.col("k") + before, F.lit(shards)).cast("int") if self.config.sharded else F.lit(None).cast("int")
            tops = F.broadcast(self._counters(log, now).select(F.col("shard").alias("of"), "load_pointer"))  # a row a shard
            rows = rows.withColumn("shard", shard)
            rows = rows.join(tops, rows["shard"].eqNullSafe(F.col("of")), "left")
            # Shards are dealt in turn, so a row's place in its shard needs no window.
            rows = rows.withColumn("pointer", F.floor(F.col("k") / shards) + 1 + F.coalesce("load_pointer", F.lit(0))).withColumn("result", F.lit(OK))
            if skipped is not None:
                rows = rows.unionByName(skipped, allowMissingColumns=True)
            out = self._rows(rows.withColumn("op", F.lit(op)).withColumn("op_seq", F.col("n") + seq), now)
            return out if total else None, (n_rows, total - n_rows)

        try:
            return self.store.commit(make)
        finally:
            ordered.unpersist()
            values.unpersist()

    def _rows(self, df: DataFrame, now: int) -> DataFrame:
        full = df.withColumns({"ts_us": F.lit(now), "farm_id": F.lit(self.config.farm_id), "queue_id": F.lit(self.config.queue_id), "client_id": F.lit(self.config.client_id)})
        return full.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in ROWS.split(", ")))

    def _one(self, data: object) -> DataFrame:
        return self.spark.createDataFrame([(0, str(data))], "n long, data string")

    @guarded
    def load(self, data: object) -> bool:
        """True also for a duplicate, which changes nothing."""
        self._check(data)
        self._append(self._one(data), "load")
        return True

    @guarded
    def reload(self, data: object) -> bool:
        """Back at the end of the queue, whether it is known or not; a fire is counted back."""
        self._check(data)
        self._append(self._one(data), "reload")
        return True

    @guarded
    def load_many(self, values: DataFrame, order: str, data: str, op: str = "load") -> tuple[int, int]:
        """Load (or reload) a whole DataFrame in one commit, in the order of a unique column: (written, skipped). Values must have
        the queue's type; they stay distributed."""
        kind = {"string": "string", "json": "string", "long": "bigint", "int": "int"}[self.config.data_type]
        if dict(values.dtypes)[data] != kind or not values.where(F.col(data).isNull()).isEmpty():
            raise QueueError(DATA_TYPE_MISMATCH, f"expected {kind} without nulls")
        return self._append(values.select(F.col(order).cast("long").alias("n"), F.col(data).cast("string").alias("data")), op)

    @guarded
    def fire_many(self, k: int) -> list[Item]:
        """The next k items at most, oldest first in each shard; slots deleted or expired before them are passed over."""

        def make(version: int, log: DataFrame):
            now, own = self.clock(), self._own(log)
            seq = log.agg(F.max("op_seq")).first()[0] or 0
            taken = views.drain(self._pending(log, now), k).collect()  # k rows at most
            last: dict = {}
            rows = []
            for r in taken:
                rows.append((seq + r.turn, "fire", r.shard, r.fire_pointer, r.data, OK))
                last[r.shard] = r.fire_pointer
            if len(taken) < k:  # all that is left of any shard is holes, which firing consumes
                for c in self._counters(log, now).where("load_pointer > fire_pointer").collect():
                    if last.get(c.shard, c.fire_pointer) < c.load_pointer:
                        rows.append((seq + len(rows) + 1, "fire", c.shard, c.load_pointer, None, HOLE))
            if not rows:
                return None, []
            df = self.spark.createDataFrame(rows, "op_seq long, op string, shard int, pointer long, data string, result string")
            return self._rows(df, now), [self._item(r.data, r.fire_pointer, r.shard) for r in taken]

        return self.store.commit(make)

    def _item(self, data: str, pointer: int, shard: int | None) -> Item:
        return Item(TYPES[self.config.data_type](data), pointer, shard, self.config.queue_id)

    @guarded
    def fire(self) -> Item:
        items = self.fire_many(1)
        if not items:
            raise QueueError(NOTHING_TO_FIRE, "Nothing to fire")
        return items[0]

    @guarded
    def delete(self, item: Item) -> None:
        """Remove the item's slot; one that is not there is no error."""

        def make(version: int, log: DataFrame):
            seq = log.agg(F.max("op_seq")).first()[0] or 0
            self._own(log)
            df = self.spark.createDataFrame([(seq + 1, "delete", item.shard, item.fire_pointer, None, OK)], "op_seq long, op string, shard int, pointer long, data string, result string")
            return self._rows(df, self.clock()), None

        self.store.commit(make)

    @guarded
    def peek(self, pointers: Mapping[int | None, set[int]]) -> set[Item]:
        """The live items at these pointers of these shards; others are left out. An unsharded queue's shard is 0 or None."""
        flat = [(-1 if s is None else s, sorted(p)) for s, p in pointers.items() if p]
        if not flat:
            return set()
        wanted = self.spark.createDataFrame([(self.config.queue_id, dict(flat))], "queue_id string, pointers map<int, array<long>>")
        slots = self._slots(self.store.rows(), self.clock())
        return {self._item(r.data, r.fire_pointer, r.shard) for r in views.peek(slots, wanted).collect()}

    @guarded
    def get_metadata(self) -> dict[str, dict[str, int]]:
        """SHARD_i: fire_counter, load_counter, fire_pointer, load_pointer; zeros for shards without a trace."""
        queues = self.spark.createDataFrame([(self.config.queue_id, self.config.shards)], "queue_id string, shards int")
        rows = views.metadata(self._counters(self.store.rows(), self.clock()), queues).collect()
        return {r.shard_key: {n: r[n] for n in views.NUMBERS} for r in rows}


class QueueRegistry:
    def __init__(self) -> None:
        self._queues: dict[str, Queue] = {}

    def refresh(self, queues: list[Queue]) -> None:
        """Put these queues, over those of the same id; others stay."""
        self._queues |= {q.config.queue_id: q for q in queues}

    def get(self, queue_id: str) -> Queue:
        if queue_id not in self._queues:
            raise QueueError(QUEUE_NOT_FOUND, f"Queue not found for identifier {queue_id}")
        return self._queues[queue_id]
