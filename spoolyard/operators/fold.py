"""Exact folds: logs with deletes and expiry (holes), time-limited dedup, and fires that try every shard of a queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import INVALID_SHARDS, NOTHING_TO_FIRE
from ..shipping import ship

RESULT = "op_seq long, queue_id string, op string, shard int, pointer long, data string, load_seq long, result string"
OK, SKIPPED = "ok", "skipped"


class QueueModel:
    """One queue (or one lane of it), operation by operation: the definition that all replays are tested against.

    Slots that have fired stay readable until deleted or expired, but the model forgets them: no later operation's result
    depends on them. So memory holds the backlog and the live dedup entries.
    """

    def __init__(self, dedupe: bool = True, ttl_us: int | None = None, any_active: bool = False):
        self.dedupe, self.ttl, self.any_active = dedupe, ttl_us, any_active
        self.lp: dict = {}
        self.fp: dict = {}
        self.lc: dict = {}
        self.fc: dict = {}
        self.slots: dict = {}
        self.seen: dict = {}

    def _write(self, shard, data, seq, now) -> int:
        p = self.lp[shard] = self.lp.get(shard, 0) + 1
        self.slots.setdefault(shard, {})[p] = (data, seq, None if self.ttl is None else now + self.ttl)
        return p

    def load(self, shard, data, seq, now=0):
        if self.dedupe and data in self.seen and (self.seen[data] is None or now < self.seen[data]):
            return None, SKIPPED
        p = self._write(shard, data, seq, now)
        self.lc[shard] = self.lc.get(shard, 0) + 1
        if self.dedupe:
            self.seen[data] = None if self.ttl is None else now + self.ttl
        return p, OK

    def reload(self, shard, data, seq, now=0):
        p = self._write(shard, data, seq, now)
        self.fc[shard] = self.fc.get(shard, 0) - 1
        return p, OK

    def delete(self, shard, pointer):
        self.slots.get(shard, {}).pop(pointer, None)
        return pointer, OK

    def fire(self, shard, now=0):
        """(shard, pointer, data, load_seq, result). A hole consumes a pointer and no count, and the next slot is tried."""
        while True:
            lanes = [s for s in (self.lp if self.any_active else [shard]) if self.lp.get(s, 0) > self.fp.get(s, 0)]
            if not lanes:
                return shard, None, None, None, NOTHING_TO_FIRE
            s = min(lanes, key=lambda x: (self.fp.get(x, 0), -1 if x is None else x))
            p = self.fp[s] = self.fp.get(s, 0) + 1
            slot = self.slots[s].pop(p, None)
            if slot and (slot[2] is None or now < slot[2]):
                self.fc[s] = self.fc.get(s, 0) + 1
                return s, p, slot[0], slot[1], OK

    def apply(self, op, shard, data, pointer, seq, now=0):
        """The result columns of one operation: shard, pointer, data, load_seq, result."""
        if op == "load":
            p, result = self.load(shard, data, seq, now)
            return shard, p, data, seq if result == OK else None, result
        if op == "reload":
            return shard, self.reload(shard, data, seq, now)[0], data, seq, OK
        if op == "delete":
            return shard, self.delete(shard, pointer)[0], None, None, OK
        return self.fire(shard, now)


def run(ops: DataFrame, shards: int = 1, dedupe: bool = True, ttl_us: int | None = None, any_active: bool = False) -> DataFrame:
    """The result of every operation, by QueueModel.

    Rows are dealt by queue, sorted, and streamed: a queue's operations depend on each other, so a queue is the unit of
    parallelism, and no more of it is in memory than its backlog and dedup entries. A fire in a lane does not look at
    other lanes unless any_active; dedup entries belong to the queue.
    """
    if "pointer" not in ops.columns:
        ops = ops.withColumn("pointer", F.lit(None).cast("long"))
    ship(ops.sparkSession)
    timed = ops.select("op_seq", "queue_id", "op", "shard", "pointer", "data", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("us"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, model = None, None
        for frame in frames:
            out = []
            shard = frame["shard"].astype("Int64")
            pointer = frame["pointer"].astype("Int64")
            for seq, q, op, s, p, data, us in zip(frame["op_seq"], frame["queue_id"], frame["op"], shard, pointer, frame["data"], frame["us"], strict=True):
                if model is None or q != now:
                    now, model = q, QueueModel(dedupe, ttl_us, any_active)
                s = None if pd.isna(s) else int(s)
                out.append((seq, q, op, *model.apply(op, s, data, None if pd.isna(p) else int(p), seq, us)))
            names = ["op_seq", "queue_id", "op", "shard", "pointer", "data", "load_seq", "result"]
            done = pd.DataFrame(out, columns=names)
            yield done.astype({"shard": "Int32", "pointer": "Int64", "load_seq": "Int64"})

    return timed.repartition("queue_id").sortWithinPartitions("queue_id", "op_seq").mapInPandas(scan, RESULT)


def shard_rules(pairs: DataFrame) -> DataFrame:
    """For rows (stored, configured): the error code of opening the queue so, or the count that is stored then."""
    bad = (F.col("stored") > F.col("configured")) | ((F.col("stored") <= 1) & (F.col("configured") > 1))
    return pairs.select("stored", "configured", F.when(bad, INVALID_SHARDS).alias("error_code"), F.when(~bad, F.greatest("stored", "configured")).alias("result"))
