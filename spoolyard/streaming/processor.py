"""Continuous replay: a stateful processor that holds the lanes of queues in Structured Streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import NOTHING_TO_FIRE
from ..operators.fold import OK, RESULT, SKIPPED
from ..shipping import ship


class QueueProcessor(StatefulProcessor):
    """State of one queue, in event time so that a replay gives the same: pointers by shard, slots by shard and pointer, and
    dedup entries by data, with their expiry. Fires look at their own shard, or at all with any_active.

    Expired slots and entries go in a sweep whenever event time has moved by a quarter of their time to live, so state holds
    what is live and that quarter. With metadata the rows are not results but, for each shard that a batch touched, its counters and
    pointers after the batch.
    """

    def __init__(self, ttl_us: int | None = None, any_active: bool = False, dedupe: bool = True, metadata: bool = False):
        self.ttl, self.any_active, self.dedupe, self.metadata = ttl_us, any_active, dedupe, metadata

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pointers = handle.getMapState("pointers", "shard int", "lp long, fp long")
        self.slots = handle.getMapState("slots", "shard int, pointer long", "data string, seq long, until long")
        self.seen = handle.getMapState("seen", "data string", "until long")
        self.counts = handle.getMapState("counts", "shard int", "lc long, fc long")
        self.swept = handle.getValueState("swept", "at long")

    def _count(self, shard: int, loads: int, fires: int) -> None:
        lc, fc = self.counts.getValue((shard,)) if self.counts.containsKey((shard,)) else (0, 0)
        self.counts.updateValue((shard,), (lc + loads, fc + fires))

    def _sweep(self, now: int) -> None:
        if self.ttl is None or (self.swept.exists() and now < self.swept.get()[0] + self.ttl // 4):
            return
        self.swept.update((now,))
        for state, at in ((self.slots, 2), (self.seen, 0)):
            for key in [k for k, v in state.iterator() if v[at] <= now]:
                state.removeKey(tuple(key))

    def _until(self, now: int) -> int:
        return (1 << 62) if self.ttl is None else now + self.ttl

    def _at(self, shard: int) -> tuple[int, int]:
        return self.pointers.getValue((shard,)) if self.pointers.containsKey((shard,)) else (0, 0)

    def _write(self, shard: int, data: str, seq: int, now: int) -> int:
        lp, fp = self._at(shard)
        self.pointers.updateValue((shard,), (lp + 1, fp))
        self.slots.updateValue((shard, lp + 1), (data, seq, self._until(now)))
        return lp + 1

    def _fire(self, shard: int, now: int):
        while True:
            lanes = [k[0] for k in self.pointers.keys()] if self.any_active else [shard]
            open_ = [(self._at(s)[1], s) for s in lanes if self._at(s)[0] > self._at(s)[1]]
            if not open_:
                return shard, None, None, None, NOTHING_TO_FIRE
            fp, s = min(open_)
            self.pointers.updateValue((s,), (self._at(s)[0], fp + 1))
            if self.slots.containsKey((s, fp + 1)):
                data, seq, until = self.slots.getValue((s, fp + 1))
                self.slots.removeKey((s, fp + 1))
                if now < until:
                    self._count(s, 0, 1)
                    return s, fp + 1, data, seq, OK

    def _apply(self, op: str, shard: int, data: str | None, pointer: int | None, seq: int, now: int):
        if op == "load" and self.dedupe:
            if self.seen.containsKey((data,)) and now < self.seen.getValue((data,))[0]:
                return shard, None, data, None, SKIPPED
            self.seen.updateValue((data,), (self._until(now),))
        if op in ("load", "reload"):
            self._count(shard, op == "load", -(op == "reload"))
            return shard, self._write(shard, data, seq, now), data, seq, OK
        if op == "delete":
            if self.slots.containsKey((shard, pointer)):
                self.slots.removeKey((shard, pointer))
            return shard, pointer, None, None, OK
        return self._fire(shard, now)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A batch's operations on one queue are put in order; order between batches is the source's.
        frame = pd.concat(list(rows)).sort_values("op_seq")
        out = []
        for r in frame.itertuples():
            shard = -1 if pd.isna(r.shard) else int(r.shard)
            pointer = None if pd.isna(r.pointer) else int(r.pointer)
            s, p, data, load_seq, result = self._apply(r.op, shard, r.data, pointer, int(r.op_seq), int(r.us))
            out.append((int(r.op_seq), key[0], r.op, None if s < 0 else s, p, data, load_seq, result))
        if len(frame):
            self._sweep(int(frame["us"].iloc[-1]))
        if self.metadata:
            touched = sorted({-1 if r[3] is None else r[3] for r in out})
            rows = [(key[0], None if s < 0 else s, *(self.counts.getValue((s,)) if self.counts.containsKey((s,)) else (0, 0)), *self._at(s)) for s in touched]
            yield pd.DataFrame(rows, columns=["queue_id", "shard", "load_counter", "fire_counter", "load_pointer", "fire_pointer"]).astype({"shard": "Int32"})
            return
        done = pd.DataFrame(out, columns=["op_seq", "queue_id", "op", "shard", "pointer", "data", "load_seq", "result"])
        yield done.astype({"shard": "Int32", "pointer": "Int64", "load_seq": "Int64"})

    def close(self) -> None:
        pass


METADATA = "queue_id string, shard int, load_counter long, fire_counter long, load_pointer long, fire_pointer long"


def replay_stream(ops: DataFrame, ttl_us: int | None = None, any_active: bool = False, dedupe: bool = True) -> DataFrame:
    """Results of a stream of operations, in append mode. Needs the RocksDB state store provider."""
    return _states(ops).transformWithStateInPandas(QueueProcessor(ttl_us, any_active, dedupe), RESULT, "Append", "none")


def metadata_stream(ops: DataFrame, ttl_us: int | None = None, any_active: bool = False, dedupe: bool = True) -> DataFrame:
    """Counters and pointers of every shard that a batch touched, after the batch; the latest row of a shard is its state."""
    return _states(ops).transformWithStateInPandas(QueueProcessor(ttl_us, any_active, dedupe, True), METADATA, "Append", "none")


def _states(ops: DataFrame):
    ship(ops.sparkSession)
    if "pointer" not in ops.columns:
        ops = ops.withColumn("pointer", F.lit(None).cast("long"))
    timed = ops.select("op_seq", "queue_id", "op", "shard", "pointer", "data", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("us"))
    return timed.groupBy("queue_id")
