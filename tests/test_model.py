"""The sequential model, the windows, the folds and the stream agree."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spoolyard.operators import dedup, fold, replay
from spoolyard.streaming.processor import metadata_stream, replay_stream

SCHEMA = "op_seq long, ts timestamp_ntz, queue_id string, op string, shard int, pointer long, data string"
START = datetime.datetime(2024, 1, 1)

step = st.tuples(st.sampled_from(["load", "load", "reload", "fire", "fire", "delete"]), st.integers(0, 1), st.sampled_from("abcd"), st.integers(1, 4))
some = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def log_of(spark, steps, shards=2, holes=True):
    rows = [
        (i, START + datetime.timedelta(seconds=i), "q", op, s if shards > 1 else None, p if op == "delete" else None, d)
        for i, (op, s, d, p) in enumerate(steps)
        if holes or op != "delete"
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def expected(rows, **options):
    model = fold.QueueModel(**options)
    out = []
    for seq, ts, q, op, shard, pointer, data in rows:
        us = int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
        out.append((seq, q, op, *model.apply(op, shard, data, pointer, seq, us)))
    return out


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@some
@given(st.lists(step, max_size=40))
def test_fold_is_the_model(spark, steps):
    rows, ops = log_of(spark, steps)
    assert collected(fold.run(ops)) == expected(rows)
    assert collected(fold.run(ops, any_active=True, ttl_us=5_000_000)) == expected(rows, any_active=True, ttl_us=5_000_000)


@some
@given(st.lists(step, max_size=40))
def test_windows_are_the_model_without_holes(spark, steps):
    rows, ops = log_of(spark, steps, holes=False)
    model = [(s, q, sh, p, d if p else None, ls, r if r != "ok" else None) for s, q, op, sh, p, d, ls, r in expected(rows) if op == "fire"]
    assert collected(replay.fired(replay.numbered(ops))) == sorted(model, key=lambda r: r[0])
    counts = {tuple(r)[:2]: tuple(r)[2:] for r in replay.counters(replay.numbered(ops)).collect()}
    state = fold.QueueModel()
    for seq, _, _, op, shard, pointer, data in rows:
        state.apply(op, shard, data, pointer, seq)
    for (_, s), got in counts.items():
        assert got == tuple(x.get(s, 0) for x in (state.lc, state.fc, state.lp, state.fp))
        assert got[0] - got[1] == got[2] - got[3] >= 0


@some
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 3)), max_size=30))
def test_dedup_with_ttl(spark, steps):
    at, rows = 0, []
    for i, (data, gap) in enumerate(steps):
        at += gap
        rows.append((i, START + datetime.timedelta(seconds=at), "q", "load", None, None, data))
    last, want = {}, []
    for i, ts, _, _, _, _, data in rows:
        if data not in last or ts >= last[data] + datetime.timedelta(seconds=4):
            last[data] = ts
            want.append(i)
    got = dedup.accepted_within(spark.createDataFrame(rows, SCHEMA), 4_000_000)
    assert sorted(r.op_seq for r in got.collect()) == want


def test_stream_restarts_and_is_the_model(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    steps = [("load", i % 2, d, 1) for i, d in enumerate("abcabde")] + [("delete", 0, "", 2), ("fire", 0, "", 1), ("fire", 0, "", 1), ("reload", 1, "a", 1), ("fire", 1, "", 1), ("fire", 0, "", 1)] * 2
    rows, ops = log_of(spark, steps)
    half = len(rows) // 2
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        run = replay_stream(stream, any_active=True).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state)
        run.trigger(availableNow=True).start().awaitTermination()
    assert collected(spark.read.parquet(sink)) == expected(rows, any_active=True)


def test_stream_expires_and_tells_its_metadata(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    steps = [("load", 0, d, 1) for d in "abca"] + [("fire", 0, "", 1)] * 2 + [("reload", 1, "z", 1), ("load", 0, "a", 1), ("load", 1, "c", 1), ("fire", 0, "", 1), ("fire", 0, "", 1), ("load", 0, "a", 1)]
    rows, ops = log_of(spark, steps)
    state = {}
    for dedupe in (True, False):
        source, sink, at = (str(tmp_path / f"{x}{dedupe}") for x in ("in", "out", "state"))
        for part in (rows[:7], rows[7:]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        for name, f in (("replay", replay_stream), ("meta", metadata_stream)):
            run = f(stream, ttl_us=4_000_000, dedupe=dedupe).writeStream.format("parquet").option("path", sink + name).option("checkpointLocation", at + name)
            run.trigger(availableNow=True).start().awaitTermination()
        assert collected(spark.read.parquet(sink + "replay")) == expected(rows, dedupe=dedupe, ttl_us=4_000_000)
        model = fold.QueueModel(dedupe=dedupe, ttl_us=4_000_000)
        for seq, ts, _, op, shard, pointer, data in rows:
            model.apply(op, shard, data, pointer, seq, int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6))
        state = {r.shard: tuple(r)[2:] for r in sorted(spark.read.parquet(sink + "meta").collect(), key=lambda r: r.load_pointer + r.fire_pointer)}
        assert state == {s: tuple(x.get(s, 0) for x in (model.lc, model.fc, model.lp, model.fp)) for s in (0, 1)}
