"""Queues as objects: the scenarios of FIXTURES.md."""

import pytest

from spoolyard.api import Item, Queue, QueueRegistry
from spoolyard.config import GLOBAL, QueueConfig, check_shards
from spoolyard.errors import QueueError, wrap
from spoolyard.sources.store import LogStore


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "log"))


def totals(queue):
    rows = queue.get_metadata().values()
    return tuple(sum(r[n] for r in rows) for n in ("load_counter", "load_pointer", "fire_counter", "fire_pointer"))


def test_string_queue_with_dedup(store):
    q, other = (Queue(QueueConfig(i, shards=16), store) for i in ("five", "four"))
    assert totals(q) == (0, 0, 0, 0) and len(q.get_metadata()) == 16
    assert q.load("DATA1") and q.load("DATA1") and other.load("DATA1")
    assert totals(q) == (1, 1, 0, 0) and totals(other) == (1, 1, 0, 0)
    item = q.fire()
    assert (item.data, item.fire_pointer) == ("DATA1", 1) and totals(q) == (1, 1, 1, 1)
    assert q.peek({item.shard: {1}}) == {item}  # fired slots stay readable
    q.delete(item)
    assert q.peek({item.shard: {1}}) == set() and totals(q) == (1, 1, 1, 1)
    assert q.load("DATA1") and totals(q) == (1, 1, 1, 1)  # still known
    assert q.reload("DATA1") and totals(q) == (1, 2, 0, 1)


def test_peek_leaves_out_what_is_missing(store):
    q = Queue(QueueConfig("one", shards=16), store)
    values = store.spark.range(5).selectExpr("id", "concat('DATA', id) data")
    assert q.load_many(values, "id", "data") == (5, 0)
    shard = next(int(k.split("_")[1]) for k, m in q.get_metadata().items() if m["load_pointer"])
    found = q.peek({shard: {1}, 32: {10, 20}})
    assert len(found) == 1 and next(iter(found)).data.startswith("DATA")


def test_numbers(store):
    q = Queue(QueueConfig("two", "long", 16), store)
    q.load(12)
    assert q.fire().data == 12 and totals(q) == (1, 1, 1, 1)
    q.reload(12)
    assert totals(q)[:2] == (1, 2)
    q = Queue(QueueConfig("three", "int", 16), store)
    q.load(12)
    q.reload(12)
    assert totals(q) == (1, 2, -1, 0)
    for bad in ("12", True, None, 1 << 40):
        with pytest.raises(QueueError) as e:
            q.load(bad)
        assert e.value.code == "DATA_TYPE_MISMATCH"


def test_holes_and_expiry(store):
    now = [0]
    q = Queue(QueueConfig("h", shards=1, record_ttl=10), store, clock=lambda: now[0] * 1_000_000)
    with pytest.raises(QueueError) as e:
        q.fire()
    assert e.value.code == "NOTHING_TO_FIRE" and totals(q) == (0, 0, 0, 0)
    q.load("a")
    q.load("b")
    q.delete(Item("a", 1, None, "h"))
    assert q.fire() == Item("b", 2, None, "h") and totals(q) == (2, 2, 1, 2)
    now[0] = 9
    q.load("a")
    assert totals(q) == (2, 2, 1, 2)
    now[0] = 11  # the skipped load has not renewed the entry
    q.load("a")
    assert totals(q) == (3, 3, 1, 2)
    now[0] = 30
    with pytest.raises(QueueError):
        q.fire()
    assert totals(q) == (3, 3, 1, 3)
    assert list(q.get_metadata()) == ["SHARD_0"]


def test_clients_do_not_dedup_each_other(store):
    for client in "xy":
        Queue(QueueConfig("c", shards=1, client_id=client), store).load("a")
    assert totals(Queue(QueueConfig("c", shards=1), store)) == (2, 2, 0, 0)


def test_store_commits_and_compacts(store):
    q = Queue(QueueConfig("s", shards=2), store)
    values = store.spark.range(6).selectExpr("id", "cast(id % 4 as string) data")
    assert q.load_many(values, "id", "data") == (4, 2)
    assert [i.data for i in q.fire_many(3)] == ["0", "1", "2"]
    base = store.version()
    assert store.try_commit(base, None) and not store.try_commit(base, None)
    before = totals(q)
    store.compact()
    assert totals(q) == before == (4, 4, 3, 3)
    assert q.load("0") and totals(q) == before and q.fire().data == "3"


def test_registry_and_settings(store):
    registry = QueueRegistry()
    one, two = (Queue(QueueConfig(x, shards=2), store) for x in "ab")
    registry.refresh([one])
    registry.refresh([two])
    assert registry.get("a") is one and registry.get("b") is two
    with pytest.raises(QueueError) as e:
        registry.get("nobody")
    assert e.value.code == "QUEUE_NOT_FOUND"
    with pytest.raises(QueueError) as e:
        QueueConfig("g", scope=GLOBAL)
    assert e.value.code == "NOT_IMPLEMENTED"
    with pytest.raises(NotImplementedError):
        QueueConfig("g", backend="hbase")
    assert QueueConfig("n", shards=-3).shards == 1
    with pytest.raises(ValueError):
        QueueConfig(" ")
    assert check_shards(16, 32) == 32 and check_shards(None, 4) == 4
    for stored, configured in ((16, 8), (1, 4)):
        with pytest.raises(QueueError) as e:
            check_shards(stored, configured)
        assert e.value.code == "INVALID_SHARDS"
    with pytest.raises(QueueError):
        Queue(QueueConfig("a", shards=1), store)
    assert wrap(KeyError("x")).code == "INTERNAL_ERROR" and wrap(e.value) is e.value


def test_a_delete_is_of_what_was_there(store):
    q = Queue(QueueConfig("d", shards=1), store)
    q.delete(Item("x", 1, None, "d"))  # nothing there yet
    q.load("a")
    assert q.fire() == Item("a", 1, None, "d")
    q.delete(Item("a", 1, None, "d"))
    q.reload("a")
    assert q.fire() == Item("a", 2, None, "d") and totals(q) == (1, 2, 1, 2)


def test_torn_and_lost_commits(store, monkeypatch):
    q = Queue(QueueConfig("t", shards=1), store)
    with open(f"{store.path}/_commits/draft-left", "w") as f:
        f.write('{"vers')  # a writer that died
    assert q.load("a") and LogStore(store.spark, store.path).version() == store.version()
    base, tries, real = store.version(), [], store.try_commit

    def raced(at, rows, **more):
        tries.append(at)
        if len(tries) <= 2:
            assert real(at, None)  # somebody else is first
        return real(at, rows, **more)

    monkeypatch.setattr(store, "try_commit", raced)
    assert q.load("b") and tries == [base, base + 1, base + 2] and totals(q) == (2, 2, 0, 0)
    monkeypatch.setattr(store, "try_commit", lambda at, rows, **more: False)
    with pytest.raises(QueueError) as e:
        q.load("c")
    assert e.value.code == "RETRIES_EXHAUSTED"
    monkeypatch.setattr(store, "try_commit", lambda at, rows, **more: False)
    with pytest.raises(QueueError) as e:
        Queue(QueueConfig("late", shards=1), store)
    assert e.value.code == "ACTION_DENIED_PARALLEL_ATTEMPT"


def test_folders_are_merged(store, monkeypatch):
    from spoolyard.sources import store as module

    monkeypatch.setattr(module, "FAN", 3)
    q = Queue(QueueConfig("m", shards=2), store)
    for x in "abcdefg":
        q.load(x)
    assert [level for _, level in store.folders()] == [1, 1, 0] and totals(q) == (7, 7, 0, 0)
    assert sorted(i.data for i in q.fire_many(7)) == list("abcdefg")


def test_farms_are_apart(store):
    one, two = (Queue(QueueConfig("f", shards=1, farm_id=x), store) for x in ("east", None))
    one.load("x")
    two.load("x")
    assert totals(one) == totals(two) == (1, 1, 0, 0)
    one.fire()
    assert totals(one) == (1, 1, 1, 1) and totals(two) == (1, 1, 0, 0) and two.fire().data == "x"


def test_any_order_column_is_numbered_densely(store):
    q = Queue(QueueConfig("n", shards=4), store)
    q.load("first")
    values = store.spark.createDataFrame([(-400 + 4 * i, f"v{i % 7}") for i in range(8)], "at long, v string")
    assert q.load_many(values, "at", "v") == (7, 1)
    rows = store.rows().orderBy("op_seq").collect()
    assert [r.op_seq for r in rows] == list(range(1, 10)) and [r.data for r in rows][1:] == [f"v{i % 7}" for i in range(8)]
    assert {k: m["load_pointer"] for k, m in q.get_metadata().items()} == {f"SHARD_{s}": 2 for s in range(4)}


def test_errors_are_mapped(store, monkeypatch):
    q = Queue(QueueConfig("e", shards=1), store)

    def broken(*_):
        raise OSError("no route to the store")

    monkeypatch.setattr(store, "commits", broken)
    for operation in (q.get_metadata, q.fire, lambda: q.load("a"), lambda: q.peek({0: {1}})):
        with pytest.raises(QueueError) as e:
            operation()
        assert e.value.code == "CONNECTION_ERROR"
    monkeypatch.undo()
    monkeypatch.setattr(q, "clock", lambda: 1 // 0)
    with pytest.raises(QueueError) as e:
        q.load("a")
    assert e.value.code == "INTERNAL_ERROR"
    monkeypatch.undo()
    other = Queue(QueueConfig("gone", shards=1), store)
    monkeypatch.setattr(store, "settings", dict)
    with pytest.raises(QueueError) as e:
        other.fire()
    assert e.value.code == "QUEUE_UNPREPARED"


def test_metadata_expires_if_asked_for(store):
    now = [0]
    q = Queue(QueueConfig("x", shards=1, meta_ttl=10, record_ttl=-1, meta_expires=True), store, clock=lambda: now[0] * 1_000_000)
    q.load("a")
    now[0] = 9
    q.load("b")
    assert totals(q) == (2, 2, 0, 0)
    now[0] = 19
    assert totals(q) == (0, 0, 0, 0)
    q.load("c")
    assert totals(q) == (1, 1, 0, 0) and q.fire() == Item("c", 1, None, "x")  # the slot was written over
    kept = Queue(QueueConfig("y", shards=1, meta_ttl=10), store, clock=lambda: now[0] * 1_000_000)
    kept.load("a")
    now[0] = 99
    assert totals(kept) == (1, 1, 0, 0)
