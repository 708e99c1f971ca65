"""Catalog of queue queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import dedup, fold, replay, views
from ..sources import oplog

SHARDS, LANES = 4, 16
DAY_US = 86_400_000_000
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def events(spark: SparkSession, sf_dir: str, shards: int = 1) -> DataFrame:
    return oplog.from_events(oplog.table(spark, sf_dir, "events"), shards)


def log(spark: SparkSession, sf_dir: str, shards: int = 1, dedupe: bool = True) -> DataFrame:
    return replay.numbered(events(spark, sf_dir, shards), dedupe)


def five_queues(spark: SparkSession, shards: int) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("Q"), F.col("id").cast("string")).alias("queue_id"), F.lit(shards).alias("shards"))


def ops_sql(sharded: bool) -> str:
    return f"""
ops as (
  select event_id as op_seq, ts, 'Q' || (user_id % 5)::varchar as queue_id,
    {'(event_id % 4)::int' if sharded else 'null::int'} as shard,
    case when event_type in ('signup', 'view') then 'load' when event_type = 'click' then 'reload' else 'fire' end as op,
    event_type || '_' || props as data
  from events)"""


def log_sql(sharded: bool, dedupe: bool = True) -> str:
    lane = "queue_id, shard"
    return f"""with {ops_sql(sharded)},
acc as (
  select * from (select *, row_number() over (partition by queue_id, op, data order by op_seq) as rn from ops)
  where {"op <> 'load' or rn = 1" if dedupe else "true"}),
s as (
  select *, sum(case when op = 'fire' then -1 else 1 end) over w as bal, sum((op <> 'fire')::int) over w as lp
  from acc window w as (partition by {lane} order by op_seq rows between unbounded preceding and current row)),
f as (
  select *, greatest(0, -min(bal) over w) as fails
  from s window w as (partition by {lane} order by op_seq rows between unbounded preceding and current row)),
g as (
  select *, op = 'fire' and fails > coalesce(lag(fails) over (partition by {lane} order by op_seq), 0) as failed from f),
lg as (
  select *, case when op <> 'fire' then lp
    when not failed then sum((op = 'fire' and not failed)::int) over w end::bigint as p
  from g window w as (partition by {lane} order by op_seq rows between unbounded preceding and current row)),
slots as (
  select a.queue_id, a.shard, a.p as pointer, a.data, a.op_seq as load_seq, b.op_seq as fire_seq
  from lg a left join lg b on b.op = 'fire' and a.queue_id = b.queue_id and a.shard is not distinct from b.shard and a.p = b.p
  where a.op <> 'fire'),
meta as (
  select q.queue_id, 'SHARD_' || s.shard as shard_key,
    coalesce(fc, 0)::bigint as fire_counter, coalesce(lc, 0)::bigint as load_counter,
    coalesce(fp, 0)::bigint as fire_pointer, coalesce(lp, 0)::bigint as load_pointer
  from (select 'Q' || i::varchar as queue_id from range(5) r(i)) q
  cross join (select i as shard from range({SHARDS if sharded else 1}) r(i)) s
  left join (
    select queue_id, coalesce(shard, 0) as shard, sum((op = 'load')::int) as lc, sum((op <> 'fire')::int) as lp,
      sum((op = 'fire' and not failed)::int) as fp,
      sum((op = 'fire' and not failed)::int) - sum((op = 'reload')::int) as fc
    from lg group by all) m on q.queue_id = m.queue_id and s.shard = m.shard)
"""


FIRED = """select f.op_seq, f.queue_id, f.shard, f.p as fire_pointer, s.data, s.load_seq,
  case when f.failed then 'NOTHING_TO_FIRE' end as error
from lg f left join slots s on s.fire_seq = f.op_seq where f.op = 'fire'"""


@query(log_sql(False) + FIRED)
def queue_fire_replay(spark, sf_dir):
    return replay.fired(log(spark, sf_dir))


@query(log_sql(True) + FIRED)
def queue_fire_replay_sharded(spark, sf_dir):
    return replay.fired(log(spark, sf_dir, SHARDS))


@query(log_sql(True) + "select queue_id, shard, pointer, data, load_seq, fire_seq from slots")
def queue_load_slots(spark, sf_dir):
    return replay.slots(log(spark, sf_dir, SHARDS))


@query(log_sql(True) + "select queue_id, shard, pointer, data, load_seq from slots where fire_seq is null")
def queue_pending_slots(spark, sf_dir):
    return replay.pending(log(spark, sf_dir, SHARDS))


@query(f"with {ops_sql(False)} select min(op_seq) as op_seq, queue_id, data from ops where op = 'load' group by all")
def queue_load_dedup(spark, sf_dir):
    return dedup.accepted(events(spark, sf_dir).where("op = 'load'")).select("op_seq", "queue_id", "data")


@query(
    f"with {ops_sql(False)} select op_seq, queue_id, data, op_seq <> min(op_seq) over (partition by queue_id, data) as skipped "
    "from ops where op = 'load'"
)
def queue_load_results(spark, sf_dir):
    return dedup.results(events(spark, sf_dir).where("op = 'load'")).select("op_seq", "queue_id", "data", "skipped")


SCOPED = """select event_id as op_seq, 'F' || (event_id % 2)::varchar as farm_id, 'C' || (user_id % 3)::varchar as client_id,
    'Q' || (user_id % 5)::varchar as queue_id, (event_id % 4)::int as shard,
    case when event_type in ('signup', 'view') then 'load' when event_type = 'click' then 'reload' else 'fire' end as op,
    event_type || '_' || props as data
  from events"""
SCOPE, FARM_LANE = ("farm_id", "client_id", "queue_id", "data"), ("farm_id", "queue_id", "shard")


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of two farms and three clients: slots are a farm's, dedup entries a client's in it."""
    table = oplog.table(spark, sf_dir, "events")
    who = table.select(F.col("event_id").alias("op_seq"), F.concat(F.lit("F"), (F.col("event_id") % 2).cast("string")).alias("farm_id"), F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("client_id"))
    return oplog.from_events(table, SHARDS).join(who, "op_seq")


@query(f"with ops as ({SCOPED}) select min(op_seq) as op_seq, farm_id, client_id, queue_id, data from ops where op = 'load' group by all")
def queue_load_dedup_scoped(spark, sf_dir):
    return dedup.accepted(scoped(spark, sf_dir).where("op = 'load'"), SCOPE).select("op_seq", *SCOPE)


@query(f"""with ops as ({SCOPED}),
acc as (
  select * from (select *, row_number() over (partition by farm_id, client_id, queue_id, op, data order by op_seq) as rn from ops)
  where op <> 'load' or rn = 1),
s as (select *, sum(case when op = 'fire' then -1 else 1 end) over (partition by farm_id, queue_id, shard order by op_seq) as bal from acc)
select farm_id, queue_id, shard, sum((op = 'load')::int)::bigint as load_counter,
  (sum((op = 'fire')::int) - greatest(0, -min(bal)) - sum((op = 'reload')::int))::bigint as fire_counter,
  sum((op <> 'fire')::int)::bigint as load_pointer, (sum((op = 'fire')::int) - greatest(0, -min(bal)))::bigint as fire_pointer
from s group by all""")
def queue_counters_by_farm(spark, sf_dir):
    return replay.counters(replay.numbered(scoped(spark, sf_dir), key=SCOPE, lane=FARM_LANE), *FARM_LANE)


@query(log_sql(False) + FIRED)
def queue_fire_replay_chunked(spark, sf_dir):
    """The unsharded queues again, each cut into many tasks."""
    return replay.fired(replay.numbered_by_chunks(events(spark, sf_dir), 500))


@query("""with recursive l as (
  select event_id as op_seq, 'Q' || (user_id % 5)::varchar as queue_id, event_type || '_' || props as data, epoch_us(ts) as us,
    row_number() over (partition by user_id % 5, event_type || '_' || props order by event_id) as k
  from events),
r as (
  select queue_id, data, k, op_seq, us as anchor, true as ok from l where k = 1
  union all
  select l.queue_id, l.data, l.k, l.op_seq, case when l.us >= r.anchor + 86400000000 then l.us else r.anchor end,
    l.us >= r.anchor + 86400000000
  from r join l on l.queue_id = r.queue_id and l.data = r.data and l.k = r.k + 1)
select op_seq, queue_id, data from r where ok""")
def queue_load_dedup_ttl(spark, sf_dir):
    loads = events(spark, sf_dir).withColumn("op", F.lit("load"))
    return dedup.accepted_within(loads, DAY_US).select("op_seq", "queue_id", "data")


@query("select text as data, min(doc_id) as op_seq, count(*) as loads from documents group by text")
def documents_dedup(spark, sf_dir):
    docs = oplog.from_table(oplog.table(spark, sf_dir, "documents"), "doc_id", F.lit("docs"), F.col("text"))
    loads = dedup.results(docs, ("queue_id", "data"))
    return loads.groupBy("data").agg(F.min(F.when(~F.col("skipped"), F.col("op_seq"))).alias("op_seq"), F.count("*").alias("loads"))


@query(log_sql(True) + "select * from meta")
def queue_metadata(spark, sf_dir):
    return views.metadata(replay.counters(log(spark, sf_dir, SHARDS)), five_queues(spark, SHARDS))


@query(log_sql(False) + "select * from meta")
def queue_metadata_unsharded(spark, sf_dir):
    return views.metadata(replay.counters(log(spark, sf_dir)), five_queues(spark, 1))


@query(log_sql(True, False) + "select * from meta")
def queue_metadata_without_dedup(spark, sf_dir):
    return views.metadata(replay.counters(log(spark, sf_dir, SHARDS, False)), five_queues(spark, SHARDS))


@query(
    log_sql(True) + "select queue_id, sum(fire_counter)::bigint as fire_counter, sum(load_counter)::bigint as load_counter, "
    "sum(fire_pointer)::bigint as fire_pointer, sum(load_pointer)::bigint as load_pointer from meta group by queue_id"
)
def queue_metadata_total(spark, sf_dir):
    return views.totals(queue_metadata(spark, sf_dir))


@query(log_sql(True) + "select *, load_pointer - fire_pointer as pending from meta")
def queue_pending(spark, sf_dir):
    return views.backlog(queue_metadata(spark, sf_dir))


@query(log_sql(True) + "select * from meta where load_counter > fire_counter and load_pointer > fire_pointer")
def queue_active_shards(spark, sf_dir):
    return views.active(queue_metadata(spark, sf_dir))


@query(
    f"with {ops_sql(True)} select queue_id, shard, -count(*) as fire_counter, count(*) as load_pointer "
    "from ops where op = 'reload' group by all"
)
def queue_reload_counters(spark, sf_dir):
    only = replay.numbered(events(spark, sf_dir, SHARDS).where("op = 'reload'"))
    return replay.counters(only).select("queue_id", "shard", "fire_counter", "load_pointer")


@query(
    log_sql(True) + """select queue_id, turn, shard, pointer as fire_pointer, data from (
  select *, row_number() over (partition by queue_id order by rank, shard) as turn from (
    select *, row_number() over (partition by queue_id, shard order by pointer) as rank from slots where fire_seq is null))
where turn <= 10"""
)
def queue_drain_k(spark, sf_dir):
    return views.drain(replay.pending(log(spark, sf_dir, SHARDS)), 10)


@query(
    log_sql(True) + "select queue_id, shard, pointer as fire_pointer, data from slots "
    "where (shard in (0, 2) and pointer in (1, 5, 10, 1000000))"
)
def queue_peek(spark, sf_dir):
    wanted = "map(0, array(1L, 5L, 10L, 1000000L), 2, array(1L, 5L, 10L, 10L), 32, array(10L, 20L))"
    requests = five_queues(spark, SHARDS).select("queue_id", F.expr(wanted).alias("pointers"))
    return views.peek(replay.slots(log(spark, sf_dir, SHARDS)), requests)


@query(log_sql(True) + "select queue_id, shard, pointer, data from slots where fire_seq is null")
def queue_delete_live_slots(spark, sf_dir):
    """Everything fired is deleted."""
    ledger = replay.slots(log(spark, sf_dir, SHARDS))
    deleted = ledger.where("fire_seq is not null").select("queue_id", "shard", "pointer")
    return views.without(ledger.select("queue_id", "shard", "pointer", "data"), deleted)


@query(
    log_sql(True) + "select s.queue_id, s.shard, s.pointer, s.data from slots s join events e on e.event_id = s.load_seq "
    "where e.ts + interval 2592000 second > (select max(ts) from events)"
)
def queue_live_as_of(spark, sf_dir):
    table = oplog.table(spark, sf_dir, "events")
    at = table.agg(F.max("ts")).first()[0]
    ledger = replay.slots(log(spark, sf_dir, SHARDS), "ts")
    return views.live(ledger, F.col("ts"), 2_592_000, F.lit(at).cast("timestamp_ntz")).select("queue_id", "shard", "pointer", "data")


@query(
    log_sql(True) + "select queue_id || '_SHARD_' || shard || '_' || pointer as sharded, queue_id || '_' || pointer as plain, "
    "queue_id || data as dedup, load_seq from slots"
)
def queue_slot_keys(spark, sf_dir):
    q, p = F.col("queue_id"), F.col("pointer")
    return replay.slots(log(spark, sf_dir, SHARDS)).select(
        keys.slot_key(q, F.col("shard"), p).alias("sharded"), keys.slot_key(q, F.lit(None), p).alias("plain"),
        keys.dedup_key(q, F.col("data")).alias("dedup"), "load_seq",
    )


@query("""select 'Q' || i || '_SHARD_' || s || '_POINTERS' as pointers, 'Q' || i || '_SHARD_' || s || '_COUNTERS' as counters,
  'Q' || i || '_POINTERS' as plain, 'Q' || i || '_SHARDS' as shards, 'farm_data' as local_set, 'data' as bare_set
from range(5) a(i) cross join range(4) b(s)""")
def queue_meta_keys(spark, sf_dir):
    rows = five_queues(spark, SHARDS).select("queue_id", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    q, s, farm, data = F.col("queue_id"), F.col("shard"), F.lit("farm"), F.lit("data")
    return rows.select(
        keys.meta_key(q, s, "POINTERS").alias("pointers"), keys.meta_key(q, s, "COUNTERS").alias("counters"),
        keys.meta_key(q, F.lit(None), "POINTERS").alias("plain"), keys.shards_key(q).alias("shards"),
        keys.set_name(farm, data).alias("local_set"), keys.set_name(F.lit(None), data).alias("bare_set"),
    )


@query(f"""with {ops_sql(False)}
select op_seq, queue_id, op, 'QUEUE_NOT_FOUND' as error_code, 'Queue not found for identifier ' || queue_id as message
from ops where queue_id not in ('Q0', 'Q1', 'Q2')""")
def queue_unknown_rejects(spark, sf_dir):
    return oplog.unknown_queues(events(spark, sf_dir), five_queues(spark, 1).where("queue_id < 'Q3'"))


@query(f"""with {ops_sql(False)}
select op_seq, queue_id, op, 'DATA_TYPE_MISMATCH' as error_code, 'expected ' || (case when queue_id = 'Q0' then 'long' else 'int' end) as message
from ops where op in ('load', 'reload') and queue_id in ('Q0', 'Q1') and op_seq % 3 <> 0""")
def queue_type_rejects(spark, sf_dir):
    """Every third row has a number for its data."""
    ops = events(spark, sf_dir).withColumn("data", F.when(F.col("op_seq") % 3 == 0, F.col("op_seq").cast("string")).otherwise(F.col("data")))
    kinds = F.when(F.col("queue_id") == "Q0", "long").when(F.col("queue_id") == "Q1", "int").otherwise("string")
    return oplog.type_rejects(ops, five_queues(spark, 1).withColumn("data_type", kinds))


@query("""select stored, configured,
  case when stored > configured or (stored <= 1 and configured > 1) then 'INVALID_SHARDS' end as error_code,
  case when stored > configured or (stored <= 1 and configured > 1) then null else configured end as result
from (select s.i + 1 as stored, c.i + 1 as configured from range(20) s(i) cross join range(20) c(i))""")
def queue_shard_config(spark, sf_dir):
    grid = spark.range(400).select((F.floor(F.col("id") / 20) + 1).alias("stored"), (F.col("id") % 20 + 1).alias("configured"))
    return fold.shard_rules(grid)


@query("""select queue_id, shards from (
  select 'Q' || i::varchar as queue_id, case when i >= 3 then 16 else 4 end::int as shards from range(8) r(i))""")
def queue_registry_refresh(spark, sf_dir):
    new = spark.range(3, 8).select(F.concat(F.lit("Q"), F.col("id").cast("string")).alias("queue_id"), F.lit(16).alias("shards"))
    return views.upsert(five_queues(spark, SHARDS), new)


@query("""with l as (
  select o_orderpriority as queue_id, (o_orderkey % 16)::int as shard, o_orderstatus || o_custkey as data, o_orderkey as op_seq from orders),
a as (select queue_id, data, min(op_seq) as op_seq from l group by all),
b as (select l.* from l join a using (op_seq))
select queue_id, shard, count(*) as load_counter, 0::bigint as fire_counter, count(*) as load_pointer, 0::bigint as fire_pointer
from b group by all""")
def orders_queue_metadata(spark, sf_dir):
    orders = oplog.table(spark, sf_dir, "orders")
    ops = oplog.from_table(orders, "o_orderkey", F.col("o_orderpriority"), F.concat("o_orderstatus", F.col("o_custkey").cast("string")), shards=LANES)
    return replay.counters(replay.numbered(ops))


@query("""select 'C' || (conv_id % 7)::varchar as queue_id, count(*) as load_pointer, count(distinct text) as load_counter
from conversations where role = 'user' group by all""")
def conversations_queue_totals(spark, sf_dir):
    talk = oplog.table(spark, sf_dir, "conversations").where("role = 'user'")
    queue = F.concat(F.lit("C"), (F.col("conv_id") % 7).cast("string"))
    return talk.groupBy(queue.alias("queue_id")).agg(F.count("*").alias("load_pointer"), F.count_distinct("text").alias("load_counter"))


@query(
    log_sql(False) + """select f.op_seq, f.queue_id, f.p as fire_pointer, s.data, s.load_seq,
  case when f.failed then 'NOTHING_TO_FIRE' else 'ok' end as result
from lg f left join slots s on s.fire_seq = f.op_seq where f.op = 'fire'"""
)
def queue_fire_fold(spark, sf_dir):
    """The fold over a log without holes gives what the windows give."""
    out = fold.run(events(spark, sf_dir), shards=1)
    return out.where("op = 'fire'").select("op_seq", "queue_id", F.col("pointer").alias("fire_pointer"), "data", "load_seq", "result")


def fold_sql(holes: bool = False, ttl_us: int | None = None) -> str:
    """Every operation's result by recursion over the fires of a lane: a fire takes the least live slot above the pointer, or uses
    up all that are there."""
    op = "case when event_type in ('signup', 'view') then 'load' when event_type = 'click' then 'reload' else 'fire' end"
    if holes:
        op = f"case when event_id % 7 = 0 then 'delete' else {op} end"
    first = "select op_seq from (select op_seq, row_number() over (partition by queue_id, data order by op_seq) as n from ops where op = 'load') where n = 1"
    if ttl_us is not None:
        first = "select op_seq from anchors where ok"
    return f"""with recursive ops as (
  select event_id as op_seq, epoch_us(ts) as us, 'Q' || (user_id % 5)::varchar as queue_id, (event_id % {SHARDS})::int as shard, {op} as op,
    event_type || '_' || props as data, {"case when event_id % 7 = 0 then event_id // 70 + 1 end" if holes else "null"}::bigint as pointer
  from events),
l as (select op_seq, queue_id, data, us, row_number() over (partition by queue_id, data order by op_seq) as k from ops where op = 'load'),
anchors as (
  select queue_id, data, k, op_seq, us as anchor, true as ok from l where k = 1
  union all
  select l.queue_id, l.data, l.k, l.op_seq, case when l.us >= r.anchor + {ttl_us or 0} then l.us else r.anchor end, l.us >= r.anchor + {ttl_us or 0}
  from anchors r join l on l.queue_id = r.queue_id and l.data = r.data and l.k = r.k + 1),
writes as (
  select *, row_number() over (partition by queue_id, shard order by op_seq) as p from ops
  where op = 'reload' or (op = 'load' and op_seq in ({first}))),
slots as (
  select w.queue_id, w.shard, w.p, w.op_seq as wrote, w.data, w.us + {ttl_us if ttl_us is not None else 1 << 60} as until, min(d.op_seq) as gone
  from writes w left join ops d on d.op = 'delete' and d.queue_id = w.queue_id and d.shard = w.shard and d.pointer = w.p and d.op_seq > w.op_seq
  group by all),
fires as (select *, row_number() over (partition by queue_id, shard order by op_seq) as k from ops where op = 'fire'),
run as (
  select distinct queue_id, shard, 0::bigint as k, null::bigint as op_seq, null::bigint as hit, 0::bigint as fp from fires
  union all
  select r.queue_id, r.shard, f.k, f.op_seq, min(s.p) filter ((s.gone is null or s.gone > f.op_seq) and f.us < s.until),
    coalesce(min(s.p) filter ((s.gone is null or s.gone > f.op_seq) and f.us < s.until), max(s.p), r.fp)
  from run r join fires f on f.queue_id = r.queue_id and f.shard = r.shard and f.k = r.k + 1
  left join slots s on s.queue_id = r.queue_id and s.shard = r.shard and s.p > r.fp and s.wrote < f.op_seq
  group by r.queue_id, r.shard, f.k, f.op_seq, f.us, r.fp)
select o.op_seq, o.queue_id, o.op, o.shard, case when o.op = 'delete' then o.pointer when o.op = 'fire' then u.hit else w.p end as pointer,
  case when o.op = 'fire' then s.data when o.op <> 'delete' then o.data end as data,
  case when o.op = 'fire' then s.wrote else w.op_seq end as load_seq,
  case when o.op = 'fire' and u.hit is null then 'NOTHING_TO_FIRE' when o.op = 'load' and w.p is null then 'skipped' else 'ok' end as result
from ops o left join writes w on w.op_seq = o.op_seq left join run u on u.op_seq = o.op_seq
left join slots s on o.op = 'fire' and s.queue_id = o.queue_id and s.shard = o.shard and s.p = u.hit"""


@query(f"""with recursive {ops_sql(True).strip()},
acc as (
  select * from (select *, row_number() over (partition by queue_id, op, data order by op_seq) as rn from ops) where op <> 'load' or rn = 1),
n as (
  select *, {", ".join(f"sum((op <> 'fire' and shard = {i})::int) over w as w{i}" for i in range(SHARDS))},
    row_number() over (partition by queue_id, shard, op = 'fire' order by op_seq) as p, row_number() over (partition by queue_id, op = 'fire' order by op_seq) as k
  from acc window w as (partition by queue_id order by op_seq rows between unbounded preceding and current row)),
f as (select op_seq, queue_id, k, [{", ".join(f"w{i}" for i in range(SHARDS))}] as lp from n where op = 'fire'),
run as (
  select distinct queue_id, 0::bigint as k, null::bigint as op_seq, [{", ".join(["0"] * SHARDS)}]::bigint[] as fp, null::bigint as best from f
  union all
  select r.queue_id, f.k, f.op_seq,
    list_transform(range(1, {SHARDS + 1}), lambda i: r.fp[i] + (coalesce(list_min(list_transform(range(1, {SHARDS + 1}), lambda j: case when f.lp[j] > r.fp[j] then r.fp[j] * 16 + j end)) % 16 = i, false))::int)::bigint[],
    list_min(list_transform(range(1, {SHARDS + 1}), lambda j: case when f.lp[j] > r.fp[j] then r.fp[j] * 16 + j end))::bigint
  from run r join f on f.queue_id = r.queue_id and f.k = r.k + 1)
select o.op_seq, o.queue_id, o.op, coalesce(u.best % 16 - 1, o.shard)::int as shard, case when o.op = 'fire' then u.best // 16 + 1 else a.p end as pointer,
  case when o.op = 'fire' then s.data else o.data end as data, case when o.op = 'fire' then s.op_seq else a.op_seq end as load_seq,
  case when o.op = 'fire' and u.best is null then 'NOTHING_TO_FIRE' when o.op = 'load' and a.p is null then 'skipped' else 'ok' end as result
from ops o left join (select * from n where op <> 'fire') a on a.op_seq = o.op_seq left join run u on u.op_seq = o.op_seq
left join n s on s.op <> 'fire' and s.queue_id = o.queue_id and s.shard = u.best % 16 - 1 and s.p = u.best // 16 + 1""")
def queue_fire_any_active(spark, sf_dir):
    return fold.run(events(spark, sf_dir, SHARDS), shards=SHARDS, any_active=True)


@query(fold_sql(holes=True))
def queue_fire_with_holes(spark, sf_dir):
    """Every 7th operation deletes a slot of its shard before it can fire."""
    ops = events(spark, sf_dir, SHARDS).withColumn("pointer", F.lit(None).cast("long"))
    hole = F.col("op_seq") % 7 == 0
    ops = ops.withColumn("pointer", F.when(hole, F.floor(F.col("op_seq") / 70) + 1)).withColumn("op", F.when(hole, "delete").otherwise(F.col("op")))
    return fold.run(ops, shards=SHARDS)


@query(fold_sql(ttl_us=DAY_US))
def queue_fold_with_ttl(spark, sf_dir):
    return fold.run(events(spark, sf_dir, SHARDS), shards=SHARDS, ttl_us=DAY_US)
