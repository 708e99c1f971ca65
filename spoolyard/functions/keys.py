"""Text keys of stored records, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITER, SHARD = "_", "SHARD"


def _joined(queue_id: Column, shard: Column, suffix: Column) -> Column:
    plain = F.concat_ws(DELIMITER, queue_id, suffix)
    return F.when(shard.isNull(), plain).otherwise(F.concat_ws(DELIMITER, queue_id, F.lit(SHARD), shard.cast("string"), suffix))


def slot_key(queue_id: Column, shard: Column, pointer: Column) -> Column:
    """id_SHARD_s_pointer, or id_pointer of an unsharded queue."""
    return _joined(queue_id, shard, pointer.cast("string"))


def meta_key(queue_id: Column, shard: Column, kind: str) -> Column:
    """id_SHARD_s_POINTERS or id_SHARD_s_COUNTERS; without a shard part if unsharded."""
    return _joined(queue_id, shard, F.lit(kind))


def shards_key(queue_id: Column) -> Column:
    return F.concat_ws(DELIMITER, queue_id, F.lit("SHARDS"))


def shard_label(shard: Column) -> Column:
    """SHARD_s; metadata of an unsharded queue is labelled SHARD_0."""
    return F.concat_ws(DELIMITER, F.lit(SHARD), F.coalesce(shard, F.lit(0)).cast("string"))


def dedup_key(queue_id: Column, data: Column) -> Column:
    """The id and the data without a delimiter; operators dedup by the pair itself, which cannot collide."""
    return F.concat(queue_id, data.cast("string"))


def set_name(farm_id: Column, name: Column, scope: str = "LOCAL") -> Column:
    return F.concat_ws(DELIMITER, farm_id, name) if scope == "LOCAL" else name
