"""First-wins deduplication of loads, without and with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

KEY = ("queue_id", "data")


def accepted(ops: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """ops less the loads whose key was loaded before; other operations stay.

    The first load of a key is a map-side minimum, so a key that has a third of all rows costs one row a task; loads
    then meet the firsts on their unique op_seq, which no key can skew.
    """
    loads = ops.where("op = 'load'")
    firsts = loads.groupBy(*key).agg(F.min("op_seq").alias("op_seq")).select("op_seq")
    return loads.join(firsts, "op_seq", "left_semi").unionByName(ops.where("op <> 'load'"))


def results(loads: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """All loads with skipped: whether their key was loaded before."""
    first = accepted(loads, key).select("op_seq", F.lit(True).alias("_first"))
    return loads.join(first, "op_seq", "left").withColumn("skipped", F.col("_first").isNull()).drop("_first")


def accepted_within(loads: DataFrame, ttl_us: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Loads that no live entry of their key blocks: an entry lives ttl_us after the load that made it, and a blocked load does
    not renew it. Accepted when ts >= last + ttl.

    Which load anchors an entry depends on all before it, so rows of a key are scanned in order: they are dealt by key,
    sorted, and streamed through the scan, which remembers one time stamp. A second scan stage is not needed and no
    group is held in memory.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, until = None, 0
        for frame in frames:
            keep = []
            for k, at in zip(frame[list(key)].itertuples(index=False, name=None), frame["_us"], strict=True):
                if k != now or at >= until:
                    now, until = k, at + ttl_us
                    keep.append(True)
                else:
                    keep.append(False)
            yield frame.loc[keep].drop(columns="_us")

    ship(loads.sparkSession)
    timed = loads.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    dealt = timed.repartition(*key).sortWithinPartitions(*key, "op_seq")
    return dealt.mapInPandas(scan, loads.schema)
