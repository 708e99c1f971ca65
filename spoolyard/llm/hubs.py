"""Links among the members of buckets, found by rounds of hubs and without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, keep, release, small

#: Rounds have 1, HUBS, HUBS^2, ... hubs a bucket; a bucket with no more members ends with the round.
HUBS = 32

Side = Callable[[str], Column]


def settle(
    members: DataFrame,
    extras: list[str],
    close: Callable[[Side, Side], Column] | None,
    confirm: Callable[[DataFrame], DataFrame],
    first: list[Column],
    narrow: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows (node long, root long): components of the links among members (bucket, node, extras), whose buckets have two or more nodes.

    In every round some members of each bucket, its hubs, are paired with those of its members that are in other
    components and that close() allows; confirm() returns a table of those of the pairs (a, b) that are links, and each pair
    is asked for once. A bucket ends when it is one component or
    when each of its members has been a hub. So a bucket of n copies costs about n pairs, and still
    every pair that shares a bucket is settled: compared, ruled out by close(), or joined already over others. close takes
    two functions from a column's name to the member's and to the hub's column and must be exact. first orders members: the
    least is the next hub. narrow may replace extras, or drop members that can have no link, after the first round.
    Nodes without a link may be missing from the result. extras have a fixed size, 450 bytes together at most.

    Hubs are broadcast while their counted size allows it, which leaves members where they are; beyond that a bucket's
    members and hubs meet by a sort-merge join, whose large partitions adaptive execution splits.
    """
    roots, done, tried = None, [], []
    turn, given = 0, members
    while True:
        hubs_each, largest = HUBS**turn, None
        if turn == 0:
            now = members.withColumn("root", F.col("node"))
        else:
            # Buckets that are one component are over for good.
            now = members if roots is None else members.join(small(roots, 16), "node", "left")
            now = now.withColumn("root", F.col("node") if roots is None else F.coalesce("root", "node"))
            split = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
            split = keep(split.select("bucket", "size"), "split")
            largest = split.agg(F.max("size")).first()[0]
            if largest is None:
                break
            now = keep(now.join(small(split, 20), "bucket").select("bucket", "node", *extras, "root", "size"), "unsettled")
            release(split)
            if members is not given:
                release(members)
            if turn == 1 and narrow is not None:
                wide, now = now, keep(narrow(now).select("bucket", "node", *extras, "root", "size"), "narrowed")
                release(wide)
        free = now
        if done:
            used = reduce(DataFrame.union, (h.select("bucket", F.col("hub_node").alias("node")) for h in done))
            free = now.join(used, ["bucket", "node"], "left_anti")
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(hubs_each))
        if turn:
            slot = F.when(F.col("size") <= hubs_each, F.col("node")).otherwise(slot)
        rank = F.struct(*(c.alias(f"rank{i}") for i, c in enumerate(first)), "node", *extras, "root")
        hubs = free.groupBy("bucket", slot.alias("slot")).agg(F.min(rank).alias("hub"))
        hubs = keep(hubs.select("bucket", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", *extras, "root"))), "hubs")
        allowed = F.col("root") != F.col("hub_root")
        if close is not None:
            allowed &= close(F.col, lambda c: F.col(f"hub_{c}"))
        pairs = now.join(small(hubs, 500 if extras else 40), "bucket").where(allowed)
        pairs = pairs.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
        pairs = keep(pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti") if tried else pairs, "pairs")
        new = confirm(pairs)
        tried.append(pairs)
        done.append(hubs)
        if not new.isEmpty():
            # What a component is made of matters no more: its nodes with their root are edges enough.
            known = new if roots is None else new.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            older, roots = roots, keep(components(known), "roots")
            release(older)
        release(new)
        if turn:
            members = now.drop("root", "size")
            members._kept_path = now._kept_path
            if largest <= hubs_each:  # all have been hubs
                break
        turn += 1
    if members is not given:
        release(members)
    for table in (*done, *tried):
        release(table)
    return roots if roots is not None else given.select("node", F.col("node").alias("root")).limit(0)


def pairs_with(pairs: DataFrame, table: DataFrame, value: str, row_bytes: int | None = None) -> DataFrame:
    """Rows (a, b, x, y): the pairs with the values that table (node, value) has for a and b; row_bytes is the size of a row of
    table where that is fixed."""
    left = table.select(F.col("node").alias("a"), F.col(value).alias("x"))
    right = table.select(F.col("node").alias("b"), F.col(value).alias("y"))
    if row_bytes:
        return pairs.join(small(left, row_bytes), "a").join(small(right, row_bytes), "b").select("a", "b", "x", "y")
    firsts = left.join(small(pairs.select("a").distinct(), 12), "a", "left_semi")
    return right.join(small(pairs, 24), "b").join(firsts, "a").select("a", "b", "x", "y")
