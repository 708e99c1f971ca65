"""Operator 8: exact deduplication by 128-bit content hashes, with bytes compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read, small, without_blanks

#: Members of a group that share one copy of the group's text in the comparison of bytes.
ROWS_PER_COPY = 1000


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = md5_128, row_col: str | None = None) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; of equal texts the one with the most code
    points stays, then the smallest id. Texts are stripped and hashed once; hashes, sizes and ids are gathered (map-side
    sums, so a group of any size costs one row a task), and only groups of two or more have texts moved, to be compared with a
    text of the group. A copy of that text serves ROWS_PER_COPY members, so a hot group is dealt over many tasks. Hash groups
    in which bytes differ are grouped again, whole, by their bytes.

    Null text is the empty text, and all empty or blank texts are equal. Ids are meant to be unique: rows that repeat an id
    and a text count in group_size and share one verdict, unless row_col names a column of unique longs, which then parts
    them (the least stays), and comes as a column of its own. A null id stays only when no other id in its group has as many
    code points. An empty table gives an empty result; further columns of docs are not read.
    """
    row = F.lit(0).cast("long") if row_col is None else F.col(row_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.length(text).cast("long").alias("n"), without_blanks(text).alias("body"))
    hashed = rows.withColumn("h", hash_fn(F.col("body")))
    # ~x falls as x grows, for every long; a null id comes last among ties.
    best = F.max(F.struct("n", F.col("doc_id").isNotNull().alias("named"), F.bitwise_not("doc_id").alias("back"), F.bitwise_not("row").alias("back_row")))
    of_best = [F.bitwise_not("best.back").alias("keep_id"), F.bitwise_not("best.back_row").alias("keep_row")]
    prints = keep(hashed.select("doc_id", "row", "n", "h", F.sha2("body", 256).alias("text_sha256")), "prints")
    groups = keep(prints.groupBy("h").agg(F.count("*").alias("size"), best.alias("best")).where("size > 1").select("h", "size", *of_best), "groups")
    groups = small(groups, 80)

    # Texts of the groups only: their ids are told first, so that no other text is stripped again.
    ids = keep(prints.join(groups, "h").select("doc_id").distinct(), "ids")
    again = _of_ids(docs, ids, id_col)
    again = again.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.length(text).cast("long").alias("n"), without_blanks(text).alias("body")).withColumn("h", hash_fn(F.col("body")))
    members = again.join(groups, "h")
    copies = F.ceil(F.col("size") / ROWS_PER_COPY).cast("int")
    one = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))).dropDuplicates(["h"])
    one = one.select("h", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    others = members.select("h", "body", F.pmod(F.xxhash64("doc_id", "row", "n"), copies).cast("int").alias("part"))
    torn = keep(others.join(one, ["h", "part"]).where("body <> kept_body").select("h").distinct(), "torn")

    out = prints.join(groups, "h", "left").select(
        "doc_id", "row", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("size").isNull(), F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"), F.coalesce("size", F.lit(1)).alias("size"), "text_sha256", "h",
    )
    if not torn.isEmpty():
        mixed = hashed.join(torn, "h", "left_semi").withColumn("text_sha256", F.sha2("body", 256))
        apart = mixed.groupBy("h", "body").agg(F.count("*").alias("size"), best.alias("best")).select("h", "body", "size", *of_best)
        out = out.join(torn, "h", "left_anti").unionByName(mixed.join(apart, ["h", "body"]).select(out.columns))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    out = out.select("doc_id", "keep_id", F.col("size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", F.col("row").alias(row_col or "row"))
    return out if row_col else out.drop("row")


def _of_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs whose id is among ids, nulls too."""
    named = small(ids.select(F.col("doc_id").alias("_of")), 16)
    return docs.join(named, docs[id_col].cast("long").eqNullSafe(named["_of"]), "left_semi")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
  from documents)
select doc_id,
       first_value(doc_id) over (partition by body order by n desc, doc_id) as keep_id,
       count(*) over (partition by body) as group_size,
       doc_id = first_value(doc_id) over (partition by body order by n desc, doc_id) as kept,
       sha256(body) as text_sha256
from d
"""

QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLES = {"op8_exact_dedup": ORACLE}
