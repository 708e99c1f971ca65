"""The corpus pipeline: five stages, each over all that the one before has kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All but the last return rows with the columns of
documents. run() chains them over the documents table, each result written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolyard.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from spoolyard.llm.common import keep, read, small


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a unique number for each row, written so that it stays the same; and the name of its column."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    return keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """docs less the rows whose number is in dropped, which is written first and broadcast if it is small."""
    return docs.join(small(keep(dropped.select(row), "dropped"), 12), row, "left_anti").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that operator 10 scores under 0.5, by a model learned from the labelled rows of docs that are not held out.

    Null and empty texts have the score of no evidence; a row is judged by its text alone, whatever its id.
    """
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    toxicity.ship(spark)
    return docs.where(toxicity.toxic_score(model, F.col("text")) < 0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, by operator 8: rows go, not ids, so a row of a repeated id or of none has its own fate.

    Null and empty texts are one group. An empty table stays empty, further columns stay.
    """
    rows, row = _numbered(docs)
    return _without(rows, exact_dedup.exact_dedup(rows, row_col=row).where("not kept"), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, by operator 7: five words a shingle, similarity 0.8 or more.

    Components are those of rows, whatever their ids; the row of the least id stays (null last), then the first. Rows without
    words are in no component and stay. An empty table stays empty, further columns stay.
    """
    rows, row = _numbered(docs)
    found = near_dedup.near_dedup(rows, shingle=5, similarity=80, id_col=row).select(F.col("doc_id").alias(row), "component_id", "kept")
    grown = keep(found.where("not kept").select("component_id").distinct(), "grown")
    group = keep(found.join(small(grown, 12), "component_id").join(rows.select(row, F.col("doc_id").cast("long").alias("id")), row), "groups")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", row)
    first = group.groupBy("component_id").agg(F.min(order).alias("first"))
    gone = group.join(small(keep(first, "firsts"), 40), "component_id").where(order != F.col("first"))
    return _without(rows, gone, row)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated at the rates that operator 3 fits; every row stays at least once, null ids and texts too."""
    return mixing.repeat_to_mix(docs, read(spark, sf_dir, "labels"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row, encoded and decoded by operator 5; null and empty texts have none."""
    return bpe.encode(docs, *bpe.public_ranks())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("byte_bpe", tokenize),
]

#: Toxicity, near duplicates, mixing and byte pairs are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
