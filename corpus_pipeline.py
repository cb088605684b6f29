"""From raw documents to packed training sequences, as stages over Spark tables.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``.  All but the last keep the columns
of ``documents``.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import exact, mixing, packing, simhash, toxicity
from vellum.llm.common import drop_tables, materialise, swept, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go; it learns from the labels of these documents.

    Null and empty texts are scored as the empty text; rows that repeat are judged alike;
    null ids are never learned from.
    """
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(docs: DataFrame, groups, label: str) -> DataFrame:
    """Of the rows that ``groups`` puts under one ``label``, the one with the least doc_id,
    null ids last; rows that repeat an id are told apart by a row id of their own."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("doc")), "rows")
    found = groups(rows.select(F.col("_row").alias("doc_id"), "doc.text")).select(F.col("doc_id").alias("_row"), F.col(label).alias("_group"))
    order = F.struct(F.col("id").isNull(), "id", "_row")
    best = rows.select("_row", F.col("doc.doc_id").alias("id")).join(found, "_row").groupBy("_group").agg(F.min_by("_row", order).alias("_row"))
    return rows.join(best.select("_row"), "_row", "left_semi").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the least doc_id stays; null texts are empty ones."""
    return one_of_each(docs, exact.exact_groups, "keep_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, one row with the least doc_id stays; null texts and texts
    without words have fingerprint zero."""
    return one_of_each(docs, simhash.simhash_components, "component_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most three times.

    Null and empty texts have no words; null sources are a source of their own; rows that
    repeat an id are taken one by one.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences; null texts are empty, and each row is a document of its own
    even where it repeats another."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained classifier; ``test_pipeline_against_brute_force`` works
#: out what run() returns from the rows that the classifier leaves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with swept(spark) as keep:  # what a stage wrote on the way goes with its end
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        if name != STAGES[0][0]:
            drop_tables(before)
    return STAGES[-1][1](spark, docs, sf_dir)
