"""Original, corrected and reference texts derived from the test tables.

The tables hold clean text only, so noise and its partial correction are made by plain
string functions, the same in Spark and in SQL; accents are dropped to compare with an
engine that measures bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import align
from vellum.sources.ship import ship

ACCENTS, PLAIN = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü", "ACEEEINOOUsaceeeinoou"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores, dealt out before costly work; larger
    tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, original, corrected, reference``; every tenth document is clean."""
    ref = F.translate("text", ACCENTS, PLAIN)
    k = F.col("doc_id")
    noisy = F.when(k % 10 == 9, ref).when(k % 3 == 0, F.translate(ref, "s", "f")).when(k % 3 == 1, F.replace(ref, F.lit(" of "), F.lit(" "))).otherwise(F.replace(ref, F.lit("and"), F.lit("aud,")))
    better = F.when(k % 5 == 0, F.replace("original", F.lit("the"), F.lit("tne"))).when(k % 3 == 0, F.replace("original", F.lit("fh"), F.lit("sh"))).when(k % 3 == 1, F.col("reference")).otherwise(F.replace("original", F.lit("aud,"), F.lit("and")))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", noisy.alias("original"), ref.alias("reference")).withColumn("corrected", better)


TRIPLES = f"""
base AS (SELECT doc_id, translate(text, '{ACCENTS}', '{PLAIN}') AS reference FROM documents),
noisy AS (SELECT doc_id, reference, CASE WHEN doc_id % 10 = 9 THEN reference WHEN doc_id % 3 = 0 THEN translate(reference, 's', 'f')
  WHEN doc_id % 3 = 1 THEN replace(reference, ' of ', ' ') ELSE replace(reference, 'and', 'aud,') END AS original FROM base),
triples AS (SELECT doc_id, original, reference, CASE WHEN doc_id % 5 = 0 THEN replace(original, 'the', 'tne') WHEN doc_id % 3 = 0 THEN replace(original, 'fh', 'sh')
  WHEN doc_id % 3 = 1 THEN reference ELSE replace(original, 'aud,', 'and') END AS corrected FROM noisy)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books: turns are pages, system turns are lost, some are blank."""
    rows = table(spark, sf_dir, "conversations").where("role <> 'system' OR turn % 2 = 1")
    out = F.when((F.col("turn") % 7 == 3), F.lit(" Blank ")).otherwise(F.col("text"))
    return rows.select(F.col("conv_id").cast("string").alias("book_id"), (F.col("turn") + 1).cast("int").alias("page"), F.concat("text", F.lit(" *")).alias("input"), out.alias("output"))


PAGES = """
pages_ AS (SELECT conv_id::VARCHAR AS book_id, (turn + 1)::INT AS page, text || ' *' AS input, CASE WHEN turn % 7 = 3 THEN ' Blank ' ELSE text END AS output
  FROM conversations WHERE role <> 'system' OR turn % 2 = 1)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit strings with substitutions and gaps."""
    o = tx.compact(F.translate("text", ACCENTS, PLAIN))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", o.alias("original")).withColumn("corrected", F.translate("original", "sw", "f "))
    return rows.withColumn("ops", align.match_string(F.col("original"), F.col("corrected")))


EDITS = f"""
comp AS (SELECT doc_id, replace(replace(replace(translate(text, '{ACCENTS}', '{PLAIN}'), ' ', ''), chr(10), ''), '-', '') AS original FROM documents),
edits AS (SELECT doc_id, original, translate(original, 'sw', 'f ') AS corrected,
  replace(replace(regexp_replace(original, '[^sw]', '|', 'g'), 's', '.'), 'w', '-') AS ops FROM comp)"""


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of six models' trials, 200 in a chunk; some chunks are short."""
    e = table(spark, sf_dir, "events")
    value = F.coalesce("value", F.lit(0.0))
    return e.where("event_id % 900 <> 3").select((F.floor(F.col("event_id") / 200) % 6).alias("model"), F.col("event_id").alias("row_id"), (F.col("event_id") % 7 / 10).cast("double").alias("original"), (F.abs(value) % 1).alias("predicted"), (F.col("event_id") % 50 + 1).cast("double").alias("weight"))


TRIALS = """
trials AS (SELECT (event_id // 200) % 6 AS model, event_id AS row_id, (event_id % 7) / 10.0::DOUBLE AS original, abs(coalesce(value, 0.0::DOUBLE)) % 1 AS predicted, (event_id % 50 + 1)::DOUBLE AS weight FROM events WHERE event_id % 900 <> 3)"""


def r6(c: str | Column) -> Column:
    return F.round(c, 6)
