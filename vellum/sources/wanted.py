"""Rows of JSON-lines shards whose id is on a list (SRC6, FLT12).

The list becomes a Bloom filter of bounded size, which every task tests on the url of the
raw line; only lines that pass are parsed, and an exact semi join drops what passed by
chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.sources import io

#: Bits for each id, hashes of an id, and the most bits of a filter (16 MB, broadcast).
BITS, HASHES, MOST_BITS = 12, 6, 1 << 27
#: The value of each ``url`` field in a raw line, with its escapes.
URL = r'"url"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def places(key: Column, bits: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), bits) for seed in range(HASHES)]


def bloom(ids: DataFrame, key: str) -> DataFrame:
    """One row ``bits, words``: a bit field in 64-bit words.  Lists of more ids than
    ``MOST_BITS`` provides for make a fuller filter, which lets more lines pass and still
    loses none."""
    n = ids.where(F.col(key).isNotNull()).agg(F.approx_count_distinct(key)).first()[0]
    bits = min(MOST_BITS, max(1024, -(-n * BITS // 64) * 64))
    named = ids.where(F.col(key).isNotNull()).select(F.explode(F.array(*places(F.col(key), F.lit(bits)))).alias("bit"))
    empty = ids.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("v"))
    set_ = named.select(F.shiftright("bit", 6).cast("long").alias("word"), bit(F.col("bit")).alias("v"))
    words = set_.unionByName(empty).groupBy("word").agg(F.bit_or("v").alias("v"))
    # one array of at most MOST_BITS / 64 words, whatever the list
    whole = words.agg(F.array_sort(F.collect_list(F.struct("word", "v"))).alias("w"))
    return whole.select(F.lit(bits).alias("bits"), F.col("w.v").alias("words"))


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def may_hold(key: Column, bits: Column, words: Column) -> Column:
    """Whether a key may be in the filter; a null key is not."""
    hit = F.lit(True)
    for p in places(key, bits):
        hit = hit & (F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(bit(p)) != 0)
    return F.coalesce(hit, F.lit(False))


def read_wanted(spark: SparkSession, path: str, wanted: DataFrame, key: str = "book_id", **options) -> DataFrame:
    """Shard rows (``io.SHARD``) with their ``book_id`` out of the url, where ``wanted`` has
    that id; ids that repeat give each row once, null ids match nothing.  ``options`` are
    the JSON parser's."""
    ids = wanted.select(F.col(key).cast("string").alias("book_id"))
    lines = spark.read.text(path).crossJoin(F.broadcast(bloom(ids, "book_id")))  # one row
    passes = lambda raw: raw.contains("\\") | may_hold(tx.url_id(raw), F.col("bits"), F.col("words"))
    # a value that hangs on the filter: what the semi join asks of parsed rows would else be
    # pushed below the filter, and all lines be parsed
    passed = F.when(F.exists(F.regexp_extract_all("value", F.lit(URL), F.lit(1)), passes), F.col("value"))
    kept = lines.select(passed.alias("value")).where("value IS NOT NULL")
    rows = kept.select(F.from_json("value", io.SHARD, options).alias("r")).select("r.*")
    return rows.withColumn("book_id", tx.url_id(F.col("url"))).join(ids, "book_id", "left_semi")
