"""Mixing sources to target weights by capped water-filling.

Sources share a word budget by weight.  A source whose share exceeds its size times the
greatest number of epochs is clamped there, and the excess is shared again by weight
until no source is above its limit; a window over the source totals, in order of limit
per weight, finds that level at once.  Each document is then taken as often as its source
has whole epochs, and once more if it comes early enough in a seeded order of its source
that these extra words fill the fractional epoch.

Words are counted in one pass.  The place where a source's fraction ends is found by sums
over ever longer prefixes of the order, each combined before its shuffle and only within
the prefix that holds the place, so a source, or an id that repeats, with a third of all
rows costs no task more than others.  The table of sources is joined as Spark sees fit:
broadcast if it is written small, else by a shuffle whose skewed partitions adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, materialise, seeded_order, word_count


def _key():
    """Null and text sources never meet: 's' + source, or 'n'."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float, share: float) -> DataFrame:
    """``sizes(key, source, source_size)`` to the same with ``target`` words.

    Sources by code point, null last, take the weights in turn.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("key", "source_size", weight.alias("_w"), (F.col("source_size") * float(max_epochs)).alias("_cap"), F.col("_rank"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * float(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    tried = ranked.withColumn("_level", level)
    found = F.min(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(Window.partitionBy())["_level"]
    return tried.select("key", "source_size", F.least("_cap", F.coalesce(found * F.col("_w"), F.col("_cap"))).alias("target"))


#: Lengths of order prefixes that are summed up: three digits of the id's hash, id and
#: size, three digits of the row's hash, all.
PREFIXES = (3, 45, 49, 62)


def _order(seed: int):
    """Order of a row: hash of its id, size, and last a hash of its place in the table, so
    that rows which repeat an id are taken one by one."""
    tail = F.lpad(F.hex(F.xxhash64("_place")), 16, "0")
    return F.concat_ws("-", seeded_order(seed, F.col("doc_id")), F.lpad(F.col("size").cast("string"), 12, "0"), tail)


def mixture(
    docs: DataFrame,
    *keep: str | Column,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
    share: float = 1.0,
    seed: int = 7,
) -> DataFrame:
    """The ``keep`` columns with size, source_size, target and repeats of each row.

    A row is taken as often as its source has whole epochs, and once more if the middle of
    its words comes before the end of the source's fraction.  Null text is empty; null
    sources form a source of their own, the last; rows that repeat an id are taken one by
    one, and which of wholly equal rows is taken more often does not show.  No row is
    taken more than ``max_epochs`` times.  An empty table gives an empty table.
    """
    numbered = docs.select(*keep, "doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("_place"))
    kept = numbered.columns[:-4]
    sized = materialise(numbered.select(*kept, "source", "size", _key().alias("key"), _order(seed).alias("ord")), "mix")
    plan = targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")), weights, max_epochs, share)
    plan = materialise(
        plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
            "goal", F.col("target") - F.col("whole") * F.col("source_size")
        ),
        "mix-plan",
    )
    edge = plan.where("goal > 0").select("key", "goal", F.lit(0).cast("long").alias("below"), F.lit("").alias("prefix"))
    before = 0
    for n in PREFIXES:
        inside = sized.select("key", "ord", "size").join(edge, "key").where(F.substring("ord", 1, before) == F.col("prefix"))
        sums = inside.groupBy("key", "goal", "below", F.substring("ord", 1, n).alias("prefix")).agg(F.sum("size").alias("n")).where("n > 0")
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("upto", upto).where("upto - n < goal AND goal <= upto")
        edge, before = cut(found.select("key", "goal", (F.col("upto") - F.col("n")).alias("below"), "prefix", "n")), n
        edge, last = edge.drop("n"), edge
    taken = F.when(F.col("below") + F.col("n") / 2 < F.col("goal"), 1).otherwise(0)
    plan = plan.drop("goal").join(last.select("key", F.col("prefix").alias("edge"), taken.alias("edge_taken")), "key", "left")
    more = F.when(F.col("ord") < F.col("edge"), 1).when(F.col("ord") == F.col("edge"), F.col("edge_taken")).otherwise(0)
    return sized.join(materialise(plan, "mix-cut"), "key").select(*kept, "size", "source_size", F.round("target", 6).alias("target"), (F.col("whole") + more).alias("repeats"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, repeats, taken."""
    mixed_rows = mixture(docs, F.col("doc_id").alias("_id"), **options)
    return mixed_rows.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, columns as given."""
    times = mixture(docs, F.struct(*docs.columns).alias("_doc"), **options).where("repeats > 0")
    return times.select("_doc", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_doc.*")


#: DuckDB SQL for :func:`mix` with its default parameters.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w
), f AS (SELECT lev FROM l WHERE cap / w >= lev ORDER BY cap / w, r LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT lev FROM f) * w, cap)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), o AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS goal,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('7:' || coalesce(d.doc_id::VARCHAR, '')) || '-' || lpad(d.size::VARCHAR, 12, '0') ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS mid
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  whole + CASE WHEN mid < goal THEN 1 ELSE 0 END AS repeats,
  size * (whole + CASE WHEN mid < goal THEN 1 ELSE 0 END) AS taken
FROM o
"""
