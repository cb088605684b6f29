"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Texts are cut where their own content says so, so equal texts have equal chunks.  A
chunk's identifier is its 64-bit hash, verified: one aggregation over the distinct chunk
texts finds hashes that stand for more than one text, and chunks under such a hash carry
an ordinal too.  A document is then its ordered list of identifiers, its recipe; equal
recipes mean equal texts.  Text crosses the network once, as distinct chunks, for the
verification; grouping and joining move recipes, eight bytes for about a thousand
characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, materialise, one_space

#: A chunk ends after a space whose word ends in two of these letters (about one word in
#: twenty), or after a full stop of a script without them, once it has LEAST characters,
#: and after MOST in any case.
ENDS = r"[a-hß-ê][n-z] |[а-и][н-я] |[α-θ][ν-ω] |[。！？।؟۔።]"
LEAST, MOST = 700, 4096
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?<={ENDS})|.{{1,{MOST}}}"


def chunks(text: Column) -> Column:
    """The content-defined chunks of a normalised text; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``doc_id, text_sha256, recipe`` with a recipe of verified chunk identifiers."""
    norm = docs.select("doc_id", one_space(F.col("text")).alias("norm"))
    cutup = norm.select("doc_id", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    ids = lambda x: F.struct(chunk_hash(x).alias("h"), F.lit(0).alias("n"))
    table = materialise(cutup.select("doc_id", "text_sha256", F.transform("chunks", ids).alias("recipe")), "recipe")
    texts = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk")
    shared = cut(texts.groupBy("h").agg(F.count_distinct("chunk").alias("texts")).where("texts > 1").select("h"))
    if shared.isEmpty():
        return table
    ordinal = texts.join(shared, "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1)
    numbered = cutup.withColumn("row", F.monotonically_increasing_id())
    parts = numbered.select("row", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "chunk"))
    parts = parts.withColumn("h", chunk_hash(F.col("chunk"))).join(ordinal, ["h", "chunk"], "left")
    part = F.when(F.col("pos").isNotNull(), F.struct("pos", "h", F.coalesce("n", F.lit(0)).alias("n")))
    whole = parts.groupBy("row", "doc_id", "text_sha256").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return materialise(whole.select("doc_id", "text_sha256", F.transform("parts", lambda p: F.struct(p["h"].alias("h"), p["n"].alias("n"))).alias("recipe")), "recipe-exact")


def exact_groups(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and texts of white space alone are one space.  The least
    doc_id of a group stays; rows that repeat it all count and all stay.  A null doc_id
    is never the least unless the group has no other.  Other columns are not read.
    """
    table = recipes(docs, chunk_hash)
    # combined before the shuffle; written, so that both sides of the join are plain
    # shuffles and adaptive execution splits a recipe with very many copies
    groups = materialise(table.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return table.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


#: DuckDB SQL for :func:`exact_groups`.
ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
