"""Similarity metrics of predictions against references (MET1-19)."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import text as tx
from vellum.functions.distance import measures
from vellum.functions.moves import move_edits


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as a double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def improvement(original: Column, predicted: Column, clip: bool = True, guard: bool = True) -> Column:
    """MET7: relative fall of an error score, clipped to [-1, 1].

    Where the original score is 0 it is the negated new score, or null without
    ``guard``.  MET12, MET13: scale by 100, or leave unclipped.
    """
    raw = ratio(original - predicted, original)
    raw = F.when(original == 0, -predicted).otherwise(raw) if guard else raw
    return F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))) if clip else raw


def document_scores(triples: DataFrame, metric: str = "cer", lowercase: bool = False, modernize: bool = False) -> DataFrame:
    """MET1, MET2, MET7, MET9: a row per document.

    ``doc_id``, edits and score of ``corrected`` and ``original`` against ``reference``,
    length of the reference, length of the normalised and raw prediction, improvement.
    A document with an empty reference has null scores.
    """
    if metric not in ("cer", "wer"):
        raise ValueError(f"unknown metric: {metric}")
    ready = lambda c: tx.squeeze(F.translate(c, "wW", "vV") if modernize else F.col(c))
    m = measures(ready("original"), ready("corrected"), ready("reference"), metric, lowercase)
    measured = triples.select("doc_id", F.length("corrected").alias("raw_length"), F.length("original").alias("input_length"), m.alias("m")).select("doc_id", "raw_length", "input_length", "m.*")
    scored = measured.withColumns({"score": ratio(F.col("edits"), F.col("ref_length")), "orig_score": ratio(F.col("orig_edits"), F.col("ref_length"))})
    return scored.withColumn("improvement", improvement(F.col("orig_score"), F.col("score")))


def character_scores(pairs: DataFrame, predicted: str = "corrected", reference: str = "reference") -> DataFrame:
    """MET3: ``doc_id, moves, moved_words, cost, score`` of whole texts, where blocks of words
    may move.  The score is relative to the prediction's length: 0 if both texts are empty,
    1 if the prediction alone is, null if either is null."""
    m = pairs.select("doc_id", move_edits(F.col(predicted), F.col(reference)).alias("m")).select("doc_id", "m.*")
    score = F.when(F.col("length") > 0, F.col("cost") / F.col("length")).when(F.col("cost") > 0, 1.0).when(F.col("cost") == 0, 0.0)
    return m.select("doc_id", "moves", F.col("words").alias("moved_words"), F.when(F.col("length").isNotNull(), F.col("cost")).alias("cost"), score.alias("score"))


def weighted(x: Column, w: Column) -> Column:
    w = F.when(x.isNotNull(), w)
    return ratio(F.sum(x * w), F.sum(w))


def summary(scores: DataFrame, weight: str = "weight") -> DataFrame:
    """MET4-6, MET8, MET10, MET15: ``stat, metric, value`` in one aggregation.

    ``weight`` names the weighting: normalised prediction (``weight``), raw prediction
    (``raw_length``) or input (``input_length``).
    """
    w = F.col(weight)
    stats = {}
    for name, e, s, own in (("predicted", "edits", "score", w), ("original", "orig_edits", "orig_score", F.col("orig_weight"))):
        stats[(name, "micro")] = ratio(F.sum(e), F.sum("ref_length"))
        stats[(name, "mean")] = F.avg(s)
        stats[(name, "median")] = F.median(s)
        stats[(name, "weighted average")] = weighted(F.col(s), own)
    stats[("improvement", "mean")] = F.avg("improvement")
    stats[("improvement", "median")] = F.median("improvement")
    stats[("improvement", "weighted average")] = weighted(F.col("improvement"), w)
    one = scores.agg(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("stat"), v.alias("value")) for (m, k), v in stats.items()]).alias("rows"))
    return one.select(F.inline("rows"))


def evaluate(triples: DataFrame, metric: str = "cer", lowercase: bool = False, modernize: bool = False) -> DataFrame:
    """MET14: scores and their summary, by metric name; ``all`` gives both."""
    names = ("cer", "wer") if metric == "all" else (metric,)
    parts = [summary(document_scores(triples, m, lowercase, modernize)).withColumn("score", F.lit(m)) for m in names]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def objective(scores: DataFrame) -> DataFrame:
    """MET11: clipped improvement weighted by input length."""
    return scores.agg(weighted(F.col("improvement"), F.col("input_length")).alias("objective"))


def outliers(scores: DataFrame, threshold: float) -> DataFrame:
    """FLT4: ``part`` is kept (below) or listed (above); equal rows are in neither, and a
    threshold of 0 keeps all."""
    limit = threshold or float("inf")
    part = F.when(F.col("orig_score") < limit, "kept").when(F.col("orig_score") > limit, "listed")
    return scores.withColumn("part", part).where("part IS NOT NULL")


def improved_counts(scores: DataFrame) -> DataFrame:
    """FLT5."""
    return scores.agg(F.count_if(F.col("score") < F.col("orig_score")).alias("improved"), F.count("*").alias("total"))


def scores_in_order(books: DataFrame, scores: DataFrame, key: str = "book_id", order: str = "row_id") -> DataFrame:
    """JOIN8: the scores of the listed books, in the order of the list."""
    return books.select(key, order).join(scores, key).orderBy(order)


def merge_scores(cer: DataFrame, f1: DataFrame, key: str = "book_id") -> DataFrame:
    """JOIN13: F1 scores beside the CER rows of the books that have both."""
    return cer.join(f1, key)


def by_position(original: DataFrame, runs: dict[str, DataFrame], value: str, order: str = "row_id") -> DataFrame:
    """JOIN14: each run's value beside the original row of the same position; positions
    that a run lacks are left out, as an alignment by index would."""
    out = original
    for name, run in runs.items():
        out = out.join(run.select(order, F.col(value).alias(name)), order)
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn")]))
def _bags(predicted: pd.Series, reference: pd.Series) -> pd.DataFrame:
    rows = []
    for p, r in zip(predicted, reference, strict=True):
        p, r = Counter((p or "").split()), Counter((r or "").split())
        both = (p & r).total()
        rows.append((both, p.total() - both, r.total() - both))
    return pd.DataFrame(rows, columns=["tp", "fp", "fn"])


def bag_counts(pairs: DataFrame, predicted: str, reference: str) -> DataFrame:
    """MET16: multiset overlap of tokens by document, a row each: tp, fp, fn, f1.

    A row holds both bags, so they are counted in it and nothing is shuffled; 0 where the
    id is null.
    """
    text = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c))
    every = pairs.select("doc_id", _bags(text(predicted), text(reference)).alias("m")).select("doc_id", "m.*")
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return every.withColumn("f1", f1)


def bag_macro(triples: DataFrame, columns=("original", "corrected"), reference: str = "reference") -> DataFrame:
    """MET17: mean F1 over documents for each text column."""
    parts = [bag_counts(triples, c, reference).agg(F.avg("f1").alias("f1")).select(F.lit(c).alias("variant"), "f1") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def set_scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """MET18: precision, recall and F1 of distinct keys; 0 if a set is empty."""
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    n = p.join(g, keys, "full").agg(F.coalesce(F.sum(F.col("_p") * F.col("_g")), F.lit(0)).alias("both"), F.coalesce(F.sum("_p"), F.lit(0)).alias("p"), F.coalesce(F.sum("_g"), F.lit(0)).alias("g"))
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    pr = n.select(share("both", "p").alias("precision"), share("both", "g").alias("recall"))
    return pr.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def volume_change(rows: DataFrame, before: str, after: str) -> DataFrame:
    """MET19: visible characters of parallel segment arrays and their change in percent."""
    pieces = rows.select(F.inline(F.arrays_zip(F.col(before).alias("a"), F.col(after).alias("b"))))
    total = pieces.agg(F.sum(tx.visible_length(F.col("a"))).alias("before"), F.sum(tx.visible_length(F.col("b"))).alias("after"))
    return total.withColumn("change_pct", ratio(100 * (F.col("after") - F.col("before")), F.col("before")))
