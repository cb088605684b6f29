"""Collocations by mutual information over a token window (COL1-7, FLT7-10, WIN1)."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx

#: Tokens that a task counts at once, and rows that it gives on at once.
HELD, ROWS = 1 << 19, 1 << 16


def token_arrays(docs: DataFrame, column: str, lowercase: bool = True) -> DataFrame:
    return docs.select("doc_id", tx.tokenize(tx.normalize_words(F.col(column), lowercase, quotes=True)).alias("tokens"))


def word_counts(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def neighbour_counts(tokens: DataFrame, window: int = 2, selected: Sequence[str] | None = None) -> DataFrame:
    """COL1: ordered pairs ``w1, w2, n`` within the window, both directions.

    Inside each document's array, only the pairs ahead of a token are formed and counted
    in canonical order; the other direction has the same count, and a word beside itself
    counts from both ends.  No join, no window, no sort.
    """
    ahead = lambda k: F.when(F.size("tokens") > k, F.zip_with(
        F.slice("tokens", 1, F.size("tokens") - k), F.slice("tokens", k + 1, F.size("tokens") - k), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    )).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
    half = tokens.select(F.explode(F.concat(*[ahead(k) for k in range(1, window + 1)])).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    same = half.where("a = b").select(F.col("a").alias("w1"), F.col("b").alias("w2"), (2 * F.col("n")).alias("n"))
    other = half.where("a <> b")
    both = same.unionByName(other.select(F.col("a").alias("w1"), F.col("b").alias("w2"), "n")).unionByName(other.select(F.col("b").alias("w1"), F.col("a").alias("w2"), "n"))
    return both.where(F.col("w1").isin(list(selected))) if selected is not None else both


def _counted(columns: Sequence[str], window: int):
    """The kernel of ``counts``: texts of a batch to words and pairs with their counts."""
    strip = str.maketrans("", "", '-.,?!:;"')

    def tokens(text: str) -> list[str]:
        joined = re.sub(r"-\s+", "", text).translate(strip)
        if not text.isascii():
            joined = unicodedata.normalize("NFKC", re.sub(r"\s+", " ", joined).casefold())
        return joined.casefold().split() if text.isascii() else joined.split()

    def rows(words: dict[str, int], code: np.ndarray, sizes: list[int], of: list[int]) -> Iterator[pa.RecordBatch]:
        names, u, c = pa.array(words, pa.string()), len(words), len(columns)
        text, column = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.array(of, np.int64), sizes)
        keys = [(code * (u + 1) + u) * c + column]
        for k in range(1, window + 1):
            near = text[k:] == text[:-k]
            x, y = code[:-k][near], code[k:][near]
            keys.append((np.minimum(x, y) * (u + 1) + np.maximum(x, y)) * c + column[k:][near])
        found = np.concatenate(keys)
        del keys, text, column
        found.sort()
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        n, found = np.diff(np.append(first, len(found))), found[first]
        pair = found // c
        begin = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        ids = hash_array(names.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
        for at in range(0, len(begin), ROWS):
            lo, hi = begin[at], begin[at + ROWS] if at + ROWS < len(begin) else len(found)
            own = begin[at : at + ROWS]
            table = np.zeros((c, len(own)), np.int64)
            table[found[lo:hi] % c, np.searchsorted(own, np.arange(lo, hi), "right") - 1] = n[lo:hi]
            a, b = np.divmod(pair[own], u + 1)
            one = b == u
            x, y = ids[a], ids[np.where(one, a, b)]
            values = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y), mask=one), names.take(pa.array(a, mask=~one)), *map(pa.array, table)]
            yield pa.RecordBatch.from_arrays(values, ["a", "b", "word", *[f"n_{k}" for k in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, code, sizes, of = {}, array("q"), [], []

        def counted() -> Iterator[pa.RecordBatch]:
            if code:
                yield from rows(words, np.array(code), sizes, of)
            words.clear()
            del code[:], sizes[:], of[:]

        for batch in batches:
            for i in range(len(columns)):
                for text in batch.column(i):
                    if (value := text.as_py()) is not None:
                        found = tokens(value)
                        for word in set(found).difference(words):
                            words[word] = len(words)
                        code.extend(map(words.__getitem__, found))
                        sizes.append(len(found))
                        of.append(i)
                        if len(code) > HELD:
                            yield from counted()
        yield from counted()

    return run


def counts(docs: DataFrame, columns: Sequence[str], window: int = 2) -> DataFrame:
    """``a, b, word, n_<column>...``: one scan and one aggregation of words (b null) and
    pairs of word ids (word null), by text column.

    Tasks count within some hundred texts at once, so what is shuffled is two numbers a
    pair; an id is 64 bits of the word's hash, and ``named_words`` fails if two words share one.
    """
    return _counts(docs, columns, window).drop("alone")


def _counts(docs: DataFrame, columns: Sequence[str], window: int) -> DataFrame:
    """``counts`` with ``alone``, whether the row is a word's.  As that comes out of the aggregation, words, pairs
    and totals are told apart only behind it, and it and its shuffle run once for all of them."""
    sums = ", ".join(f"n_{c} long" for c in columns)
    each = docs.select(*[F.col(c).alias(f"t{i}") for i, c in enumerate(columns)]).mapInArrow(_counted(columns, window), f"a long NOT NULL, b long, word string, {sums}")
    return each.groupBy("a", "b", "word").agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in columns], F.max(F.col("b").isNull()).alias("alone"))


def named_words(every: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, word, n_<column>...`` out of ``_counts``."""
    sums = [F.sum(f"n_{c}").alias(f"n_{c}") for c in columns]
    words = every.where("alone").groupBy("a").agg(F.min("word").alias("word"), F.max("word").alias("last"), *sums)
    shared = F.raise_error(F.concat(F.lit("two words share an id: "), F.col("word"), F.lit(", "), F.col("last"))).cast("string")
    return words.withColumn("word", F.when(F.col("word") == F.col("last"), F.col("word")).otherwise(shared)).drop("last")


def collocations_by(docs: DataFrame, columns: Sequence[str], window: int = 2, cutoff: int = 4) -> DataFrame:
    """COL1-3, FLT7: ``w1, w2`` and for each text column ``mi2_, f12_, f1_, f2_``, null
    where the pair does not pass the cutoff there.

    Counts of words and N are over all tokens, before any cutoff.  Pairs are counted by
    the ids of their words and get the words themselves after the cutoff.
    """
    every = _counts(docs, columns, window)
    words = named_words(every, columns)
    totals = F.broadcast(every.where("alone").agg(*[F.sum(f"n_{c}").alias(f"total_{c}") for c in columns]))  # one row
    often = F.lit(False)
    for c in columns:
        often |= F.col(f"n_{c}") >= cutoff
    named = lambda key, w, f: words.where(often).select(F.col("a").alias(key), F.col("word").alias(w), *[F.col(f"n_{c}").alias(f"{f}_{c}") for c in columns])
    # a word beside itself counts from both ends; keys that may not be null bring no filter before the shuffle
    twice = F.when(F.col("a") == F.col("b"), 2).otherwise(1)
    pairs = every.where("NOT alone").select("a", F.coalesce("b", F.lit(0)).alias("b"), *[(twice * F.col(f"n_{c}")).alias(f"n_{c}") for c in columns])
    joined = pairs.where(often).join(named("a", "v1", "x"), "a").join(named("b", "v2", "y"), "b").crossJoin(totals)
    out, turned = [], F.col("v1") > F.col("v2")
    for c in columns:
        n, x, y = F.col(f"n_{c}"), F.col(f"x_{c}"), F.col(f"y_{c}")
        passed = (n >= cutoff) & (x >= cutoff) & (y >= cutoff)
        mi2 = F.log2(n.cast("double") * n / (x.cast("double") * y / F.col(f"total_{c}")))
        out += [F.when(passed, v).alias(f"{k}_{c}") for k, v in (("mi2", mi2), ("f12", n), ("f1", F.when(turned, y).otherwise(x)), ("f2", F.when(turned, x).otherwise(y)))]
    return joined.select(F.least("v1", "v2").alias("w1"), F.greatest("v1", "v2").alias("w2"), *out)


def collocations(docs: DataFrame, column: str, window: int = 2, cutoff: int = 4, selected: Sequence[str] | None = None) -> DataFrame:
    """COL1-4: ``w1, w2, mi2, f12, f1, f2``, a row per unordered pair.

    FLT8: with ``selected``, w1 is a selected word; a pair of two selected words is given
    once, in canonical order.
    """
    found = collocations_by(docs, [column], window, cutoff).where(F.col(f"mi2_{column}").isNotNull())
    found = found.select("w1", "w2", *[F.col(f"{k}_{column}").alias(k) for k in ("mi2", "f12", "f1", "f2")])
    if selected is None:
        return found
    one, two = F.col("w1").isin(list(selected)), F.col("w2").isin(list(selected))
    turn = lambda a, b: F.when(one, F.col(a)).otherwise(F.col(b))
    return found.where(one | two).select(turn("w1", "w2").alias("w1"), turn("w2", "w1").alias("w2"), "mi2", "f12", turn("f1", "f2").alias("f1"), turn("f2", "f1").alias("f2"))


def significant_by(found: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """COL5-7, FLT9, FLT10, SET4, SET5: pairs of two different words at or over the
    threshold in some text column; ``region`` has the first letters of these columns, G for
    the reference, and ``mi2`` is the first one's, the reference before the others."""
    over = {c: F.col(f"mi2_{c}") >= threshold for c in columns}
    letter = lambda c: "G" if c == "reference" else c[0].upper()
    region = F.concat(*[F.when(over[c], letter(c)).otherwise("") for c in columns])
    shown = F.coalesce(*[F.when(over[c], F.col(f"mi2_{c}")) for c in columns])
    return found.where(F.col("w1") != F.col("w2")).select("w1", "w2", region.alias("region"), shown.alias("mi2")).where("region <> ''")


def report(found: DataFrame, threshold: float = 3.0) -> DataFrame:
    """COL4: how many pairs there are and how many at or over the threshold."""
    return found.agg(F.count("*").alias("pairs"), F.count_if(F.col("mi2") >= threshold).alias("significant"))


def venn(regions: DataFrame) -> DataFrame:
    """SNK6: the frame behind a Venn diagram: pairs by the sets they are in."""
    return regions.groupBy("region").agg(F.count("*").alias("pairs"))


def ranked(found: DataFrame, limit: int | None = None) -> DataFrame:
    """COL4, TOP3: by falling MI, ties by the pair."""
    rows = found.orderBy(F.desc("mi2"), "w1", "w2")
    return rows.limit(limit) if limit else rows


def significant(found: DataFrame, threshold: float = 3.0) -> DataFrame:
    """COL5, FLT9, FLT10, TXT25: of collocations in any order of their words, canonical pairs
    of two different words at or over a threshold; of a pair given twice the greater MI
    counts."""
    a, b, fa, fb = tx.unordered(F.col("w1"), F.col("w2"), F.col("f1"), F.col("f2"))
    return found.where((F.col("mi2") >= threshold) & (F.col("w1") != F.col("w2"))).select(a.alias("w1"), b.alias("w2"), F.struct("mi2", "f12", fa.alias("f1"), fb.alias("f2")).alias("m")).groupBy("w1", "w2").agg(F.max("m").alias("m")).select("w1", "w2", "m.*")
