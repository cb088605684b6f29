"""Sequential alignment that finds its place again (ALN10).

Segments of one text are aligned to the other text of their book as rows of their own.
Where each belongs is told by k-grams that are minimal among their neighbours and occur
once in the other text: a segment's anchor is the offset that most of them agree on, and
a book keeps the heaviest chain of anchors in order.  So a lost or an added chapter shifts
nothing behind it.  Anchors are found in the row that has the book, in time and memory that grow with its
length; a segment takes with it what it may align to, in tiles if that is long, and its task does not
depend on the one before.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import text as tx
from vellum.operators.align import SPAN, aligner

#: Characters of a k-gram, k-grams of which the least stands for all, offsets that count as
#: one, and characters of a piece of text.
GRAM, NEAR, SAME, PIECE = 14, 8, 64, 4096
#: Compact characters looked at on either side of an anchored segment, and the ends of alignments
#: that a tile of a long stretch answers for.
SLACK, TILE = 250, 8192
#: Rows and characters that are given on at once.
ROWS, CHARACTERS = 512, 1 << 20
HASHED = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("pos", T.IntegerType())]))


def minimal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each k-gram that is the least of ``NEAR`` neighbours."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
    width = min(NEAR, n)
    least = np.unique(np.lib.stride_tricks.sliding_window_view(hashes, width).argmin(axis=1) + np.arange(n - width + 1))
    return hashes[least].view(np.int64), least


@F.pandas_udf(HASHED)
def minimal_grams(text: pd.Series) -> pd.Series:
    """:func:`minimal` as a Column, for short texts."""
    return pd.Series([None if t is None else [{"hash": h, "pos": p} for h, p in zip(*(x.tolist() for x in minimal(t)), strict=True)] for t in text], dtype=object)


def heaviest_chain(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of ``(seg, at, votes)`` the ``(seg, at)`` that rise in both and have most votes in all."""
    ends: list[int] = []  # ascending places; sums ascend with them
    best: list[tuple[int, int]] = []  # votes so far, index of the last row
    back: list[int] = []
    rows = sorted(rows)
    for i, (_, at, votes) in enumerate(rows):
        k = bisect_right(ends, at)
        total, before = (best[k - 1][0] + votes, best[k - 1][1]) if k else (votes, -1)
        back.append(before)
        stop = k
        while stop < len(ends) and best[stop][0] <= total:
            stop += 1
        if k and ends[k - 1] == at:
            k -= 1
        ends[k:stop], best[k:stop] = [at], [(total, i)]
    chain, i = [], best[-1][1] if best else -1
    while i >= 0:
        chain.append(rows[i][:2])
        i = back[i]
    return chain[::-1]


def pieces(books: DataFrame) -> DataFrame:
    """``doc_id, piece, part``: the compact text in pieces that overlap by a k-gram."""
    b = tx.compact(F.col("text"))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("b") - 1) / PIECE)).cast("int"))
    whole = books.select("doc_id", b.alias("b")).where("length(b) > 0")
    return whole.select("doc_id", F.posexplode(F.transform(at, lambda k: F.substring("b", k * PIECE + 1, F.lit(PIECE + GRAM - 1)))).alias("piece", "part"))


def anchors(segments: list[str], other: str) -> dict[int, int]:
    """Where in the other compact text anchored segments begin, by number."""
    grams = [minimal(other[k : k + PIECE + GRAM - 1]) for k in range(0, len(other), PIECE)]
    hashes, b = np.concatenate([h for h, _ in grams]), np.concatenate([p + k * PIECE for k, (_, p) in enumerate(grams)])
    known, first, times = np.unique(hashes, return_index=True, return_counts=True)
    known, b = known[times == 1], b[first[times == 1]]
    found = []
    for seg, text in enumerate(segments):
        own, a = minimal(text)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[at] == own if len(known) else np.zeros(len(own), bool)
        offset = np.sort(b[at[hit]] - a[hit])
        _, begin, votes = np.unique(offset // SAME, return_index=True, return_counts=True)
        if len(votes) and votes.max() >= 2:
            best = int(votes.argmax())  # of the most votes, the least offset
            found.append((seg, int(offset[begin[best]]), int(votes[best])))
    return dict(heaviest_chain(found))


def span_bound(n: int, gap_open: float = -1.0, gap_extend: float = -0.5, match: float = 1.0, mismatch: float = 0.0) -> int | None:
    """The most characters of the other text that a local alignment of n characters may lie over: gaps beyond cost
    more than all pairs give.  None without a bound."""
    if gap_extend >= 0 or gap_open > 0:
        return None
    return n + 1 + int(max(0.0, max(match, mismatch) * n + gap_open) / -gap_extend)


def windows(segments: list[str], other: str, **scores) -> Iterator[tuple[int, int, str, int, int, str]]:
    """``seg, tile, a, a_before, start, b``: what of the other compact text each segment is aligned to.

    A tile holds the whole of each alignment that ends in its last ``TILE`` characters, so the best
    alignment of all tiles is that of the whole stretch.
    """
    at = anchors(segments, other)
    highs, high = [], len(other)
    for seg in range(len(segments))[::-1]:
        highs.append(high)
        high = at.get(seg, high)
    low = before = 0
    for seg, (a, high) in enumerate(zip(segments, reversed(highs), strict=True)):
        n = len(a)
        start, stop = (max(0, at[seg] - SLACK), min(len(other), at[seg] + n + SLACK)) if seg in at else (max(0, low), high)
        bound = span_bound(n, **scores) or stop - start
        for tile, end in enumerate(range(start + bound, max(stop, start + bound + 1), TILE) if n and stop > start else ()):
            yield seg, tile, a, before, end - bound, other[end - bound : min(stop, end + TILE)]
        if seg in at:
            low = at[seg] + n
        before += n


def _cut(scores: dict):
    """The kernel of ``align_anchored``: books to segments with what they are aligned to."""

    def rows(held: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        values = zip(*held, strict=True)
        kinds = (ids, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["doc_id", "seg", "tile", "a", "a_before", "start", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop, held, size = str.maketrans("", "", "\n -"), [], 0
        for batch in batches:
            for key, segments, text in zip(*batch.columns, strict=True):
                own, other = [(s or "").translate(drop) for s in segments.as_py() or []], (text.as_py() or "").translate(drop)
                for row in windows(own, other, **scores) if own and other else ():
                    held.append((key.as_py(), *row))
                    size += len(row[2]) + len(row[5])
                    if len(held) >= ROWS or size > CHARACTERS:
                        yield rows(held, batch.schema.field(0).type)
                        held, size = [], 0
            if held:
                yield rows(held, batch.schema.field(0).type)
                held, size = [], 0

    return run


def align_anchored(books: DataFrame, **scores) -> DataFrame:
    """``books(doc_id, segments, text)`` to ``doc_id, seg, span``, offsets in the compact
    texts, spans in order and without overlap.

    Ids have to differ; null ids give no rows.  Segments without an anchor are aligned to all that lies between the
    anchored ones on either side, however long; empty or null texts and segments give no rows.
    """
    kind = books.schema["doc_id"].dataType.simpleString()
    cut = books.where("doc_id IS NOT NULL").select("doc_id", "segments", "text").mapInArrow(_cut(scores), f"doc_id {kind}, seg int, tile int, a string, a_before int, start int, b string")
    # tasks of few segments: the kernel costs far more than this shuffle
    tasks = max(32, int(books.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cut.repartition(tasks, "doc_id", "seg", "tile").select("doc_id", "seg", "tile", "a_before", "start", aligner("local", **scores)(F.col("a"), F.col("b")).alias("f")).where("size(f.spans) > 0")
    last = F.element_at("f.spans", -1)
    # of the best the one that ends first, in the tile that has it whole
    order = F.struct("f.score", -last["a_end"], -(last["b_end"] + F.col("start")), -F.col("tile"))
    best = found.groupBy("doc_id", "seg").agg(F.max_by(F.struct("a_before", "start", "f.spans"), order).alias("m"))
    rows = best.select("doc_id", "seg", "m.a_before", "m.start", F.explode("m.spans").alias("s"))
    shift = [(F.col(f"s.{c}_{e}") + F.col(by)).alias(f"{c}_{e}") for c, by in (("a", "a_before"), ("b", "start")) for e in ("start", "end")]
    return untangled(rows.select("doc_id", "seg", *shift))


def untangled(rows: DataFrame) -> DataFrame:
    """Spans by their place in a, each without what of b the spans before reach beyond."""
    before = Window.partitionBy("doc_id").orderBy("a_start").rowsBetween(Window.unboundedPreceding, -1)
    over: Column = F.greatest(F.lit(0), F.coalesce(F.max("b_end").over(before), F.lit(0)) - F.col("b_start"))
    cut = rows.withColumn("over", over).where("b_end - b_start > over")
    span = F.struct((F.col("a_start") + F.col("over")).alias("a_start"), "a_end", (F.col("b_start") + F.col("over")).alias("b_start"), "b_end").cast(SPAN)
    return cut.select("doc_id", "seg", span.alias("span"))
