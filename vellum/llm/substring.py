"""Substring dedup by sliding sentence spans.

Texts are cut into sentences, and long sentences at words marked by their neighbours.
Runs of at least two consecutive pieces with enough words are spans.  A long run repeats
only where the shorter runs in it do, and of these the shortest from each piece on and up
to each cover it; so these are hashed (two 64-bit sums over the words' hashes), and give
what hashing every run would.  One aggregation finds the hashes that occur more than once
in the corpus, joins give their places, and pieces that a place other than the first
covers are removed.

The aggregations combine before their shuffles, so a passage that many documents share
costs a row per task; the joins' skewed partitions are split by adaptive execution.  Only
hashes and positions are shuffled to find spans; texts are shuffled once, to meet what
they lose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, drop_tables, materialise

#: A span has this many words and two pieces at least.
WORDS = 24
#: A sentence is cut after each word whose hash, with the word before it, is the least
#: among so many on either side, all of them in the sentence.
AROUND = 4
TOKEN = re.compile(r"\S+\s*")
END = re.compile(r"[.!?][\"')\]]*\s|\n")
#: Words whose hashes a Python worker keeps; about 200 bytes each.
KEPT = 300_000
#: Fixed odd multipliers of the two sums.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class Words(dict):
    """Hash of a word in lower case, and whether it ends a sentence as the lowest bit, by
    the word and the white space behind it."""

    def __missing__(self, token: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = xxhash.xxh64_intdigest(token.rstrip().lower().encode("utf-8", "surrogatepass")) & ~1 | bool(END.search(token))
        self[token] = h
        return h


_words = Words()


def pieces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the pieces of a text in characters, and in words; the words' hashes.

    A cut depends on the punctuation at it or on the few words around it alone, so a
    passage is cut alike wherever it stands, but for some words at its ends.
    """
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not n:
        return np.array([0, len(text)] if text else [0]), np.array([0, 0] if text else [0]), np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, tokens), np.uint64, n)
    size = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(size) + len(text) - int(size.sum())
    last = (h & np.uint64(1)).astype(bool)
    last[-1] = True
    pair = (h ^ (np.concatenate((h[:1], h[:-1])) * np.uint64(BASES[0]))) * np.uint64(BASES[1])
    low = np.zeros(n, bool)
    if n > 2 * AROUND:
        inner = pair[AROUND : n - AROUND]
        least = np.ones(len(inner), bool)
        for d in range(1, AROUND + 1):
            least &= (inner < pair[AROUND - d : n - AROUND - d]) & (inner <= pair[AROUND + d : n - AROUND + d])
        sentence = np.cumsum(last) - last
        low[AROUND : n - AROUND] = least & (sentence[: n - 2 * AROUND] == sentence[2 * AROUND :])
    at = np.nonzero(last | low)[0]
    return np.concatenate(([0], ends[at])), np.concatenate(([0], at + 1)), h


def sentences(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, words)`` of the pieces, which cover the text."""
    chars, words, _ = pieces(text)
    return list(zip(chars[:-1].tolist(), chars[1:].tolist(), np.diff(words).tolist(), strict=True))


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First pieces and ends of the shortest spans from each piece on and up to each, out
    of the pieces' bounds in words."""
    n = len(words) - 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.arange(n)
    j = np.maximum(np.searchsorted(words, words[:-1] + WORDS), i + 2)
    end = np.arange(1, n + 1)
    start = np.minimum(np.searchsorted(words, words[1:] - WORDS, "right") - 1, end - 2)
    code = np.unique(np.concatenate(((i * (n + 1) + j)[j <= n], (start * (n + 1) + end)[start >= 0])))
    return code // (n + 1), code % (n + 1)


def spans(text: str, cuts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First piece, number of pieces and the two sums of each span."""
    _, words, h = cuts or pieces(text)
    i, j = runs(words)
    a, b = words[i], words[j]
    sums = []
    for base in BASES:
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h), base, np.uint64))))
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h), pow(base, -1, 1 << 64), np.uint64))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(((h | np.uint64(1)) * power[:-1]), dtype=np.uint64)))
        sums.append(((total[b] - total[a]) * back[a]).view(np.int64))
    return i, j - i, sums[0], sums[1]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts = [pieces(t.as_py() or "") for t in batch["text"]]
        found, counts = [spans("", c) for c in cuts], [len(c[0]) - 1 for c in cuts]
        at = np.concatenate((np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), np.arange(len(counts)))).astype(np.int64)
        join = lambda k, more: np.concatenate([f[k] for f in found] + [more]).astype(np.int64)
        none = np.zeros(len(counts), np.int64)
        cols = {"pos": join(0, none - 1), "n": join(1, np.array(counts, np.int64)), "h": join(2, none), "g": join(3, none)}
        yield pa.record_batch({"doc_id": batch["doc_id"].take(pa.array(at)), "k": batch["k"].take(pa.array(at))} | {c: pa.array(v.astype(np.int32) if c in ("pos", "n") else v) for c, v in cols.items()})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
            if not gone:
                rows.append((text, 0, 0))
                continue
            cuts = sentences(text)
            lost = {i for s in gone for i in range(s["pos"], s["pos"] + s["n"])}
            rows.append(("".join(text[a:b] for i, (a, b, _) in enumerate(cuts) if i not in lost), len(lost), sum(cuts[i][2] for i in lost)))
        text, lost, words = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array(text, pa.string()), "n_sentences": batch["n_sentences"], "n_removed": pa.array(lost, pa.int64()), "words_removed": pa.array(words, pa.int64())})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text without repeats, n_sentences, n_removed,
    words_removed.

    The first place is the one with the least doc_id, then the least position; null ids
    come last.  Null text stays null and empty text empty, with no sentences.  Rows that
    repeat an id and text are one document: neither takes from the other.  An empty table
    gives none; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    # tells rows of one id, or none, apart: in the order of their texts' hash, then by 128 bits
    order = F.lpad(F.hex(F.hash("text").cast("long") + F.lit(1 << 31)), 8, "0")
    digest = F.unhex(F.concat(order, F.coalesce(F.md5(text.cast("binary")), F.lit(""))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("k"), text.alias("text"))
    found = materialise(rows.mapInArrow(_find, "doc_id long, k binary, pos int, n int, h long, g long"), "spans")
    spans_ = found.where("pos >= 0")
    # written, so that both sides of each join are plain shuffles, whose skew is split
    often = materialise(spans_.groupBy("h", "g").agg(F.count("*").alias("times")).where("times > 1").select("h", "g"), "often")
    places = materialise(spans_.join(often, ["h", "g"], "left_semi"), "places")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "pos")
    first = materialise(places.groupBy("h", "g").agg(F.min(place).alias("first")), "firsts")
    gone = places.join(first, ["h", "g"]).where(place != F.col("first")).select("doc_id", "k", "pos", "n")
    every = gone.unionByName(found.where("pos < 0").select("doc_id", "k", "pos", "n"))
    known = every.groupBy("doc_id", "k").agg(
        F.collect_set(F.when(F.col("pos") >= 0, F.struct("pos", "n"))).alias("gone"), F.max(F.when(F.col("pos") < 0, F.col("n"))).cast("long").alias("n_sentences")
    )
    known = materialise(known.select(F.col("doc_id").alias("d"), F.col("k").alias("t"), "gone", "n_sentences"), "repeats")
    drop_tables(found, often, places, first)
    both = rows.join(known, rows["doc_id"].eqNullSafe(known["d"]) & (rows["k"] == known["t"]), "left")
    return both.select("doc_id", "text", "gone", "n_sentences").mapInArrow(_cut, "doc_id long, text string, n_sentences long, n_removed long, words_removed long")
