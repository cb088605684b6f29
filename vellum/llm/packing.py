"""Packing by concatenation and cutting, with two-pass prefix sums.

The first pass tokenises each partition's documents in their order, keeps their ids and
writes, beside each document, the tokens before it in its partition.  The totals of the
partitions (one row each) are then summed up over the partitions, which gives every
document its offset in the corpus.  The second pass cuts at the multiples of the window;
a document that crosses one yields a boundary record on each side.  The totals are sent
to all tasks if their number allows, so no document moves between the passes, and only
the last sequence is padded.

Tokenising whole texts is bounded by new words: ids are kept by white-space-delimited
piece, which is exact because no token of this vocabulary spans white space.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, cut, materialise

WINDOW = 4096
#: Partition totals, of twelve bytes, that are sent to all tasks; more are joined by a shuffle.
MOST_PARTS = 1_000_000
END_ID = 2
#: What one of Python and the vocabulary takes for white space, but a space or line feed.
ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A sign, not a letter or number, before a full stop or comma: they are split together.
RUN_ON = re.compile(r"[.,] (?<=(?:[^\w ]|_)[.,] )")
#: Pieces of a generation whose ids are kept in a Python worker, about 250 bytes each.
KEPT = 350_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Pieces(dict):
    """Ids of white-space-delimited pieces of normalised text, packed little-endian.

    A word of letters goes straight to the vocabulary's merges; any other piece goes
    through the tokenizer whole.  Kept in two generations, so that words in use stay and
    memory is bounded.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        wide = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) >= 1 << 16
        self.dtype, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.normal, self.merge = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            if piece.isalpha():
                tokens = self.merge(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))
                ids = array(self.code, [t.id for t in tokens]).tobytes()
            else:
                ids = array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # might name a special token, which is matched before lower-casing
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, pieces(text, self.normal)))


def pieces(text: str, normal: Callable[[str], str]) -> list[str]:
    """Normalised text split at white space, and before the full stop or comma that alone
    follows a letter or number, where the vocabulary's own splitting does.

    Python's own lower case and composition check stand in for the vocabulary's
    normaliser, ten times slower, wherever the two agree.
    """
    if "\u03a3" not in text and not ODD_SPACE.search(text) and (text.isascii() or is_normalized("NFC", text)):
        line = f"{text.lower()} ".replace("\n", " ")
        return (line if RUN_ON.search(line) else line.replace(". ", " . ").replace(", ", " , ")).split()
    return [p for p in normal(text).split(" ") if p]


def byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as its Latin-1 sign if that is printable, and
    the others, in order, as the signs from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_loaded: dict[str, Pieces] = {}


def _pieces(vocabulary: str) -> Pieces:
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Pieces(vocabulary)
    return _loaded[vocabulary]


def _tokeniser(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces(vocabulary)
        end = np.asarray([end_id], known.dtype).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [known.encode(t.as_py() or "") + end for t in batch["text"]]
            n = np.array([len(x) // known.dtype.itemsize for x in ids], np.int64)
            begin = before + np.concatenate(([0], np.cumsum(n)))[:-1].astype(np.int64)
            before += int(n.sum())
            yield pa.record_batch({
                "part": pa.array(np.full(len(n), part, np.int32)), "begin": pa.array(begin), "doc_id": batch["doc_id"],
                "n": pa.array(n), "ids": pa.array(ids, pa.binary()), "wide": pa.array(np.full(len(n), known.dtype.itemsize, np.int32)),
            })

    return run


def _cutter(window: int):
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, doc = [], []
            for begin, n, ids, wide, k in zip(*(batch[c].to_pylist() for c in ("at", "n", "ids", "wide")), range(len(batch)), strict=True):
                ids = np.frombuffer(ids, f"<u{wide}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(begin + start, window)
                    length = min(n - start, window - offset)
                    rows.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), n, sequence, offset))
                    doc.append(k)
                    start += length
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.record_batch({"doc_id": batch["doc_id"].take(pa.array(doc, pa.int64()))} | {c: pa.array(v, pa.int64()) for c, v in zip(names, cols, strict=True)})

    return run


def tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """First pass: ``part, begin, doc_id, n, ids, wide`` as a scratch table."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(
        rows.mapInArrow(_tokeniser(vocabulary or default_vocabulary(), end_id), "part int, begin long, doc_id long, n long, ids binary, wide int"),
        "tokens",
    )


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty, that is, just the end id; null and repeated ids are documents of
    their own; an empty table has no sequence.  Each id lies in exactly one piece.
    """
    table = tokens(docs, vocabulary, end_id)
    ordered = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy("part").agg(F.max(F.col("begin") + F.col("n")).alias("total"))
    ahead = cut(totals.select("part", F.coalesce(F.sum("total").over(ordered), F.lit(0)).alias("ahead")))
    if ahead.count() <= MOST_PARTS:
        ahead = F.broadcast(ahead)
    placed = table.join(ahead, "part").select("doc_id", (F.col("ahead") + F.col("begin")).alias("at"), "n", "ids", "wide")
    return placed.mapInArrow(_cutter(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
