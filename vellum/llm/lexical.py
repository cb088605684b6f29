"""Ranked lexical search over a bit-sliced impact index.

Documents are numbered within blocks.  For each term that is asked for, a block holds the
documents with it and, for each binary digit of their impacts, a bitmap of those whose
impact has it.  A query adds its terms' bitmaps digit by digit with carries, which sums
all documents' scores at once, and finds the best from the most significant slice down.

Texts are read once, where they lie, into blocks of postings; only these are written.
Corpus counts are sums over them.  The index and the search need no shuffle: each task
keeps the best of its blocks for each query, and only those meet.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, materialise

#: A block ends at so many documents or postings.
DOCS, POSTINGS = 1 << 14, 1 << 20
#: About so many terms of queries are searched for at once.
ASKED = 1 << 16
#: Bytes of UTF-8: A-Z in lower case, what is no part of a term as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLOCK = "doc_id array<bigint>, n array<bigint>, term array<int>, size array<int>, pos array<int>, tf array<bigint>"
INDEX = "doc_id array<bigint>, term array<int>, pos array<binary>, slices array<array<binary>>"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def impact(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [sorted(Counter(terms(t)).items()) for t in batch["text"].to_pylist()]
        yield pa.record_batch({"item_id": batch["item_id"], "term": pa.array([[t for t, _ in c] for c in counts], pa.list_(pa.binary())), "times": pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int64()))})


def _block(docs: list[tuple[int | None, int]], post: tuple[array, array, array]) -> pa.RecordBatch:
    """One row: the block's documents by id, null ids last, and its postings by term."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    place = np.empty(len(docs), np.int32)
    place[order] = np.arange(len(docs), dtype=np.int32)
    term, at, tf = (np.frombuffer(p, p.typecode) for p in post)
    pos = place[at] if len(at) else at
    by = np.lexsort((pos, term))
    found, size = np.unique(term, return_counts=True)
    one = lambda v, kind: pa.array([v], pa.list_(kind))
    return pa.record_batch({
        "doc_id": one([docs[i][0] for i in order], pa.int64()), "n": one([docs[i][1] for i in order], pa.int64()), "term": one(found.astype(np.int32), pa.int32()),
        "size": one(size.astype(np.int32), pa.int32()), "pos": one(pos[by].astype(np.int32), pa.int32()), "tf": one(tf[by].astype(np.int64), pa.int64()),
    })


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = shared.value
        asked = number.keys()
        docs, post = [], (array("i"), array("i"), array("q"))
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = terms(text.as_py())
                count = Counter(words)
                for t in count.keys() & asked:
                    for p, v in zip(post, (number[t], len(docs), count[t]), strict=True):
                        p.append(v)
                docs.append((doc_id, len(words)))
                if len(docs) >= DOCS or len(post[0]) >= POSTINGS:
                    yield _block(docs, post)
                    docs, post = [], (array("i"), array("i"), array("q"))
        if docs:
            yield _block(docs, post)

    return run


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Blocks of documents, with their lengths and the postings of the terms in ``number``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_postings(spark.sparkContext.broadcast(number)), BLOCK)


def weights(blocks: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with terms, terms in all, and the weight of each term that occurs."""
    own = blocks.select(F.size(F.filter("n", lambda x: x > 0)).cast("long").alias("docs"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"))
    total = own.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    df = blocks.select(F.inline(F.arrays_zip("term", "size"))).groupBy("term").agg(F.sum("size").alias("df")).collect()
    n = total["docs"]
    return n, total["terms"], {r["term"]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in df}


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
    """Each row's lists, one row at a time."""
    for i in range(len(batch)):
        yield {name: batch[name][i].values for name in batch.schema.names}


def _sliced(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_terms, weight = shared.value
        for batch in batches:
            for r in _rows(batch):
                m = np.array([25 + 75 * n * n_docs // max(n_terms, 1) for n in r["n"].to_pylist()], np.int64)
                ends = np.cumsum([0, *r["size"].to_pylist()])
                at, tf = r["pos"].to_numpy(), r["tf"].to_numpy()
                kept, pos, slices = [], [], []
                for t, a, b in zip(r["term"].to_pylist(), ends[:-1], ends[1:], strict=True):
                    value = impact(weight[t], tf[a:b], m[at[a:b]])
                    digits = int(value.max()).bit_length()
                    if digits:
                        kept.append(t)
                        pos.append(at[a:b].astype("<u2").tobytes())
                        bits = (value[None, :] >> np.arange(digits)[:, None] & 1).astype(np.uint8)
                        slices.append([s.tobytes() for s in np.packbits(bits, axis=1, bitorder="little")])
                yield pa.record_batch({"doc_id": pa.array([r["doc_id"].to_pylist()], pa.list_(pa.int64())), "term": pa.array([kept], pa.list_(pa.int32())), "pos": pa.array([pos], pa.list_(pa.binary())), "slices": pa.array([slices], pa.list_(pa.list_(pa.binary())))})

    return run


def index(blocks: DataFrame) -> DataFrame:
    """The impact index of written ``postings``: for each block its documents, and for each
    term the documents with it and bitmaps over these, least significant digit first."""
    spark = blocks.sparkSession
    return blocks.select("doc_id", "n", "term", "size", "pos", "tf").mapInArrow(_sliced(spark.sparkContext.broadcast(weights(blocks))), INDEX)


def spread(pos: bytes, slices: list[bytes], n: int) -> list[int]:
    """Bitmaps over a term's documents as bitmaps, whole numbers, over the block's ``n``."""
    at = np.frombuffer(pos, "<u2")
    packed = np.frombuffer(b"".join(slices), np.uint8).reshape(len(slices), -1)
    wide = np.zeros((len(slices), n), np.uint8)
    wide[:, at] = np.unpackbits(packed, axis=1, count=len(at), bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(wide, axis=1, bitorder="little")]


def add(total: list[int], part: list[int], shift: int = 0) -> None:
    """Add ``part``, moved up by ``shift`` digits, to the sums in ``total``."""
    carry, i = 0, shift
    total += [0] * (shift + len(part) - len(total))
    for b in part:
        a = total[i]
        odd = a ^ b
        total[i] = odd ^ carry
        carry = a & b | carry & odd
        i += 1
    while carry:
        if i == len(total):
            total.append(0)
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


def best(total: list[int], k: int) -> list[int]:
    """Places of the ``k`` highest sums above 0, of equal ones the first places."""
    sure, open_ = 0, reduce(int.__or__, total, 0)
    left = k
    for s in reversed(total):
        top = open_ & s
        n = top.bit_count()
        if n > left:
            open_ = top
        else:
            sure, open_, left = sure | top, open_ & ~s, left - n
        if not left:
            break
    out = []
    for group, most in ((sure, k), (open_, left)):
        while group and most:
            low = group & -group
            out.append(low.bit_length() - 1)
            group, most = group ^ low, most - 1
    return out


def _found(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        users: dict[int, list[tuple[int, int]]] = {}
        for q, (_, asked) in enumerate(items):
            for t, times in asked:
                users.setdefault(t, []).append((q, times))
        top: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            for r in _rows(batch):
                ids = r["doc_id"].to_pylist()
                totals: list[list[int]] = [[] for _ in items]
                for t, pos, slices in zip(r["term"].to_pylist(), r["pos"], r["slices"], strict=True):
                    part = spread(pos.as_py(), slices.as_py(), len(ids))
                    for q, times in users[t]:
                        for shift in range(times.bit_length()):
                            if times >> shift & 1:
                                add(totals[q], part, shift)
                for q, total in enumerate(totals):
                    for place in best(total, k):
                        score = sum((s >> place & 1) << i for i, s in enumerate(total))
                        top[q].append((-score, ids[place] is None, ids[place] or 0))
                    top[q] = sorted(top[q])[:k]
        rows = [(q, items[q][0], None if none else doc, -score) for q, own in enumerate(top) for score, none, doc in own]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch({"query": pa.array(cols[0], pa.int32()), "item_id": pa.array(cols[1], pa.int64()), "doc_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``k`` documents of each item.

    Null texts have no terms.  Rows of ``documents`` are documents each, also where they
    repeat an id; of equal scores the smaller doc_id comes first and null ids last.  Rows
    of items that repeat an id are items of their own; an item without a term that occurs
    gives no row.  Scores and counts must fit 64 bits.  Empty tables give none; other
    columns are not read.

    Items are searched for together up to about 2^16 distinct terms of theirs; more are
    dealt, by a hash, into as many passes over ``docs`` as that takes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_queries, "item_id long, term array<binary>, times array<bigint>")
    asked = materialise(asked.where(F.size("term") > 0), "items")
    entries = asked.agg(F.coalesce(F.sum(F.size("term")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-entries // ASKED))
    found = []
    for p in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "term"), F.lit(passes)) == p).collect()
        number = {t: i for i, t in enumerate(sorted({bytes(t) for r in mine for t in r["term"]}))}
        blocks = materialise(postings(docs, number), "postings")
        known = spark.sparkContext.broadcast([(r["item_id"], [(number[bytes(t)], n) for t, n in zip(r["term"], r["times"], strict=True)]) for r in mine])
        part = index(blocks).mapInArrow(_found(known, k), "query int, item_id long, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found.append(part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
ORACLE = f"""WITH t AS MATERIALIZED (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, docs),
p AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM p WHERE score > 0 QUALIFY rank <= 10"""
