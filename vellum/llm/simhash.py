"""SimHash near-dedup by tiled exact comparison.

A fingerprint has one bit for each bit that is set in over half of a text's shingle
hashes.  Distinct fingerprints are dealt to tiles by the bit counts of their sixteen-bit
parts.  Two fingerprints within the radius have counts that differ, summed over the parts,
by the radius at most; all other pairs of tiles are skipped, and what remains is compared
exactly with numpy's exclusive or and bit counts.  A large cell is split into several
tiles by hash, so that a tile has a bounded number of rows, and each pair of tiles gives
the links of a spanning forest, never all pairs of a dense group.

Comparisons grow with the square of the distinct fingerprints, with a factor of about 1.6
per cent for four parts; eight make that 0.04 per cent for 3.5 times the copies of each
tile, and are taken for more than ``FOUR_PARTS`` fingerprints.  Results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, materialise, slices
from vellum.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingle hashes counted at once; bounds memory for very long texts.
BLOCK = 1 << 15
#: Most distinct fingerprints that are dealt by four parts.
FOUR_PARTS = 1 << 24


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    last = max(1, len(words) - width + 1)
    cuts = zip(starts[:last].tolist(), (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(line)], strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in cuts), np.uint64, last)
    counts = np.zeros(64, np.int64)
    for a, b in slices(last, BLOCK):
        counts += np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64).view(np.int64)
        yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array(prints)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp long`` of whole texts; null text has fingerprint zero."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def near_cells(parts: int, radius: int) -> list[int]:
    """Differences of packed part counts that a pair within the radius can have, one of
    each pair of opposite differences, and zero."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return sorted(sum(x * 128**i for i, x in enumerate(d)) for d in steps if d >= (0,) * parts)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest over the given links."""
    parent: dict[int, int] = {}
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = x, y
        while parent.get(rx, rx) != rx:
            parent[rx] = rx = parent.get(parent[rx], parent[rx])
        while parent.get(ry, ry) != ry:
            parent[ry] = ry = parent.get(parent[ry], parent[ry])
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _linker(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: batch[k] for k in ("fa", "na", "fb", "nb")}
            flat = {k: c.flatten().to_numpy(zero_copy_only=False) for k, c in cols.items()}
            at = {k: np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False)))) for k, c in cols.items()}
            left, right = [], []
            for i, same in enumerate(batch["same"].to_pylist()):
                pick = lambda k, i=i: flat[k][at[k][i] : at[k][i + 1]]
                differ = np.bitwise_count(pick("fa").view(np.uint64)[:, None] ^ pick("fb").view(np.uint64)[None, :])
                x, y = np.nonzero(np.triu(differ <= radius, 1) if same else differ <= radius)
                if len(x):
                    links = _forest(pick("na")[x], pick("nb")[y])
                    left += [p for p, _ in links]
                    right += [q for _, q in links]
            yield pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return compare


def fingerprint_links(nodes: DataFrame, radius: int = 2, parts: int = 4, tile: int = 1024) -> DataFrame:
    """``nodes(fp, node)`` with distinct fp to ``(a, b)`` nodes: spanning links of every
    pair of tiles, over all pairs within the radius."""
    bits = 64 // parts
    count = [F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit((1 << bits) - 1))).cast("long") * 128**i for i in range(parts)]
    celled = nodes.withColumn("cell", sum(count[1:], count[0]))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("split"))
    dealt = celled.join(sizes, "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), "split"))
    tiles = materialise(
        dealt.groupBy("cell", "sub").agg(F.collect_list(F.struct("fp", "node")).alias("x")).select("cell", "sub", F.col("x.fp").alias("f"), F.col("x.node").alias("n")),
        "tiles",
    )
    one = tiles.select(F.col("f").alias("fa"), F.col("n").alias("na"), F.col("sub").alias("sub_a"), F.explode(F.array(*[F.lit(d).cast("long") for d in near_cells(parts, radius)])).alias("d"), "cell")
    one = one.withColumn("cell", F.col("cell") + F.col("d"))
    two = tiles.select("cell", F.col("f").alias("fb"), F.col("n").alias("nb"), F.col("sub").alias("sub_b"))
    pairs = one.join(two, "cell").where("d <> 0 OR sub_a <= sub_b")
    bounded_batches(nodes.sparkSession, 500)
    return pairs.select("fa", "na", "fb", "nb", F.expr("d = 0 AND sub_a = sub_b").alias("same")).mapInArrow(_linker(radius), "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 2, parts: int | None = None, tile: int = 1024) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint zero and link like any other.  Rows that
    repeat a doc_id are that document, so its texts are linked.  A row without doc_id has
    a fingerprint, but links with nothing and has a null component_id.
    """
    prints = materialise(fingerprints(docs), "simhash")
    nodes = materialise(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    parts = parts or (4 if nodes.count() <= FOUR_PARTS else 8)
    again = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    one = prints.join(again.select("doc_id", "lo"), "doc_id").join(nodes, "fp").select(F.col("node").alias("a"), F.col("lo").alias("fp"))
    same = one.join(nodes, "fp").select("a", F.col("node").alias("b"))
    found = components(fingerprint_links(nodes, radius, parts, tile).union(same))
    labelled = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labelled, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
