"""Centroid clustering: plain Lloyd rounds in whole numbers.

Components become integers once.  In each round the centroids go to all tasks, NumPy
computes each vector's squared differences to one centroid after the other, the least
wins, and each partition emits one row of sums for each centroid and component.  Those
merge through a groupBy, so a round returns 66 numbers a centroid however many vectors
there are, and no vector moves after the first write.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialise
from vellum.sources.ship import ship

#: Components of a vector, and the number they are multiplied by.
SIZE, SCALE = 64, 1024
#: Integers below this in size have squared distances that fit 64 bits; others are
#: computed in Python's integers.
NARROW = 1 << 27
#: Components from here on in size do not count as finite.
WIDEST = 2.0**41
#: Numbers of the rows that hold a cluster's count and its summed distance.
COUNT, INERTIA = SIZE, SIZE + 1
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: the vectors that count, as 64 little-endian long integers."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            v = np.floor(x * SCALE).astype("<i8")
            yield pa.record_batch({"vec_id": batch["vec_id"], "v": pa.array([r.tobytes() for r in v], pa.binary())})

    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < WIDEST))
    rows = vectors.where(F.coalesce((F.size(x) == SIZE) & sound, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).mapInArrow(floors, "vec_id long, v binary")


def unpacked(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), "<i8").reshape(-1, SIZE)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the lowest of equally near ones, and the squared
    distance; the distances are Python integers where a component is wide."""
    wide = max((int(np.abs(x).max(initial=0)), *(abs(c) for row in centroids for c in row))) >= NARROW
    x = x.astype(object) if wide else x
    apart = np.empty((len(x), len(centroids)), object if wide else np.int64)
    for k, c in enumerate(centroids):
        d = x - np.array(c, object if wide else np.int64)
        apart[:, k] = (d * d).sum(axis=1)
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(x)), best]


def _sums(centroids: list[list[int]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [[0] * (SIZE + 2) for _ in centroids]
        for frame in frames:
            x = unpacked(frame["v"])
            best, apart = nearest(x, centroids)
            wide = bool(len(x)) and int(np.abs(x).max()) >= 1 << 40
            for k in np.unique(best).tolist():
                mine = best == k
                part = x[mine].astype(object) if wide else x[mine]
                more = [*part.sum(axis=0).tolist(), int(mine.sum()), sum(apart[mine].tolist())]
                total[k] = [a + b for a, b in zip(total[k], more, strict=True)]
        rows = [(k, d, Decimal(n)) for k, sums in enumerate(total) if sums[COUNT] for d, n in enumerate(sums)]
        yield pd.DataFrame(rows, columns=["cluster", "part", "total"])

    return run


def sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, list[int]]:
    """Of each cluster that has vectors: component sums, count and summed distance."""
    parts = vectors.select("v").mapInPandas(_sums(centroids), "cluster int, part int, total decimal(38,0)")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["cluster"], [0] * (SIZE + 2))[r["part"]] = int(r["total"])
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ``seed:vec_id`` has the smallest sha256; null ids come last,
    and rows of one id in the order of their components' bytes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("o"), "v").orderBy(F.col("o").asc_nulls_last(), "v").limit(k).collect()
    return [np.frombuffer(r["v"], "<i8").tolist() for r in rows]


def _placed(centroids: list[list[int]], cost: dict[int, int]):
    fits = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole, each = fits(sum(cost.values())), [fits(cost.get(k, 0)) for k in range(len(centroids))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best, apart = nearest(unpacked(frame["v"]), centroids)
            pick = lambda x: pd.Series([x[k] for k in best.tolist()], dtype=object)
            distance = pd.Series([fits(d) for d in apart.tolist()], dtype=object)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": best.astype("int32"), "distance": distance, "cluster_inertia": pick(each), "inertia": pd.Series([whole] * len(best), dtype=object), "centroid_sha256": pick(digest)})

    return run


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """One row per vector of 64 sound components: vec_id, cluster, distance,
    cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length or hold a null, non-finite or over-large
    component (2^41 and more) give no row.  Rows that repeat, an id or all of it, are
    vectors each; null ids stay.  With fewer than ``k`` vectors there are as many
    centroids as vectors; equal centroids leave the later ones empty, where they stay.
    A distance or sum beyond 64 bits is null.  An empty table gives none; other columns
    are not read.
    """
    ship(vectors.sparkSession)
    rows = materialise(integers(vectors), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], OUT)
    for _ in range(rounds):
        for c, total in sums(rows, centroids).items():
            centroids[c] = [t // total[COUNT] for t in total[:SIZE]]
    cost = {c: total[INERTIA] for c, total in sums(rows, centroids).items()}
    return rows.mapInPandas(_placed(centroids, cost), OUT)


def _oracle(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    floor_div = "(s - ((s % n) + n) % n) // n"
    parts = [
        f"kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"v AS MATERIALIZED (SELECT vec_id, generate_subscripts(e, 1) AS d, floor({SCALE} * unnest(e)::DOUBLE)::BIGINT AS x FROM kept)",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, d, x AS y FROM v JOIN firsts USING (vec_id))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, c, s FROM (SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS s FROM v JOIN c{i} USING (d) GROUP BY vec_id, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s, c) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{i} USING (vec_id) GROUP BY c, d)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, d, CASE WHEN n IS NULL THEN y ELSE {floor_div} END AS y FROM c{i} LEFT JOIN m{i} USING (c, d))")
    parts.append(f"digest AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INT AS cluster, s AS distance, sum(s) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(s) OVER ()::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN digest USING (c)"


ORACLE = _oracle()
