"""Embedding near-dedup by NN-descent.

Equal vectors are collapsed first.  A neighbour graph starts from random-projection
blocks, of so many trees that a lone pair of linked vectors shares a block whatever the
size of the table; neighbours-of-neighbours joins refine it: around each node its
neighbours and those it is a neighbour of are compared, and whatever enters a list is
kept, until a round adds next to nothing.  Only similarities above ``floor`` enter lists,
which leaves unrelated vectors without any.

A list of ``k`` is saturated when it is full of links.  Lists are then enlarged to their
whole component: links found in any block, also those beyond the lists, connect nodes
(as spanning forests), and the members of each component are compared exactly, in double
precision, tile by tile.  So counts of links are exact within what is connected, and a
dense group costs comparisons in bounded tiles, never a row for each pair.

Recall is audited on a bounded sample of queries against all vectors, for each size of
group by itself; if it falls short, further blocks are drawn and the graph is refined
again, and if it still does, all vectors are compared, tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, cut, drop_tables, materialise, slices
from vellum.llm.components import components

SIMILAR = 0.9
#: Chance that a lone linked pair shares a block; trees dealt at once; vectors sent to all
#: tasks at once in the exact pass.
TOGETHER, DEALT, SLAB = 0.99, 16, 8192
#: Rows of at most forty bytes that are sent to all tasks for a join; more are shuffled.
SENT = 500_000
#: Tiles of a component that are compared pairwise by a shuffle, which sends each vector
#: once a tile; members of larger ones are compared with slabs that are sent to all tasks.
TILES = 32
#: Rows around hubs that a task compares as one Arrow group.
GROUP = 8192


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of n nodes: for each node the path to its least
    neighbour's label, found by repeated halving."""
    label = np.arange(n)
    left, right = [], []
    while len(x):
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        keep = lo != hi
        x, y, lo, hi = x[keep], y[keep], lo[keep], hi[keep]
        if not len(x):
            break
        tops, first = np.unique(hi, return_index=True)
        left.append(x[first])
        right.append(y[first])
        label[tops] = lo[first]
        while (label[label] != label).any():
            label = label[label]
    return (np.concatenate(left), np.concatenate(right)) if left else (x[:0], y[:0])


def _compare(ids: np.ndarray, v: np.ndarray, k: int, floor: float, link: float) -> pd.DataFrame:
    """Best k neighbours above the floor of each row of a block (kind 0), and a spanning
    forest of all its links (kind 1)."""
    s = v @ v.T
    np.fill_diagonal(s, -2)
    x, y = np.nonzero(s >= floor)
    if not len(x):
        return pd.DataFrame({"a": ids[:0], "b": ids[:0], "sim": s[:0, 0], "kind": np.zeros(0, np.int32)})
    order = np.lexsort((-s[x, y], x))
    x, y = x[order], y[order]
    place = np.arange(len(x)) - np.searchsorted(x, x, "left")
    top = place < k
    m = (s[x, y] >= link) & (x < y)
    p, q = _forest(len(ids), x[m], y[m])
    return pd.DataFrame({"a": np.r_[ids[x[top]], ids[p]], "b": np.r_[ids[y[top]], ids[q]], "sim": np.r_[s[x[top], y[top]], s[p, q]], "kind": np.r_[np.zeros(top.sum(), np.int32), np.ones(len(p), np.int32)]})


def _block_graph(k: int, floor: float, link: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        return _compare(block["id"].to_numpy(), np.stack(block["v"]), k, floor, link)

    return run


def _hub_graph(k: int, floor: float, link: float):
    """As :func:`_block_graph`, for all blocks of a group by itself."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["hub", "sub"], kind="stable")
        ids, v = part["id"].to_numpy(), np.stack(part["v"])
        key = part[["hub", "sub"]].to_numpy()
        ends = [*(np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1), len(part)]
        found = [_compare(ids[a:b], v[a:b], k, floor, link) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pd.concat(found, ignore_index=True)

    return run


GRAPH = "a long, b long, sim double, kind int"


def _divided(by: str) -> Column:
    """``v`` over a number.  As an argument of the lambda function the number is computed
    once a row; as an outer column the optimizer would inline it for each component."""
    return F.zip_with("v", F.array_repeat(by, F.size("v")), lambda x, y: x / y + F.lit(0.0))


def clean(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, key``: vectors of finite numbers, not all zero, scaled to length one,
    and a digest that is the same for equal ones (adding zero drops its sign)."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    big = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL").where(F.size("v") > 0).where(~bad)
    rows = rows.withColumn("_m", big).where("_m > 0").withColumn("v", _divided("_m"))
    rows = rows.withColumn("_n", norm).select("vec_id", _divided("_n").alias("v"))
    return rows.withColumn("key", F.unhex(F.sha2(F.col("v").cast("string"), 256)))


def code_bits(n: int, leaf: int) -> int:
    """Hyperplanes that part n vectors into blocks of half a leaf."""
    return max(0, int(np.ceil(np.log2(max(1, n / (leaf / 2))))))


def trees_for(n: int, leaf: int, link: float, least: int) -> int:
    """Trees after which two vectors at similarity ``link`` share a block with chance
    ``TOGETHER``: narrower blocks take more."""
    p = (1 - np.arccos(np.clip(link, -1, 1)) / np.pi) ** code_bits(n, leaf)
    return max(least, int(np.ceil(np.log(1 - TOGETHER) / np.log1p(-p)))) if 0 < p < 1 else least


def blocks(nodes: DataFrame, n: int, trees: int, first: int, leaf: int) -> DataFrame:
    """``tree, dim, code, id``: the signs of each vector under random hyperplanes."""
    bits = code_bits(n, leaf)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                v = np.stack(part["v"])
                for tree in range(first, first + trees):
                    planes = np.random.default_rng([tree, dim]).normal(size=(dim, bits))
                    code = (v @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(v), np.int64)
                    yield pd.DataFrame({"tree": np.int32(tree), "dim": np.int32(dim), "code": code, "id": part["id"].to_numpy()})

    return nodes.select("id", "v", F.size("v").alias("dim")).mapInPandas(deal, "tree int, dim int, code long, id long")


def sent(small: DataFrame) -> DataFrame:
    """A checkpointed table of a row for a block, broadcast if they are few enough."""
    return F.broadcast(small) if small.count() <= SENT else small


def narrowed(dealt: DataFrame, nodes: DataFrame, leaf: int, deepest: int = 8) -> DataFrame:
    """``dealt`` with each block over ``leaf`` cut at the medians of random projections of
    its own members, again until none is left."""
    key = ["tree", "dim", "code"]
    for depth in range(deepest):
        bits = F.least(F.lit(8), F.ceil(F.log2(F.col("size") / (leaf / 2)))).cast("int")
        over = cut(dealt.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > leaf).select(*key, bits.alias("bits")))
        if over.isEmpty():
            break

        def project(batches: Iterator[pd.DataFrame], depth: int = depth) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for (tree, dim), part in batch.groupby(["tree", "dim"]):
                    planes = np.random.default_rng([tree, dim, depth + 1]).normal(size=(dim, 8))
                    p = np.stack(part["v"]) @ planes
                    yield part[[*key, "id"]].assign(p=[x[:m] for x, m in zip(p, part["bits"], strict=True)])

        over = sent(over)
        full = dealt.join(over, key).join(nodes, "id").select(*key, "id", "bits", "v")
        placed = materialise(full.mapInPandas(project, "tree int, dim int, code long, id long, p array<double>"), "projected")
        middle = placed.select(*key, F.posexplode("p").alias("at", "x")).groupBy(*key, "at").agg(F.percentile_approx("x", 0.5, 1000).alias("x"))
        middle = middle.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("middle"))
        middle = sent(cut(middle))
        side = F.zip_with("p", "middle", lambda x, m: x > m)
        parted = placed.join(middle, key).select("tree", "dim", F.xxhash64("code", F.lit(depth), side).alias("code"), "id")
        dealt = materialise(dealt.join(over, key, "left_anti").select(*key, "id").union(parted), "blocks")
    return dealt


def graph(nodes: DataFrame, n: int, trees: int, first: int, k: int, floor: float, link: float, leaf: int) -> DataFrame:
    """What the blocks of all trees show.  A large block is narrowed; one that no
    projection parts holds vectors within rounding of each other, and is split at random."""
    dealt = narrowed(materialise(blocks(nodes, n, trees, first, leaf), "blocks"), nodes, leaf)
    key = ["tree", "dim", "code"]
    sizes = sent(cut(dealt.groupBy(key).agg(F.ceil(F.count("*") / leaf).alias("split"))))
    split = dealt.join(sizes, key).withColumn("sub", F.pmod(F.xxhash64("id", "tree"), "split"))
    return split.select(*key, "sub", "id").join(nodes, "id").groupBy(*key, "sub").applyInPandas(_block_graph(k, floor, link), GRAPH)


def lists(found: DataFrame, k: int) -> DataFrame:
    """The best k of each node's neighbours, from both directions of what was found."""
    both = found.select("a", "b", "sim").union(found.select("b", "a", "sim")).distinct()
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return both.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def refine(near: DataFrame, nodes: DataFrame, n: int, k: int, floor: float, link: float, turn: int = 0) -> DataFrame:
    """One neighbours-of-neighbours join: around each node, its list, itself, and all in
    whose lists it is; where these are many they are dealt into several blocks, other
    ones each turn.  Vectors of different lengths are never in one list.  Many blocks are
    compared in one group: a block holds at most a few dozen rows, so groups stay near
    ``GROUP`` rows at any size."""
    around = near.select(F.col("a").alias("hub"), F.col("b").alias("id")).union(near.select(F.col("b"), F.col("a"))).distinct()
    sizes = materialise(around.groupBy("hub").agg(F.ceil(F.count("*") / (3 * k)).alias("split")), "hubs")
    dealt = around.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("id", "hub", F.lit(turn)), "split").alias("sub"), "id")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("split") - 1)).alias("sub"), F.col("hub").alias("id"))
    group = F.pmod(F.xxhash64("hub", "sub"), F.lit(max(1, -(-n * (2 * k + 1) // GROUP)))).alias("group")
    around = dealt.union(hubs).join(nodes, "id").select("hub", "sub", "id", "v", F.size("v").alias("dim"), group)
    return around.groupBy("group", "dim").applyInPandas(_hub_graph(k, floor, link), GRAPH)


def exact_links(nodes: DataFrame, n: int, link: float, slab: int = SLAB) -> DataFrame:
    """``a, b``: spanning links of every pair of tiles, over all pairs of vectors.  One slab
    of vectors at a time is sent to all tasks and compared with those not yet sent."""
    spark, slabs = nodes.sparkSession, max(1, -(-n // slab))
    dealt = nodes.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(slabs)).cast("int").alias("slab"))
    out = None
    for turn in range(slabs):
        shared = spark.sparkContext.broadcast(dealt.where(F.col("slab") == turn).toPandas())

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby(batch["v"].str.len()):
                    asked = shared.value[shared.value["v"].str.len() == dim]
                    ids, v = part["id"].to_numpy(), np.stack(part["v"])
                    for lo, hi in slices(len(asked), 1024):
                        other = asked["id"].to_numpy()[lo:hi]
                        x, y = np.nonzero(v @ np.stack(asked["v"].iloc[lo:hi]).T >= link)
                        both, place = np.unique(np.r_[ids, other], return_inverse=True)
                        p, q = _forest(len(both), place[x], place[len(ids) + y])
                        if len(p):
                            yield pd.DataFrame({"a": both[p], "b": both[q]})

        part = materialise(dealt.where(F.col("slab") >= turn).select("id", "v").mapInPandas(run, "a long, b long"), "exact")
        out = part if out is None else out.union(part)
        shared.unpersist()
    return out


def exact_counts(members: DataFrame, link: float, tile: int, tiles: int = TILES, slab: int = SLAB) -> DataFrame:
    """``members(component, id, copies, v)`` to ``id, links``: exact links, copies counted.

    All tiles of a component are compared pairwise; of one with over ``tiles`` of them no
    vector is shuffled, so what is shuffled stays within a constant times the vectors.
    """
    sizes = cut(members.groupBy("component").agg(F.ceil(F.count("*") / tile).alias("split")))
    out = tile_counts(members.join(sizes.where(F.col("split") <= tiles), "component"), link)
    large = sizes.where(F.col("split") > tiles)
    if not large.isEmpty():
        rows = materialise(members.join(large, "component").select("component", "split", "id", "copies", "v"), "large")
        for one in large.orderBy("component").toLocalIterator():  # fewer than vectors / (tiles * tile)
            out = out.unionByName(slab_counts(rows.where(F.col("component") == one["component"]), one["split"] * tile, link, slab))
    return out.groupBy("id").agg(F.sum("links").alias("links"))


def tile_counts(members: DataFrame, link: float) -> DataFrame:
    """``id, links`` from each pair of the ``split`` tiles of each component."""
    dealt = members.withColumn("t", F.pmod(F.xxhash64("id"), "split"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("split") - 1))
    sent = dealt.withColumn("o", other).select("component", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "t", "id", "copies", "v")

    def count(block: pd.DataFrame) -> pd.DataFrame:
        ids, v, copies, t = block["id"].to_numpy(), np.stack(block["v"]), block["copies"].to_numpy(), block["t"].to_numpy()
        one = t == block["lo"].iloc[0]
        if block["lo"].iloc[0] == block["hi"].iloc[0]:
            hit = v @ v.T >= link
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"id": ids, "links": hit @ copies})
        hit = v[one] @ v[~one].T >= link
        return pd.DataFrame({"id": np.r_[ids[one], ids[~one]], "links": np.r_[hit @ copies[~one], copies[one] @ hit]})

    return sent.groupBy("component", "lo", "hi").applyInPandas(count, "id long, links long")


def slab_counts(members: DataFrame, n: int, link: float, slab: int) -> DataFrame:
    """``id, links`` within one component of about n members: one slab of them at a time is
    sent to all tasks and compared with those not yet sent, for both sides of each pair."""
    spark, slabs = members.sparkSession, max(1, -(-n // slab))
    dealt = members.select("id", "copies", "v", F.pmod(F.xxhash64("id"), F.lit(slabs)).cast("int").alias("slab"))
    out = None
    for turn in range(slabs):
        shared = spark.sparkContext.broadcast(dealt.where(F.col("slab") == turn).select("id", "copies", "v").toPandas())

        def run(batches: Iterator[pd.DataFrame], shared=shared, turn=turn) -> Iterator[pd.DataFrame]:
            asked = shared.value
            theirs = np.zeros(len(asked), np.int64)
            for batch in batches:
                v, ids, copies = np.stack(batch["v"]), batch["id"].to_numpy(), batch["copies"].to_numpy()
                inside = (batch["slab"] == turn).to_numpy()
                own = np.zeros(len(batch), np.int64)
                for lo, hi in slices(len(asked), 1024):
                    other = asked.iloc[lo:hi]
                    hit = (v @ np.stack(other["v"]).T >= link) & (ids[:, None] != other["id"].to_numpy()[None])
                    own += hit @ other["copies"].to_numpy()
                    theirs[lo:hi] += np.where(inside, 0, copies) @ hit
                yield pd.DataFrame({"id": ids, "links": own})[own > 0]
            yield pd.DataFrame({"id": asked["id"].to_numpy(), "links": theirs})[theirs > 0]

        part = materialise(dealt.where(F.col("slab") >= turn).mapInPandas(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")), "counts")
        out = part if out is None else out.unionByName(part)
        shared.unpersist()
    return out


def audit(labelled: DataFrame, n: int, link: float, queries: int = 400, enough: int = 100, most: int = 3200, seed: int = 5) -> float:
    """Recall on a seeded sample of queries compared with all vectors.

    A query's recall is the share of its true links that lie within its component.  It is
    averaged over queries, whatever their number of links, and again over those of each
    size of group (1, 2 to 3, 4 to 7 links and so on) that ten queries show; the least of
    these counts.  The sample grows until ``enough`` queries have links, up to ``most``.
    """
    order = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    while True:
        sample = labelled.select("id", "v", "component").where(order < queries / max(1, n)).toPandas()
        shared = labelled.sparkSession.sparkContext.broadcast(sample)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby(batch["v"].str.len()):
                    asked = shared.value[shared.value["v"].str.len() == dim]
                    v, ids, own = np.stack(part["v"]), part["id"].to_numpy(), part["component"].to_numpy()
                    for lo, hi in slices(len(asked), 512):
                        ask = asked.iloc[lo:hi]
                        hit = (np.stack(ask["v"]) @ v.T >= link) & (ask["id"].to_numpy()[:, None] != ids[None])
                        same = hit & (ask["component"].to_numpy()[:, None] == own[None])
                        yield pd.DataFrame({"id": ask["id"].to_numpy(), "true": hit.sum(axis=1), "found": same.sum(axis=1)})[hit.any(axis=1)]

        rows = labelled.mapInPandas(run, "id long, true long, found long").groupBy("id").agg(F.sum("true").alias("true"), F.sum("found").alias("found")).toPandas()
        if len(rows) >= enough or queries >= min(most, n):
            break
        queries = min(most, 4 * queries)
    if not len(rows):
        return 1.0
    share = (rows["found"] / rows["true"]).astype(float)
    sizes = share.groupby(np.log2(rows["true"].astype(float)).astype(int)).agg(["mean", "size"])
    return float(min([share.mean(), *sizes["mean"][sizes["size"] >= 10]]))


def same_vector_ids(pairs: DataFrame) -> DataFrame:
    """``pairs(vec_id, id)`` to ``a, b``: links between the nodes of a repeated vec_id."""
    ends = materialise(pairs.groupBy("vec_id").agg(F.min("id").alias("b"), F.max("id").alias("_last")).where("b <> _last").select("vec_id", "b"), "repeated-ids")
    return pairs.join(ends, "vec_id").select(F.col("id").alias("a"), "b").where("a <> b")


def near_groups(vectors: DataFrame, link: float = SIMILAR, k: int = 12, floor: float = 0.6, trees: int = 10, rounds: int = 4, leaf: int = 256, tile: int = 1024, recall: float = 0.97, tries: int = 3) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audited_recall.

    Null, empty, zero and non-finite vectors link with nothing and are kept; vectors of
    different lengths never link.  Rows that repeat a vec_id with other vectors are one
    member of its component, which all their links lead to, and the sum of the rows' links
    is given with each.  A null vec_id stays alone, with null component and kept true.
    ``audited_recall`` is the last audit's, and 1 after the exact pass.  An empty table
    gives none.
    """
    bounded_batches(vectors.sparkSession, 2000)
    rows = clean(vectors)
    grouped = rows.groupBy("key").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("copies"), F.any_value("v").alias("v"))
    nodes = materialise(grouped.withColumn("id", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()
    plain = nodes.select("id", "v")
    pairs = materialise(rows.select("vec_id", "key").distinct().join(nodes.select("key", "id"), "key").select("vec_id", "id", "key"), "members")
    same = same_vector_ids(pairs.select("vec_id", "id"))
    found, ties, labelled, written = None, None, None, []
    need, dealt, measured = trees_for(n, leaf, link, trees), 0, 1.0
    for turn in range(tries + 1):
        if turn == tries:
            exact = exact_links(plain, n, link).select("a", "b", F.lit(link).alias("sim"), F.lit(1).alias("kind"))
            found = found.union(exact)
        for first in range(dealt, dealt + need if turn < tries else dealt, DEALT):
            fresh = materialise(graph(plain, n, min(DEALT, dealt + need - first), first, k, floor, link, leaf), "graph")
            found = fresh if found is None else found.union(fresh)
            written.append(fresh)
        dealt += need
        size = None
        for again in range(rounds if turn < tries else 0):
            near = materialise(lists(found.where("kind = 0"), k), "lists")
            written.append(near)
            now = near.agg(F.count("*").alias("n"), F.coalesce(F.sum("sim"), F.lit(0.0)).alias("s")).first()
            if size and now["n"] <= 1.001 * size["n"] and now["s"] <= 1.001 * size["s"]:
                break  # a round that adds next to nothing is the last
            size = now
            fresh = materialise(refine(near, plain, n, k, floor, link, turn * rounds + again), "refined")
            found = found.union(fresh)
            written.append(fresh)
        links = found.where("kind = 1").select("a", "b").union(same)
        ties = cut(components(links))
        labelled = nodes.join(ties.withColumnRenamed("node", "id"), "id", "left").select("id", "copies", "v", F.coalesce("component", "id").alias("component"))
        measured = audit(labelled, n, link) if turn < tries else 1.0
        if measured >= recall:
            break
    drop_tables(*written)
    members = nodes.select("id", "copies", "least", "v").join(ties.withColumnRenamed("node", "id"), "id")
    counts = exact_counts(members, link, tile)
    names = members.groupBy("component").agg(F.min("least").alias("component_id"))
    known = (
        nodes.select("id", "copies", "least").join(counts, "id", "left").join(ties.withColumnRenamed("node", "id"), "id", "left").join(names, "component", "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    own = pairs.join(known, "id").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(own, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(measured).alias("audited_recall"),
    )


#: DuckDB SQL for :func:`near_groups` with its default parameters and unique ids, where the
#: audit finds every link.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pair AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9::DOUBLE
), reach AS (
  SELECT x AS vec_id, x AS r FROM (SELECT DISTINCT x FROM pair) UNION SELECT reach.vec_id, pair.y FROM reach JOIN pair ON reach.r = pair.x
), c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1), n AS (SELECT x AS vec_id, count(*) AS n_links FROM pair GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept, 1.0::DOUBLE AS audited_recall
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
