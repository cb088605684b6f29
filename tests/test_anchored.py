"""Alignment of segments that finds its place again."""

import itertools
import random
import tracemalloc

from pyspark.sql import functions as F

from vellum.functions import affine
from vellum.operators import anchored


def test_the_heaviest_chain_against_every_subset():
    rng = random.Random(4)
    for _ in range(300):
        rows = [(s, rng.randrange(8), rng.randrange(1, 5)) for s in range(rng.randrange(0, 8))]
        got = anchored.heaviest_chain(rows)
        weight = {r[:2]: r[2] for r in rows}
        fits = [c for n in range(len(rows) + 1) for c in itertools.combinations(rows, n) if all(x[1] <= y[1] for x, y in itertools.pairwise(c))]
        assert sum(weight[g] for g in got) == max(sum(r[2] for r in c) for c in fits)
        assert all(x[0] < y[0] and x[1] <= y[1] for x, y in itertools.pairwise(got))


def noisy(rng, text):
    return "".join(c if rng.random() > 0.03 else rng.choice(["", "q", c + "z"]) for c in text)


def test_a_lost_and_an_added_chapter_shift_nothing(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    chapter = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c, d, e = (chapter(n) for n in (900, 1500, 600, 3000, 900))
    original, other = f"{a} {b} {c} {e}", f"{a} {c} {d} {e}"  # b is lost, d is added
    own = original.split(" ")
    segments = [" ".join(own[i : i + 300]) for i in range(0, len(own), 300)]
    books = spark.createDataFrame([(1, segments, noisy(rng, other)), (2, segments[:2], segments[1]), (3, [], "abc"), (4, None, None), (5, ["", None], ""), (6, ["short one"], "a short one"), (7, ["same " * 400], "same " * 400)], "doc_id int, segments array<string>, text string")
    text = {r.doc_id: r.text.translate({32: None}) for r in books.where("text IS NOT NULL").collect()}
    rows = anchored.align_anchored(books, gap_open=-1.0, gap_extend=-0.5).collect()
    short = {1: original.replace(" ", ""), 2: (segments[0] + segments[1]).replace(" ", "")}
    by = {k: sorted((r.span for r in rows if r.doc_id == k), key=lambda s: s.a_start) for k in range(1, 8)}
    for k in (1, 2):
        assert all(s.a_end - s.a_start == s.b_end - s.b_start > 0 for s in by[k])
        assert all(x.a_end <= y.a_start and x.b_end <= y.b_start for x, y in itertools.pairwise(by[k]))
    hit = [0] * len(short[1])
    for s in by[1]:
        for i in range(s.a_end - s.a_start):
            hit[s.a_start + i] = short[1][s.a_start + i] == text[1][s.b_start + i]
    size = lambda t: len(t.replace(" ", ""))
    ends = list(itertools.accumulate([size(a), size(b), size(c), size(e)]))
    share = [sum(hit[x:y]) / (y - x) for x, y in zip([0, *ends], ends)]
    assert share[0] > 0.9 and share[2] > 0.9 and share[3] > 0.9 and share[1] < 0.4
    assert sum(s.a_end - s.a_start for s in by[2]) > 0.95 * size(segments[1])
    assert not by[3] and not by[4] and not by[5] and by[6] and by[7]


def test_pieces_and_grams(spark):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdé😀") for _ in range(9000))
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "doc_id int, text string")
    parts = {(r.doc_id, r.piece): r.part for r in anchored.pieces(df).collect()}
    assert {k: len(v) for k, v in parts.items()} == {(1, 0): 4109, (1, 1): 4109, (1, 2): 9000 - 8192}
    assert "".join(parts[1, k][: anchored.PIECE] for k in range(3)) == t
    grams = df.select(F.explode(anchored.minimal_grams("text")).alias("g")).select("g.*").collect()
    seen = {}
    for g in grams:
        seen.setdefault(g.hash, t[g.pos : g.pos + anchored.GRAM])
        assert seen[g.hash] == t[g.pos : g.pos + anchored.GRAM]
    places = sorted(g.pos for g in grams)
    assert all(y - x <= anchored.NEAR for x, y in itertools.pairwise(places))


def test_long_stretches_are_searched_whole(monkeypatch):
    """the best of all tiles is the best of the whole stretch, ties included."""
    monkeypatch.setattr(anchored, "TILE", 7)
    rng = random.Random(9)
    for case in range(60):
        letters = "ab" if case % 2 else "abcdef"
        scores = rng.choice([{"gap_open": -1.0, "gap_extend": -0.5}, {"gap_open": -3.0, "gap_extend": -2.0, "match": 2.0}, {"gap_open": -1.0, "gap_extend": 0.0}])
        a, b = ("".join(rng.choice(letters) for _ in range(n)) for n in (rng.randrange(1, 9), rng.randrange(1, 150)))
        best = []
        for _, tile, own, _, start, part in anchored.windows([a], b, **scores):
            score, spans = affine.align(own, part, "local", **scores)
            if spans:
                best.append((-score, spans[-1][1], spans[-1][3] + start, tile, [(p, q, r + start, s + start) for p, q, r, s in spans]))
        assert len(best) <= 1 or scores["gap_extend"]
        score, spans = affine.align(a, b, "local", **scores)
        assert (-min(best)[0], min(best)[-1]) == (score, spans) if best else not spans


def test_segments_without_an_anchor_lose_nothing_to_length(spark):
    """a text that says all twice has no anchors, and its stretch is far over any tile."""
    rng = random.Random(21)
    half = "".join(rng.choice("abcdefgh") for _ in range(9000))
    segment = half[7000:7150] + "zz" + half[7150:7300]
    books = spark.createDataFrame([(1, [segment], half + half), (None, [segment], half)], "doc_id int, segments array<string>, text string")
    got = [tuple(r.span) for r in anchored.align_anchored(books, gap_open=-1.0, gap_extend=-0.5).orderBy("span.a_start").collect()]
    assert got == affine.align(segment, half + half, "local", -1.0, -0.5)[1] == [(0, 150, 7000, 7150), (152, 302, 7150, 7300)]


def test_grams_of_long_texts_are_no_objects():
    """anchors of a long text are found in arrays."""
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijkl") for _ in range(400_000))
    segments = [text[i : i + 1500] for i in range(0, len(text), 1500)]
    tracemalloc.start()
    assert anchored.anchors(segments, text) == {k: 1500 * k for k in range(len(segments))}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12_000_000
