"""Alignment of like texts by the reaches of their penalties, and what feeds it once."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.functions import affine, banded, reaches, waves
from vellum.functions import text as tx
from vellum.operators import align
from vellum.plans import registry


def edited(rng, text, letters, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.4:
            out[at : at + rng.randrange(1, 9)] = []
        else:
            out[at : at + rng.randrange(2)] = [rng.choice(letters) for _ in range(rng.randrange(1, 7))]
    return "".join(out)


def test_reaches_equal_full_tables():
    rng = random.Random(11)
    for case in range(40):
        scores = rng.choice([(-1.0, -0.5, 1.0), (-1.0, -1.0, 1.0), (-2.0, 0.0, 1.0), (-0.5, -0.5, 0.5), (-3.0, -1.5, 2.0)])
        letters = rng.choice(["ab", "abcdé🙂xyz", [chr(0x4E00 + k) for k in range(400)]])
        pairs = []
        for _ in range(20):
            a = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))
            pairs.append((a, edited(rng, a, letters, rng.randrange(10)) if rng.random() < 0.9 else "".join(rng.choice(letters) for _ in range(40))))
        pairs = [p for p in pairs if p[1] and p[0] != p[1]]
        jobs = [(i, waves.codes(a), waves.codes(b)) for i, (a, b) in enumerate(pairs)]
        for mode in ("local", "global"):
            want = [affine.align(a, b, mode, *scores, 0.0, True) for a, b in pairs]
            found, left = reaches.align_near(jobs, tuple(int(2 * s) for s in scores), mode == "local", held=1 << 23 if case % 4 else 30000)
            assert found.keys() | left.keys() == set(range(len(pairs))) and (found or case % 4 == 0)
            assert all((s / 2, spans) == want[k] for k, (s, spans) in found.items())
            assert all(s / 2 <= want[k][0] for k, (s, _) in left.items())
            by = dict(zip(("gap_open", "gap_extend", "match"), scores, strict=True))
            assert waves.align_all(pairs, mode, free_ends=True, **by) == waves.align_all(pairs, mode, free_ends=True, near=False, band=1, few=0, held=2000, **by) == want


def test_like_texts_fill_no_table(monkeypatch):
    """However long they are: F2, F4, F5, F8."""
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh") for _ in range(40_000))
    b = edited(rng, a, "abcdefgh", 150)
    want = banded.align_whole(a, b, free_ends=True)

    def none(*_):
        raise AssertionError("a table is filled")

    monkeypatch.setattr(waves, "Waves", none)
    monkeypatch.setattr(waves, "align", none)
    assert waves.align_all([(a, b)] * 2, "global", free_ends=True) == [want, want]
    parts = [(a[i : i + 1500], edited(rng, a[i : i + 1500], "abcdefgh", 20)) for i in range(0, 30_000, 1500)]
    found = waves.align_all(parts, "local")
    assert all(score > 1200 and spans for score, spans in found)


def test_texts_are_split_and_aligned_once_a_row(spark):
    plan = registry.align_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.split("\n") if "run(" in x]) == 1 and plan.count("run(") == 1
    one = spark.range(1).select(tx.word_segments(F.lit("a b c d"), 3).alias("s"))
    assert one.first().s == ["a b c", "d"]
    df = spark.createDataFrame([("a b c d e",), ("",), (None,)], "t string").select(tx.word_segments(F.col("t"), 2).alias("s"), tx.word_segments(F.col("t"), 2, True).alias("d"))
    assert [tuple(r) for r in df.collect()] == [(["a b", "c d", "e"], ["a b", "c d"]), ([], []), ([], [])]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # one for each column


@pytest.mark.parametrize("text", ["", "Plain TEXT", "éạ̈ ﬁn ǅ İx Å", "한국어 한 x", "😀á́b"])
def test_lower_case_with_its_origin(text):
    done, origin, at = [], [], 0
    for piece in tx._pieces(text):
        done.append(unicodedata.normalize("NFKC", piece).lower())
        origin += [at] * len(done[-1])
        at += len(piece)
    got = tx._lowered(text)
    assert (got[0], got[1].tolist()) == ("".join(done), origin)


def test_overlaps_are_aligned_together(monkeypatch):
    """parts that overlap by equal text do not wait for each other, and all fold as one by one."""
    rng = random.Random(4)
    scores = {"gap_open": -1.0, "gap_extend": -0.5}
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    lists = [[text[i : i + 200] for i in range(0, 4000, 60)], [], ["one"], ["", "abc", "bcd", "zzz"]]
    for _ in range(12):
        t = "".join(rng.choice("abc -\n") for _ in range(300))
        lists.append([edited(rng, t[i : i + 40], "abc", rng.randrange(3)) for i in range(0, 300, 30)])

    def one_by_one(parts):
        going, answer = align._folding(parts), None
        while True:
            try:
                x, y = going.send(answer)
            except StopIteration as end:
                return end.value
            a, b = affine.align(x, y, "local", **scores)[1], affine.align(y, x, "local", **scores)[1]
            answer = (a[-1][1], b[-1][1]) if a and b else None

    assert align.fold_all(lists, **scores) == [one_by_one(parts) for parts in lists]
    calls, ends = [], waves.local_ends
    monkeypatch.setattr(waves, "local_ends", lambda pairs, **k: calls.append(len(pairs)) or ends(pairs, **k))
    align.fold_all(lists[:1], **scores)
    assert len([n for n in calls if n]) < 4
