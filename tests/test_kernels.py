"""Kernels without Spark: edit distance and alignment against plain dynamic programmes."""

import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.functions.affine import align
from vellum.functions.banded import align_whole
from vellum.functions.distance import edits

TEXT = st.text(alphabet="abß ", max_size=14)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(TEXT, TEXT)
@settings(max_examples=300, deadline=None)
def test_edits_equal_plain(a, b):
    assert edits(a, b) == plain_edits(a, b) == edits(b, a)
    assert (edits(a, b) == 0) == (a == b)


def test_edits_of_words_and_golden():
    assert edits("This is a sentence.", "This is the correct sentence.") == 11
    assert edits("a b c".split(), "a x c d".split()) == 2


def plain_score(a, b, local, o=-1.0, e=-0.5):
    ninf = float("-inf")
    m = [[ninf] * (len(b) + 1) for _ in range(len(a) + 1)]
    x, y = [r[:] for r in m], [r[:] for r in m]
    best = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == j == 0 or local:
                m[i][j] = 0.0
            if i:
                x[i][j] = max(max(m[i - 1][j], y[i - 1][j]) + o, x[i - 1][j] + e)
            if j:
                y[i][j] = max(max(m[i][j - 1], x[i][j - 1]) + o, y[i][j - 1] + e)
            if i and j:
                m[i][j] = max(m[i][j], max(m[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1]) + (a[i - 1] == b[j - 1]))
            best = max(best, m[i][j], x[i][j], y[i][j])
    return best if local else max(m[-1][-1], x[-1][-1], y[-1][-1])


@given(TEXT, TEXT, st.sampled_from(["local", "global"]))
@settings(max_examples=200, deadline=None)
def test_alignment_is_optimal_and_valid(a, b, mode):
    score, spans = align(a, b, mode)
    if a and b:
        assert abs(score - plain_score(a, b, mode == "local")) < 1e-9
    at = (0, 0)
    for p, q, r, s in spans:
        assert q - p == s - r > 0 and p >= at[0] and r >= at[1]
        at = (q, s)
    assert at[0] <= len(a) and at[1] <= len(b)


def test_whole_texts_in_a_band_equal_the_full_table():
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh "])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        b = "".join(c if rng.random() > 0.15 else rng.choice(["", rng.choice(letters), c + rng.choice(letters)]) for c in a)
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + (b if rng.random() < 0.7 else "")
        scores = rng.choice([(-1.0, -0.5, 1.0, 0.0), (-2.0, -2.0, 1.0, -1.0), (0.0, 0.0, 1.0, 0.0), (-1.5, -0.25, 2.0, -0.5), (-1.0, -0.5, -1.0, 0.0)])
        free = rng.random() < 0.5
        want = align(a, b, "global", *scores, free)
        for band, cells in ((1, 10), (rng.choice([2, 5]), 60), (48, 1 << 21)):
            assert align_whole(a, b, *scores, free, band=band, cells=cells) == want


def test_whole_texts_of_thousands_of_characters_equal_the_full_table():
    rng = random.Random(2)
    for lost in (0, 150, 900):
        a = "".join(rng.choice("abcdefghij klmno") for _ in range(3000))
        b = "".join(c if rng.random() > 0.03 else rng.choice(["", "x", "xy"]) for c in a)
        b = "before it " + b[:700] + b[700 + lost :] + " after it"
        for free in (False, True):
            assert align_whole(a, b, free_ends=free, cells=1 << 16) == align(a, b, "global", free_ends=free)


def test_memory_of_a_very_long_text_grows_with_its_length():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefghij klmno") for _ in range(40_000))
    b = "".join(c if rng.random() > 0.004 else "x" for c in a)[:-30]
    tracemalloc.start()
    score, spans = align_whole(a, b, free_ends=True, cells=1 << 18)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20  # the full table would take 25 GB
    assert score == sum(x == y for i, j, p, q in spans for x, y in zip(a[i:j], b[p:q], strict=True)) and spans == [(0, len(b), 0, len(b))]
