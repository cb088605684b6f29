"""Moved blocks: against every order of moves on short texts, and on turned ones."""

from __future__ import annotations

import heapq
import random

import pytest

from vellum.functions.distance import edits
from vellum.functions.moves import character_edits, mates
from vellum.operators import metrics


def least_cost(hypothesis, reference):
    """Least total over every sequence of moves of every block to every place."""
    start, goal = tuple(hypothesis.split()), " ".join(reference.split())
    best, seen, queue = float("inf"), {}, [(0.0, start)]
    while queue:
        paid, h = heapq.heappop(queue)
        if paid >= best or seen.get(h, float("inf")) <= paid:
            continue
        seen[h] = paid
        best = min(best, paid + edits(" ".join(h), goal))
        for i in range(len(h)):
            for n in range(1, len(h) - i + 1):
                block, rest = h[i : i + n], h[:i] + h[i + n :]
                fee = sum(map(len, block)) / n
                for to in range(len(rest) + 1):
                    heapq.heappush(queue, (paid + fee, rest[:to] + block + rest[to:]))
    return best


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_mates_are_a_longest_common_subsequence(letters):
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in "ab")
        mate = mates(a, b)
        pairs = [(i, j) for i, j in enumerate(mate) if j >= 0]
        assert len(mate) == len(a) and all(a[i] == b[j] for i, j in pairs)
        assert all(x < y for (_, x), (_, y) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == common(a, b)


def test_costs_against_every_order_of_moves():
    rng = random.Random(3)
    equal = 0
    for _ in range(150):
        r = [rng.choice(["ab", "cde", "fghi", "k", "lmnop", "qr"]) for _ in range(rng.randint(0, 5))]
        h = r[:]
        i, j = sorted(rng.randint(0, len(h)) for _ in "ij")
        h = h[j:] + h[i:j] + h[:i] if rng.random() < 0.5 else h[i:] + h[:i]
        if h and rng.random() < 0.5:
            h[rng.randrange(len(h))] = rng.choice(["xx", "ab", "cdx"])
        a, b = " ".join(h), " ".join(r)
        cost, moves, words = character_edits(a, b)
        least = least_cost(a, b)
        assert least - 1e-9 <= cost <= edits(a, b) and (moves > 0) == (words > 0) == (cost < edits(a, b))
        equal += abs(cost - least) < 1e-9
    assert equal >= 120, equal  # blocks are chosen greedily


@pytest.mark.parametrize("at", [1, 30, 1000])
def test_one_block_of_a_long_text_is_one_move(at):
    rng = random.Random(at)
    r = [f"w{rng.randint(0, 5000)}" for _ in range(2500)]
    h = r[at:] + r[:at]
    cost, moves, words = character_edits(" ".join(h), " ".join(r))
    assert (moves, words) == (1, at) and abs(cost - sum(map(len, r[:at])) / at) < 1e-9


def test_unrelated_texts_end_and_cost_no_more_than_plain_edits():
    rng = random.Random(1)
    a, b = (" ".join(rng.choice(["of", "the", "and", "sea", "wind", "ship", "men"]) for _ in range(800)) for _ in "ab")
    cost, moves, _ = character_edits(a, b)
    assert moves and cost < edits(a, b)


def test_scores_of_null_empty_and_repeated_rows(spark):
    rows = [(1, "b  a", "a b"), (1, "b  a", "a b"), (2, None, "a"), (3, "a", None), (4, "", "abc"), (5, "", " "), (None, "abc", "abd"), (6, "abc", "")]
    df = spark.createDataFrame(rows, "doc_id long, corrected string, reference string")
    got = sorted((tuple(r) for r in metrics.character_scores(df).collect()), key=lambda r: r[0] or 0)
    assert got == [
        (None, 0, 0, 1.0, 1 / 3), (1, 1, 1, 1.0, 1 / 3), (1, 1, 1, 1.0, 1 / 3), (2, None, None, None, None), (3, None, None, None, None),
        (4, 0, 0, 3.0, 1.0), (5, 0, 0, 0.0, 0.0), (6, 0, 0, 3.0, 1.0),
    ]
    assert metrics.character_scores(df.limit(0)).collect() == []
