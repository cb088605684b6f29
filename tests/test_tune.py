"""Adaptive search against random draws, its densities, and a search that is resumed."""

import math
import random
import statistics

import pytest

from vellum.operators import tune
from vellum.operators.correct import SPACES

SPACE = {"x": ("float", -2.0, 3.0), "k": ("int", 0, 20), "on": ("int", 0, 1), "y": ("float", 0.0, 10.0, "on")}


def known(p):
    return -((p["x"] - 1.3) ** 2) - ((p["k"] - 14) / 6) ** 2 + (1 - abs(p["y"] - 7) / 2 if p["on"] else 0)


def best_of(seed, n, adaptive):
    told = []
    while len(told) < n:
        more = tune.ask(SPACE, told if adaptive else [], 5, seed, len(told))
        told += [(p, known(p)) for p in more]
    return max(y for _, y in told)


def test_adaptive_draws_beat_random_ones_on_a_known_objective():
    adaptive, plain = ([best_of(seed, 60, a) for seed in range(25)] for a in (True, False))
    assert statistics.mean(adaptive) > statistics.mean(plain) + 0.1
    assert sum(a > b for a, b in zip(adaptive, plain, strict=True)) >= 18


@pytest.mark.parametrize("space", [SPACE, *SPACES.values()])
def test_draws_keep_to_the_space_and_depend_on_seed_and_table_alone(space):
    rng = random.Random(3)
    told = [(tune.drawn(space, rng), rng.random()) for _ in range(40)] + [(tune.drawn(space, rng), None), (tune.drawn(space, rng), math.nan)]
    asked = tune.ask(space, told, 30, 1, 42)
    assert asked == tune.ask(space, told[::-1], 30, 1, 42) and asked != tune.ask(space, told, 30, 2, 42)
    for p in asked:
        for name, (kind, low, high, *needs) in space.items():
            assert (low <= p[name] <= high if all(p[x] for x in needs) else p[name] == 0) and (kind == "float" or p[name] == int(p[name]))
    assert len({tuple(p.values()) for p in asked}) > 20


def test_densities_sum_to_one():
    for spec, seen in ((("float", -1.0, 2.0), [0.1, 0.1, 1.9]), (("float", 0.0, 1.0), []), (("int", 2, 9), [2.0, 9.0, 5.0, 5.0])):
        d = tune.Parzen(spec, seen)
        if spec[0] == "int":
            total = sum(math.exp(d.log(float(k))) for k in range(spec[1], spec[2] + 1))
        else:
            step = (spec[2] - spec[1]) / 4000
            total = sum(math.exp(d.log(spec[1] + (i + 0.5) * step)) * step for i in range(4000))
        assert abs(total - 1) < 1e-3


def test_search_is_resumed_and_equals_one_that_ran_through(spark, tmp_path):
    docs = spark.createDataFrame([(i, "fffff " * 8, "sssss " * 8) for i in range(4)], "doc_id long, original string, reference string")
    space = {"share": ("float", 0.0, 1.0), "noise": ("int", 0, 3)}
    calls = spark.sparkContext.accumulator(0)

    def answer(text, p):
        calls.add(1)
        return text.replace("f", "s", int(40 * p["share"])) + "x" * int(p["noise"])

    whole = tune.adaptive_search(docs, space, answer, str(tmp_path / "a"), 16, 4, seed=5)
    assert calls.value == 16 * 4
    tune.adaptive_search(docs, space, answer, str(tmp_path / "b"), 8, 4, seed=5)
    before = calls.value
    resumed = tune.adaptive_search(docs, space, answer, str(tmp_path / "b"), 16, 4, seed=5)
    assert calls.value - before == 8 * 4
    rows = whole.collect()
    assert rows == resumed.collect() and [r.objective for r in rows] == sorted((r.objective for r in rows), reverse=True)
    assert sorted((r.trial, r.round) for r in rows) == [(t, t // 4) for t in range(16)]
    for r in rows:
        left, extra = 40 - int(40 * r.parameters["share"]), int(r.parameters["noise"])
        assert abs(r.objective - max(-1.0, (40 - (left + extra)) / 40)) < 0.03
    none = tune.adaptive_search(docs.limit(0), space, answer, str(tmp_path / "c"), 3, 2)
    assert [r.objective for r in none.collect()] == [None] * 3
    with pytest.raises(ValueError, match="trials"):
        tune.adaptive_search(docs, space, answer, str(tmp_path / "d"), 10**6)
