"""Adaptive search for parameters by a tree-structured Parzen estimator (LM9).

Trials are asked for in rounds; a round is one Spark job over all documents, and what it
tells, an objective for each trial, is appended to a small table.  The next round is drawn
from that table alone: the trials so far are parted into the better and the rest, each
part gives a density over every parameter, and of candidates drawn from the better one's
density those with the greatest ratio of the two are asked for.

A round is a function of the table, the seed and the trials' numbers, so a search that is
ended and called again goes on as if it had not been.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.correct import MOST_TRIALS, search

STATE = "trial int, round int, parameters map<string,double>, objective double"
#: Candidates for a trial, trials drawn at random before any density is used, and the
#: greatest number of trials that count as better.
CANDIDATES, STARTUP, BEST = 24, 10, 25
Trial = tuple[dict[str, float], float]


def drawn(space: dict[str, tuple], rng: random.Random) -> dict[str, float]:
    """A uniform draw; a parameter whose needed one is 0 is 0."""
    out: dict[str, float] = {}
    for name, (kind, low, high, *needs) in space.items():
        value = rng.uniform(low, high) if kind == "float" else float(rng.randint(low, high))
        out[name] = value if all(out[x] for x in needs) else 0.0
    return out


class Parzen:
    """Density of one parameter: a bell around each value that was seen, as wide as the
    farther of its neighbours is away, and one over the whole range; cut off at its ends.
    Whole numbers have the mass of the half on either side."""

    def __init__(self, spec: tuple, seen: list[float]):
        self.kind, self.low, self.high = spec[:3]
        if self.kind == "int":
            self.low, self.high = self.low - 0.5, self.high + 0.5
        span = self.high - self.low
        at = sorted(seen)
        narrow = span / min(100.0, 1.0 + len(at))
        ends = [self.low, *at, self.high]
        self.bells = [(x, min(span, max(narrow, x - ends[i], ends[i + 2] - x))) for i, x in enumerate(at)]
        self.bells.append(((self.low + self.high) / 2, span))

    def draw(self, rng: random.Random) -> float:
        mean, width = rng.choice(self.bells)
        while True:
            x = rng.gauss(mean, width)
            if self.low <= x < self.high:
                return float(round(x)) if self.kind == "int" else x

    def log(self, x: float) -> float:
        below = lambda t, mean, width: 0.5 * math.erfc((mean - t) / (width * math.sqrt(2)))
        total = 0.0
        for mean, width in self.bells:
            inside = below(self.high, mean, width) - below(self.low, mean, width)
            if self.kind == "int":
                here = below(x + 0.5, mean, width) - below(x - 0.5, mean, width)
            else:
                here = math.exp(-(((x - mean) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi))
            total += here / max(inside, 1e-300)
        return math.log(max(total / len(self.bells), 1e-300))


def ask(space: dict[str, tuple], told: list[Trial], n: int, seed: int, first: int) -> list[dict[str, float]]:
    """Parameters of the next ``n`` trials, numbered from ``first``.

    Trials without an objective count as the worst.  Those of the same round that are
    asked for already count among the rest, which keeps a round from asking alike.  Up to
    ``STARTUP`` trials draws are uniform.
    """
    known = sorted(((p, -math.inf if y is None or math.isnan(y) else y) for p, y in told), key=lambda t: -t[1])
    best = known[: min(BEST, math.ceil(0.1 * len(known)) + 1)]
    rest, out = [p for p, _ in known[len(best) :]], []
    for trial in range(first, first + n):
        rng = random.Random(f"{seed}:{trial}")
        if trial < STARTUP or not known:
            out.append(drawn(space, rng))
            continue
        # a parameter that another switches off says nothing where it is off
        on = lambda trials, name: [p[name] for p in trials if all(p[x] for x in space[name][3:])]
        good = {name: Parzen(spec, on([p for p, _ in best], name)) for name, spec in space.items()}
        bad = {name: Parzen(spec, on([*rest, *out], name)) for name, spec in space.items()}
        picked, most = None, -math.inf
        for _ in range(CANDIDATES):
            values: dict[str, float] = {}
            gain = 0.0
            for name, spec in space.items():
                if all(values[x] for x in spec[3:]):
                    values[name] = good[name].draw(rng)
                    gain += good[name].log(values[name]) - bad[name].log(values[name])
                else:
                    values[name] = 0.0
            if picked is None or gain > most:
                picked, most = values, gain
        out.append(picked)
    return out


def told(spark: SparkSession, state: str) -> DataFrame:
    """The table of trials under ``state``; empty before the first round."""
    try:
        return spark.read.schema(STATE).parquet(state)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def adaptive_search(docs: DataFrame, space: dict[str, tuple], answer: Callable[[str, dict], str], state: str, trials: int = 100, batch: int = 10, seed: int = 0) -> DataFrame:
    """LM9: ``trial, round, parameters, objective`` of at least ``trials`` trials, best
    first, ties by number.

    ``docs(doc_id, original, reference)`` are all scored in each trial.  A round whose
    trials are in the table under ``state`` is not run again; one that failed is.  Without
    documents objectives are null.  At most ``MOST_TRIALS`` trials: the table is read by
    the driver at each round.
    """
    if trials > MOST_TRIALS:
        raise ValueError(f"more than {MOST_TRIALS} trials")
    spark = docs.sparkSession
    while True:
        rows = told(spark, state).orderBy("trial").collect()
        if len(rows) >= trials:
            break
        number = len(rows)
        params = ask(space, [(r["parameters"], r["objective"]) for r in rows], min(batch, trials - number), seed, number)
        asked = spark.createDataFrame([(number + i, p) for i, p in enumerate(params)], "trial int, parameters map<string,double>")
        scored = {r["trial"]: r["objective"] for r in search(docs, asked, answer).select("trial", "objective").collect()}
        turn = max((r["round"] for r in rows), default=-1) + 1
        done = [(number + i, turn, p, scored.get(number + i)) for i, p in enumerate(params)]
        spark.createDataFrame(done, STATE).coalesce(1).write.mode("append").parquet(state)
    return told(spark, state).orderBy(F.desc_nulls_last("objective"), "trial")
