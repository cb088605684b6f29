"""Correction by a pluggable language model (LM1-11).

A model is a function from prompts to answers.  It runs inside tasks, on Arrow batches;
documents run in parallel, the blocks of one document in order, for each prompt holds the
answer before it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import affine, waves
from vellum.functions.text import chop_pattern
from vellum.operators.align import DROP, fold_overlaps
from vellum.operators.metrics import document_scores, objective

#: Trials of a search, which are sent to all tasks.
MOST_TRIALS = 10_000
#: Calls of a model whose answers are held together.
STRETCH = 16
Model = Callable[[list[str]], list[str]]


def generate(rows: DataFrame, model: Model, prompt: str = "prompt", batch: int = 5) -> DataFrame:
    """LM1-3, WIN6: ``rows`` with the model's ``answer`` to a prompt column.

    An Arrow batch is answered in short stretches, so Python holds the texts of one stretch
    besides the batch as it came; the other columns pass as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch * STRETCH):
                some = part.slice(at, batch * STRETCH)
                asked = some.column(prompt).to_pylist()
                answers = [x for i in range(0, len(asked), batch) for x in model(asked[i : i + batch])]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(answers, pa.string())], [*some.schema.names, "answer"])

    return rows.mapInArrow(run, rows.selectExpr("*", "CAST(NULL AS STRING) AS answer").schema)


def clip_all(texts: Sequence[str], answers: Sequence[str], **scores) -> list[str]:
    """Each answer from its first to its last character that aligns to its text; if none
    does, all but its last character."""
    pairs = [(t.translate(DROP), a.translate(DROP)) for t, a in zip(texts, answers, strict=True)]
    if waves.sound("local", **scores):
        found = waves.align_all(pairs, "local", **{k: v for k, v in scores.items() if k != "mismatch"})
    else:
        found = [affine.align(*p, "local", **scores) for p in pairs]

    def cut(answer: str, spans: affine.Spans) -> str:
        keep = [i for i, c in enumerate(answer) if c not in "\n -"]
        return answer[keep[spans[0][2]] : keep[spans[-1][3] - 1] + 1] if spans else answer[:-1]

    return [cut(answer, spans) for answer, (_, spans) in zip(answers, found, strict=True)]


def clip(text: str, answer: str, **scores) -> str:
    """:func:`clip_all` for one answer."""
    return clip_all([text], [answer], **scores)[0]


def overlap_start(text: str, cut_off: int = 100) -> str:
    """TXT20 for one text; all of it if there is no space that early."""
    at = max(text.rfind(" ", 0, len(text) - cut_off + 1), text.rfind("\n", 0, len(text) - cut_off + 1))
    return text[max(at, 0) :]


def chopped(text: str, n: int = 5) -> str:
    """TXT21 for one text: context without its last n words, which the next block repeats;
    empty where the text is too short."""
    found = re.match(chop_pattern(n), text)
    return (found[1] or "") if found else ""


def correct_blocks(blocks: Sequence[str], model: Model, degree: int = 1, first: str = "", again: str = "", between: str = "\n\n", **scores) -> tuple[list[str], list[str]]:
    """LM4-6: corrected blocks and raw answers of one document.

    Degree 0 keeps answers as they are, 1 clips each to its block, 2 feeds the answer
    before into the next prompt and merges all, 3 also repeats the end of the first block
    before the second, and 4 feeds back but aligns to the block alone and does not merge.
    Prompts are ``first`` and the block, then ``again``, the answer before, ``between``
    and the block.
    """
    blocks = list(blocks)
    if degree == 3 and len(blocks) > 1:
        blocks[1] = overlap_start(blocks[0]) + blocks[1]
    out, raw = [], []
    for i, block in enumerate(blocks):
        if i == 0 or degree < 2:
            raw += model([first + block])
            out.append(clip(block, raw[-1], **scores) if degree else raw[-1])
        else:
            context = chopped(out[-1]) if degree == 3 else out[-1]
            raw += model([again + context + between + block])
            out.append(clip(block if degree > 3 else blocks[i - 1] + block, raw[-1], **scores))
    return ([fold_overlaps(out, **scores), ""] if degree in (2, 3) and out else out), raw


def correct_documents(docs: DataFrame, model: Model, degree: int = 1, first: str = "", again: str = "", between: str = "\n\n", **scores) -> DataFrame:
    """LM6, LM7, WIN3: ``docs(doc_id, blocks)`` to ``doc_id, corrected, answers``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks = [[b or "" for b in row] for row in batch["blocks"]]
            # where no answer is fed back, those of the batch are clipped together
            done = [correct_blocks(b, model, 0 if degree == 1 else degree, first, again, between, **scores) for b in blocks]
            if degree == 1:
                clipped = iter(clip_all([x for b in blocks for x in b], [x for _, raw in done for x in raw], **scores))
                done = [([next(clipped) for _ in b], raw) for b, (_, raw) in zip(blocks, done, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "corrected": [d[0] for d in done], "answers": [d[1] for d in done]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks")).mapInPandas(run, f"doc_id {kind}, corrected array<string>, answers array<string>")


def run_and_score(docs: DataFrame, model: Model, prefix: str = "", metric: str = "cer") -> DataFrame:
    """LM8: answers to ``doc_id, original, reference``, scored."""
    asked = docs.withColumn("prompt", F.concat(F.lit(prefix), "original"))
    return document_scores(generate(asked, model).withColumnRenamed("answer", "corrected"), metric)


def trial_table(spark: SparkSession, space: dict[str, Sequence[float]]) -> DataFrame:
    """LM9, LM10: a row for each combination: ``trial, parameters``."""
    rows = [(i, dict(zip(space, map(float, values), strict=True))) for i, values in enumerate(product(*space.values()))]
    return spark.createDataFrame(rows, "trial int, parameters map<string,double>")


#: What LM9's three spaces draw from, between two ends.  A fourth item names
#: the parameter without which this one is 0.
SPACES: dict[str, dict[str, tuple]] = {
    "mirostat": {"temperature": ("float", 0.0, 2.0), "mirostat": ("int", 0, 2), "mirostat_tau": ("float", 0.0, 10.0, "mirostat")},
    "mirostat_eta": {"temperature": ("float", 0.0, 2.0), "mirostat": ("int", 0, 2), "mirostat_tau": ("float", 0.0, 10.0, "mirostat"), "mirostat_eta": ("float", 0.01, 0.2, "mirostat")},
    "nucleus": {"temperature": ("float", 0.0, 2.0), "top_k": ("int", 10, 100), "top_p": ("float", 0.5, 0.95)},
}


def random_trials(spark: SparkSession, space: dict[str, tuple], n: int = 100, seed: int = 0) -> DataFrame:
    """LM9: n seeded draws from a space: ``trial, parameters``; the same on each run.  See
    ``tune`` for the search that learns from what its trials gave."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        drawn: dict[str, float] = {}
        for name, (kind, low, high, *needs) in space.items():
            value = rng.uniform(low, high) if kind == "float" else float(rng.randint(low, high))
            drawn[name] = value if all(drawn[x] for x in needs) else 0.0
        rows.append((i, drawn))
    return spark.createDataFrame(rows, "trial int, parameters map<string,double>")


def search(docs: DataFrame, trials: DataFrame, answer: Callable[[str, dict], str]) -> DataFrame:
    """LM9: the objective of each trial over all documents, best first.

    Trials are a short table, fixed by the caller, so it is documents that are dealt out;
    a table of more than ``MOST_TRIALS`` is refused.
    """
    if len(trials.head(MOST_TRIALS + 1)) > MOST_TRIALS:
        raise ValueError(f"more than {MOST_TRIALS} trials")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(corrected=[answer(t, dict(p)) for t, p in zip(batch["original"], batch["parameters"], strict=True)])[["trial", "doc_id", "original", "corrected", "reference"]]

    asked = docs.select("doc_id", "original", "reference").crossJoin(F.broadcast(trials))
    answered = asked.mapInPandas(run, "trial int, doc_id long, original string, corrected string, reference string")
    scores = document_scores(answered.withColumn("doc_id", F.struct("trial", "doc_id")), "cer")
    w = F.when(F.col("improvement").isNotNull(), F.col("input_length"))
    total = scores.groupBy(F.col("doc_id.trial").alias("trial")).agg((F.sum(F.col("improvement") * w) / F.nullif(F.sum(w).cast("double"), F.lit(0.0))).alias("objective"))
    return trials.join(total, "trial").orderBy(F.desc("objective"), "trial")


__all__ = ["Model", "clip", "correct_blocks", "chopped", "correct_documents", "generate", "objective", "overlap_start", "random_trials", "run_and_score", "search", "trial_table"]
