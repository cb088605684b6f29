"""Serving a model inside tasks (LM1-3): set up once a worker, asked in batches, with what
goes wrong as rows rather than as failed tasks."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]
ANSWER = "struct<answer:string,error:string,tries:int>"
#: Models of this Python worker by the key of their plan.
_loaded: dict[str, Model] = {}


def loaded(key: str, setup: Callable[[], Model]) -> Model:
    if key not in _loaded:
        _loaded[key] = setup()
    return _loaded[key]


def ask(model: Model, prompts: list[str], timeout: float | None) -> list[str]:
    """The model's answers, one a prompt; ``TimeoutError`` after so many seconds.  A call
    that hangs is left to a thread that ends with the worker."""
    done: dict = {}

    def call() -> None:
        try:
            done["answers"] = list(model(prompts))
        except Exception as e:  # noqa: BLE001, handed to the caller below
            done["error"] = e

    if timeout is None:
        call()
    else:
        thread = threading.Thread(target=call, daemon=True)
        thread.start()
        thread.join(timeout)
        if not done:
            raise TimeoutError(f"no answer in {timeout:g} s")
    if "error" in done:
        raise done["error"]
    if len(done["answers"]) != len(prompts):
        raise ValueError(f"{len(done['answers'])} answers to {len(prompts)} prompts")
    return done["answers"]


def answered(model: Model, prompts: list[str], tries: int, timeout: float | None) -> list[dict]:
    """Answers to a batch.  A batch that fails is asked prompt by prompt, each up to
    ``tries`` times, so that one prompt does not take the others' answers."""
    try:
        return [{"answer": a, "error": None, "tries": 1} for a in ask(model, prompts, timeout)]
    except Exception:  # noqa: BLE001, told prompt by prompt
        rows = []
    for prompt in prompts:
        for t in range(1, tries + 1):
            try:
                rows.append({"answer": ask(model, [prompt], timeout)[0], "error": None, "tries": t + 1})
                break
            except Exception as e:  # noqa: BLE001, becomes the row's error
                error = f"{type(e).__name__}: {e}"
        else:
            rows.append({"answer": None, "error": error, "tries": tries + 1})
    return rows


def serve(prompt: Column, setup: Callable[[], Model], batch: int = 5, tries: int = 2, timeout: float | None = None) -> Column:
    """``struct(answer, error, tries)`` for each prompt.

    ``setup`` makes the model, once in each Python worker however many batches and tasks
    it takes; it fails the task if it fails.  Only the prompt goes to Python.  A prompt
    that the model fails on ``tries`` times after its batch has a null answer and the
    error; a null prompt is not asked and has nulls and 0 tries.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf(ANSWER)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded(key, setup)
        for prompts in batches:
            at = [i for i, p in enumerate(prompts) if p is not None]
            rows = [{"answer": None, "error": None, "tries": 0} for _ in range(len(prompts))]
            for k in range(0, len(at), batch):
                some = at[k : k + batch]
                for i, row in zip(some, answered(model, [prompts.iloc[i] for i in some], tries, timeout), strict=True):
                    rows[i] = row
            yield pd.DataFrame(rows, columns=["answer", "error", "tries"])

    return run.asNondeterministic()(prompt)  # so that it runs once a row
