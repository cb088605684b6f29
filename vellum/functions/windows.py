"""Overlapping windows of a subword tokenizer (TXT17).

The tokenizer is a file in the format of the ``tokenizers`` library, at a path that every
executor can read.  A Python worker loads it once; texts come to it in Arrow batches
and leave it in short stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = "array<struct<start:int,end:int,tokens:int,text:string>>"
#: Texts of an Arrow batch whose windows are held together in Python.
STRETCH = 64


@cache
def tokenizer(path: str):
    """The tokenizer of a file, once a process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts(n: int, window: int, overlap: float) -> list[tuple[int, int]]:
    """First token and the one past the last of each window over ``n`` tokens.  Windows
    share ``overlap`` of their tokens; the last is the first that reaches the end."""
    shared, found = window * overlap, []
    while n and (not found or found[-1][1] < n):
        i = len(found)
        found.append((int(i * (window - shared)), min(n, int((i + 1) * window - i * shared))))
    return found


def token_windows(text: Column, path: str, window: int, overlap: float, special: bool = True) -> Column:
    """Each window's first and past-the-last character, number of tokens and text.

    A window runs up to where the next token begins, so what stands between tokens belongs
    to the one before; the last runs to the end of the last token.  Special tokens count
    where the tokenizer's file adds any.  Null gives null, a text without tokens no window.
    """
    if window < 1 or not 0 <= overlap < 1 or int(window * (1 - overlap)) < 1:
        raise ValueError("windows have to move on by a token at least")

    def sliced(value: str | None) -> list[dict] | None:
        if value is None:
            return None
        places = tokenizer(path).encode(value, add_special_tokens=special).offsets
        last = max((end for _, end in places), default=0)
        rows = []
        for a, b in cuts(len(places), window, overlap):
            start, end = places[a][0], places[b][0] if b < len(places) else last
            rows.append({"start": start, "end": end, "tokens": b - a, "text": value[start:end]})
        return rows

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32()), ("text", pa.string())]))

    @F.arrow_udf(WINDOWS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for at in range(0, len(values), STRETCH):
                yield pa.array([sliced(v) for v in values.slice(at, STRETCH).to_pylist()], kind)

    return run.asNondeterministic()(text)  # so that it runs once a row
