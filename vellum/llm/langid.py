"""Language identification by error-correcting output codes.

Each language has a codeword; each bit is predicted by a binary classifier over hashed
character n-grams; the language whose codeword has the least loss under all bits' margins
is chosen, and a text whose two best codewords are close is flagged as ambiguous.

The classifiers are fitted in numpy on a bounded sample of labelled rows; counting the
labels and scoring cover every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, held_out

#: Most labelled rows that are fitted on, over all languages, so most languages too.
SAMPLE = 4000
BITS = 14
#: Characters whose n-grams are counted at once.
BLOCK = 1 << 17
_MIX = np.uint32(2654435761)
#: Bucket of the lone word bound.
_SPACE = ((32 * 2654435761) % (1 << 32)) >> (32 - BITS)


def features(text: str) -> np.ndarray:
    """Unit vector of hashed letter n-grams (one to three letters, words bounded).

    The square root of the counts is taken.  Anything but a letter bounds a word."""
    counts = np.zeros(1 << BITS)
    for start in range(0, len(text), BLOCK):
        part = text[start : start + BLOCK + 2].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        keep = _letters(codes)
        codes = np.where(keep, codes, np.uint32(32))
        codes = codes[np.concatenate(([True], keep[1:] | keep[:-1]))]
        gram = codes
        for n in (1, 2, 3):
            if n > 1:
                gram = gram[:-1] * np.uint32(31 * n + 7) + codes[n - 1 :]
            if len(gram):
                counts += np.bincount((gram * _MIX) >> np.uint32(32 - BITS), minlength=1 << BITS)
    counts[_SPACE] = 0
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)


_known = np.zeros(0x110000, np.int8)


def _letters(codes: np.ndarray) -> np.ndarray:
    new = np.unique(codes[_known[codes] == 0])
    _known[new] = [1 if chr(c).isalpha() else -1 for c in new.tolist()]
    return _known[codes] == 1


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """A row of +1 and -1 for each class: all splits up to seven classes, else the random
    code with the largest least distance of 200 drawn."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        return np.array([[1 if c == 0 or not (b >> (c - 1)) & 1 else -1 for b in range(1, 1 << (n - 1))] for c in range(n)])
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, 4 * int(np.ceil(np.log2(n))) + 8))
        gaps = code.shape[1] - (code @ code.T + code.shape[1]) // 2
        near = gaps[~np.eye(n, dtype=bool)].min()
        if near > far:
            best, far = code, near
    return best


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, names: list[str], epochs: int = 12, size: int = 128, seed: int = 11) -> dict:
    """Logistic regressions of all bits at once, classes weighted equally, by stochastic
    gradients with steps adapted to each weight.  ``x`` holds each row's buckets and their
    values; only a batch of rows is ever spread out."""
    code = codewords(len(names))
    weight = (1 / np.bincount(y, minlength=len(names)))[y]
    weight *= len(y) / weight.sum()
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    seen_w, seen_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs) + 0.05
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // size)):
            part = np.zeros((len(rows), 1 << BITS), np.float32)
            for k, i in enumerate(rows):
                part[k, x[i][0]] = x[i][1]
            target = code[y[rows]]
            g = (-weight[rows, None] * target / (1 + np.exp(np.clip(target * (part @ w + b), -30, 30))) / len(rows)).astype(np.float32)
            gw, gb = part.T @ g + 1e-6 * w, g.sum(axis=0)
            seen_w += gw * gw
            seen_b += gb * gb
            w -= rate * gw / np.sqrt(seen_w)
            b -= rate * gb / np.sqrt(seen_b)
    return {"names": names, "code": code, "w": w, "b": b}


def decode(model: dict, margins: np.ndarray, apart: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, score (0 to 1) and ambiguity by loss-weighted decoding with logistic loss."""
    loss = np.logaddexp(0, -margins[:, None, :] * model["code"][None]).mean(axis=2)
    if loss.shape[1] == 1:
        return np.zeros(len(loss), int), np.ones(len(loss)), np.zeros(len(loss), bool)
    p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    two = np.sort(loss, axis=1)[:, :2]
    return loss.argmin(axis=1), p.max(axis=1), two[:, 1] - two[:, 0] < apart * 0.2


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = set()
    for batch in batches:
        keys = list(zip(batch["lang"].to_pylist(), batch["ord"].to_pylist(), strict=True))
        new = [i for i, k in enumerate(keys) if not (k in done or done.add(k))]
        x = [features(batch["text"][i].as_py()) for i in new]
        at = [np.nonzero(v)[0] for v in x]
        yield pa.record_batch({
            "ord": batch["ord"].take(pa.array(new, pa.int64())), "lang": batch["lang"].take(pa.array(new, pa.int64())),
            "at": pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), "value": pa.array([v[a].astype("<f4").tobytes() for v, a in zip(x, at, strict=True)], pa.binary()),
        })


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 11) -> dict:
    """Fit on labelled texts outside the test fold: all of a rare language, a seeded share
    of others and one at least, each whole.  A text is drawn by a hash of itself, so its
    copies count once, whatever their ids; features are made in the tasks, one for the
    copies in a task, so the driver gets a bounded number of bytes for each text.  Of more
    than ``sample`` languages the most frequent are learned, ties by name.  Without
    labelled rows the model has no language.
    """
    bounded_batches(docs.sparkSession, 500)
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    order = F.pmod(F.xxhash64(F.lit(seed), text), F.lit(1 << 40)) / float(1 << 40)
    labelled = docs.where(lang.isNotNull() & text.rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select(order.alias("ord"), lang.alias("lang"), text.alias("text"))
    own = labelled.groupBy("lang", "ord").agg(F.count("*").alias("n"))
    stats = own.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("ord").alias("least"))
    stats = {r["lang"]: r for r in stats.orderBy(F.desc("n"), "lang").limit(sample).collect()}
    names = sorted(stats)
    if not names:
        return {"names": []}
    each = max(1, sample // len(names))
    share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(max(stats[n]["least"], min(1.0, each / stats[n]["texts"])))))])
    made = labelled.where(F.col("ord") <= share[F.col("lang")]).mapInArrow(_sparse, "ord double, lang string, at binary, value binary")
    one = made.groupBy("lang", "ord").agg(F.min(F.struct("at", "value")).alias("x"))
    rows = one.select("lang", "ord", "x.*").orderBy("ord", "lang").limit(2 * sample + len(names)).collect()
    names = sorted({r["lang"] for r in rows})
    number = {n: i for i, n in enumerate(names)}
    x = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4")) for r in rows]
    return fit(x, np.array([number[r["lang"]] for r in rows]), names)


def spoken(model: dict, texts: list[str]) -> list[str]:
    """The language of each text, ``und`` without a letter or a model."""
    out = np.full(len(texts), "und", object)
    at = [i for i, t in enumerate(texts) if model["names"] and any(map(str.isalpha, t))]
    for part in (at[k : k + 64] for k in range(0, len(at), 64)):
        x = np.array([features(texts[i]) for i in part])
        out[part] = np.array(model["names"], object)[decode(model, x @ model["w"] + model["b"])[0]]
    return out.tolist()


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letters = np.array(batch["letters"].to_pylist(), bool)
            names, score, unsure = np.full(len(batch), "und", object), np.zeros(len(batch)), np.zeros(len(batch), bool)
            at = np.nonzero(letters)[0] if model["names"] else []
            for part in np.array_split(at, max(1, len(at) // 64)) if len(at) else []:
                x = np.array([features(batch["text"][int(i)].as_py()) for i in part])
                which, p, close = decode(model, x @ model["w"] + model["b"])
                names[part], score[part], unsure[part] = np.array(model["names"], object)[which], p, close
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"doc_id": batch["doc_id"].to_pandas(), "held_out": batch["held_out"].to_pandas(), "lang_pred": names, "score": score, "ambiguous": unsure}), schema=_OUT, preserve_index=False)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; from the text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if
    the model has no language.  Null ids are held in; rows that repeat get equal rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("text"))
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
