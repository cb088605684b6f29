"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's vector is the mean of the hashed embeddings of the word and its first letters,
so unseen forms of a known stem are near it.  Filters of several widths run over the word
vectors, the greatest value of each filter over the whole text is kept, and a logistic
unit scores these.  Training is plain numpy on a bounded, class-balanced sample of whole
texts.

Every text is then scored once.  The decision thresholds are calibrated by language on
the scores of all labelled rows outside the test fold that were not fitted on; a text's
language for this is predicted from the text (see ``langid``), so the score is a function
of the text alone.  A language's threshold rests on its own rows and, with the weight of
``BORROWED`` toxic rows, on those of the others.  Scores are moved in the logit so that
each language's threshold lies at ``LIMIT``.  Texts are never shuffled: labels are sampled
before their texts are read, and later meet scores only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import langid
from vellum.llm.common import bounded_batches, held_out, materialise

LIMIT = 0.3
#: Most labelled documents of a class that the net is fitted on.  Of one with more words
#: than ``PLACES``, stretches of ``STRETCH`` words from all over it are.
SAMPLE, PLACES, STRETCH = 1500, 1 << 13, 64
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
PREFIXES = (3, 4, 5)
WORDS = re.compile(r"[^\W\d_]+")
#: Words whose filter responses a Python worker keeps; about 300 bytes each.
KEPT = 200_000
#: Words scored at once.
BLOCK = 1 << 14
#: Toxic rows' worth of other languages in a language's threshold; width of a logit's bin.
BORROWED, STEP = 20, 0.05


def buckets(word: str) -> list[int]:
    """Hash buckets of a word and its beginnings."""
    forms = [f"<{word}>"] + [f"<{word[:n]}" for n in PREFIXES]
    return [1 + crc32(f.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for f in forms]


def split(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def codes(text: str | None) -> np.ndarray:
    """Each word's buckets in one number.  Of a very long text, so many stretches, the first
    and last included, that ``PLACES`` words are about what is given."""
    words = split(text)
    if len(words) > PLACES:
        last = len(words) - STRETCH
        starts = np.linspace(0, last, PLACES // STRETCH).astype(int)
        words = [w for a in starts.tolist() for w in words[a : a + STRETCH]]
    known: dict[str, int] = {}
    for w in set(words):
        code = 0
        for b in buckets(w):
            code = code * BUCKETS + b
        known[w] = code
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


class Net:
    """Parameters and forward pass.  ``kernels[k]`` is the filters of width ``WIDTHS[k]``."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.kernels = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, self.bias, self.out, self.shift]

    def vectors(self, forms: np.ndarray) -> np.ndarray:
        return self.embed[forms].mean(axis=1)

    def taps(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each place in a filter, the response of all filters that wide to words."""
        return [np.concatenate([vectors @ k[t] for k in self.kernels if len(k) > t], axis=1) for t in range(max(WIDTHS))]

    def logit(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + self.bias, 0) @ self.out + self.shift[0]


def padded(ids: Sequence[int]) -> np.ndarray:
    """Word numbers with room for the widest filter; 0 is the word with no vector."""
    return np.array([0, *ids, *[0] * (max(WIDTHS) - 1)])


def responses(taps: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Outputs of all filters at each position of padded word numbers.  Narrower filters
    come first, so a later place adds to the last columns."""
    n = len(ids) - max(WIDTHS) + 1
    out = taps[0][ids[:n]]
    for t in range(1, max(WIDTHS)):
        out[:, -taps[t].shape[1] :] += taps[t][ids[t : t + n]]
    return out


def pooled(taps: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response of each filter over a text, and where it is; block by block."""
    top = where = None
    for start in range(0, len(ids) - max(WIDTHS) + 1, BLOCK):
        part = responses(taps, ids[start : start + BLOCK + max(WIDTHS) - 1])
        at = part.argmax(axis=0)
        best = part[at, np.arange(part.shape[1])]
        if top is None:
            top, where = best, at
        else:
            where = np.where(best > top, at + start, where)
            top = np.maximum(top, best)
    return top, where


def evidence(seqs: list[np.ndarray], forms: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How strongly a bucket's presence in a text speaks for class 1: the signed root of
    the likelihood ratio, which stays small for whatever is rare."""
    seen = np.zeros((2, BUCKETS))
    for ids, y in zip(seqs, toxic, strict=True):
        seen[int(y), np.unique(forms[np.unique(ids)])] += 1
    n = np.array([[max(1, (toxic == 0).sum())], [max(1, (toxic == 1).sum())]], float)
    both, all_rows = seen.sum(axis=0), n.sum()

    def term(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9)), 0)

    g = term(seen, both * n / all_rows).sum(axis=0) + term(n - seen, (all_rows - both) * n / all_rows).sum(axis=0)
    return (np.sign(seen[1] / n[1] - seen[0] / n[0]) * np.sqrt(2 * np.maximum(g, 0))).astype(np.float32)


def fit(texts: list[np.ndarray], toxic: np.ndarray, kept: np.ndarray, epochs: int = 10, seed: int = 3) -> Net:
    """Adam on the logistic loss over texts as :func:`codes`; gradients reach the words that gave each maximum.

    The first dimension of the embeddings starts from :func:`evidence`, and one filter of
    a single word passes it on.  The epoch with the least loss on ``kept`` rows, which
    are not fitted on, is returned.
    """
    words, at = np.unique(np.concatenate([np.zeros(0, np.int64), *texts]), return_inverse=True)
    seqs = [padded(part) for part in np.split(at + 1, np.cumsum([len(t) for t in texts])[:-1])]
    width = 1 + len(PREFIXES)
    forms = np.zeros((len(words) + 1, width), np.int64)
    for k in range(width):
        forms[1:, k] = words // BUCKETS ** (width - 1 - k) % BUCKETS
    fitted = np.nonzero(~kept)[0]
    net, rng = Net(seed), np.random.default_rng(seed)
    net.embed[:, 0] = evidence([seqs[i] for i in fitted], forms, toxic[fitted]) / 2
    net.embed[0] = 0
    net.kernels[0][0, :, 0] = 0
    net.kernels[0][0, 0, 0] = 1
    net.bias[0], net.out[0], net.shift[0] = -1.5, 2.0, -2.0
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    least, best = np.inf, None

    def loss() -> float:
        taps = net.taps(net.vectors(forms))
        z = np.array([net.logit(pooled(taps, seqs[i])[0]) for i in np.nonzero(kept)[0]])
        return float(weight[kept] @ np.logaddexp(0, np.where(toxic[kept] == 1, -z, z))) if len(z) else 0.0

    step, size, place = 0, 32, np.arange(len(WIDTHS) * FILTERS)
    for epoch in range(epochs + 1):
        if (now := loss()) < least or best is None or not kept.any():
            least, best = now, [p.copy() for p in net.params()]
        if epoch == epochs:
            break
        rate = 0.005 * (1 - epoch / epochs) + 0.0005
        for rows in np.array_split(rng.permutation(fitted), max(1, len(fitted) // size)):
            seen, words = np.unique(np.concatenate([seqs[i] for i in rows]), return_inverse=True)
            begin = np.concatenate(([0], np.cumsum([len(seqs[i]) for i in rows])))
            vectors = net.vectors(forms[seen])
            taps = net.taps(vectors)
            found = [pooled(taps, words[a:b]) for a, b in zip(begin, begin[1:], strict=False)]
            top, where = np.array([f[0] for f in found]), np.array([f[1] for f in found]) + begin[:-1, None]
            hidden = np.maximum(top + net.bias, 0)
            z = hidden @ net.out + net.shift[0]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.where(toxic[rows] == 1, 0.97, 0.03)) * weight[rows] / len(rows)
            back = g[:, None] * net.out * (hidden > 0)
            grads = [np.zeros_like(k) for k in net.kernels]
            used, moved = [], []
            text, at = np.nonzero(back)
            for k, w in enumerate(WIDTHS):
                own = place[at] // FILTERS == k
                b, c = back[text[own], at[own]].astype(np.float32)[:, None], at[own] % FILTERS
                for tap in range(w):
                    word = words[where[text[own], at[own]] + tap]
                    np.add.at(grads[k][tap].T, c, b * vectors[word])
                    used.append(seen[word])
                    moved.append(b * net.kernels[k][tap].T[c])
            grads += [back.sum(axis=0), g @ hidden, np.array([g.sum()])]
            step += 1
            for p, d, (m, v) in zip(net.params()[1:], grads, state[1:], strict=True):
                _adam(p, (d + 1e-5 * p).astype(np.float32), m, v, step, rate)
            rows_of, moved = forms[np.concatenate(used)], np.concatenate(moved)
            if len(moved):
                at_once, back_to = np.unique(rows_of, return_inverse=True)
                d = np.zeros((len(at_once), DIM), np.float32)
                np.add.at(d, back_to.reshape(rows_of.shape), np.repeat(moved[:, None, :] / rows_of.shape[1], rows_of.shape[1], axis=1))
                p, m, v = net.embed[at_once], state[0][0][at_once], state[0][1][at_once]
                _adam(p, d, m, v, step, rate)
                net.embed[at_once], state[0][0][at_once], state[0][1][at_once] = p, m, v
                net.embed[0] = 0
    for p, q in zip(net.params(), best, strict=True):
        p[...] = q
    return net


def _adam(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, rate: float) -> None:
    m += 0.1 * (g - m)
    v += 0.01 * (g * g - v)
    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


class Scorer(dict):
    """Scores whole texts; keeps the numbers and filter responses of known words."""

    def __init__(self, net: Net):
        self.net, self.new = net, []
        self.taps = [np.zeros((1 << 12, t.shape[1]), np.float32) for t in net.taps(np.zeros((1, DIM), np.float32))]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n

    def logit(self, text: str | None) -> float:
        words = split(text)
        if len(self) > KEPT:
            self.clear()
        ids = np.zeros(len(words) + max(WIDTHS), np.int64)
        ids[1 : len(words) + 1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            while len(self) >= len(self.taps[0]):
                self.taps = [np.concatenate([t, np.zeros_like(t)]) for t in self.taps]
            fresh = self.net.taps(self.net.vectors(np.array([buckets(w) for w in self.new])))
            for t, f in zip(self.taps, fresh, strict=True):
                t[len(self) + 1 - len(self.new) : len(self) + 1] = f
            self.new = []
        return float(self.net.logit(pooled(self.taps, ids)[0]))


def marks(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` outside the test fold; labels other than 0 and 1 are left out,
    and of several for a document the greatest counts."""
    good = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return good.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"doc_id": batch["doc_id"], "label": batch["label"], "h": batch["h"], "words": pa.array([codes(t.as_py()).astype("<i8").tobytes() for t in batch["text"]], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 3) -> dict:
    """Net, language model and the ids fitted on, from labelled rows outside the test fold.

    Of each class the first ``sample`` ids in a seeded order are drawn, before any text is
    read; of rows that repeat an id the one whose text has the least hash counts.  Words
    become numbers in the tasks, so the driver gets at most ``PLACES`` of them for a text.
    A quarter of the texts is kept from the fitting.  Without both classes there is no net.
    """
    bounded_batches(docs.sparkSession, 500)
    order = F.xxhash64(F.lit(seed), "doc_id")
    known = marks(labels)
    drawn = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)]
    speech = langid.train(docs)
    picked = F.broadcast(drawn[0].union(drawn[1]))  # at most twice the sample
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).join(picked, "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "h", "text")
    least = texts.groupBy("doc_id").agg(F.min("h").alias("h"))  # a row that repeats is read once
    coded = texts.join(F.broadcast(least), ["doc_id", "h"], "left_semi").select("doc_id", "label", "h", "text").mapInArrow(_coded, "doc_id long, label int, h long, words binary")
    got = sorted(coded.groupBy("doc_id", "label").agg(F.min("words").alias("words")).collect())
    y = np.array([r["label"] for r in got], int)
    fold = np.array([crc32(f"fold {r['doc_id']}".encode()) % 4 == 0 for r in got], bool)
    if len(set(y[~fold].tolist())) < 2 or len(set(y[fold].tolist())) < 2:
        fold = np.zeros(len(y), bool)
    if len(set(y.tolist())) < 2:
        return {"net": None, "speech": speech, "fitted": []}
    return {"net": fit([np.frombuffer(r["words"], "<i8") for r in got], y, fold), "speech": speech, "fitted": [r["doc_id"] for r, k in zip(got, fold, strict=True) if not k]}


def raw_scores(docs: DataFrame, model: dict, *keep: Column) -> DataFrame:
    """``keep`` columns, uncalibrated logit ``z`` and predicted language ``spoken`` of each
    row's whole text, null text as empty; written once."""
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model["net"])
        for batch in batches:
            texts = [t.as_py() for t in batch["_text"]]
            spoken = langid.spoken(model["speech"], texts)
            z = np.array([scorer.logit(t) for t in texts], float)
            yield pa.record_batch({n: batch[n] for n in names} | {"z": pa.array(z), "spoken": pa.array(spoken, pa.string())})

    schema = rows.drop("_text").schema.add("z", "double").add("spoken", "string")
    return materialise(rows.mapInArrow(run, schema), "toxicity")


def threshold(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray, share: float) -> float:
    """The logit with the best F1 at the given share of toxic rows, out of the weights of
    both classes at ascending logits ``z``; between the logits on either side of it."""
    w = share * toxic / toxic.sum()
    hit = np.cumsum(w[::-1])[::-1]
    said = hit + np.cumsum(((1 - share) * clean / max(clean.sum(), 1e-12))[::-1])[::-1]
    best = int(np.argmax(2 * hit / (said + share)))
    return float(z[best] - min(2.0, (z[best] - z[best - 1]) / 2 if best else 1.0))


def calibrate(raw: DataFrame, labels: DataFrame, model: dict) -> tuple[dict[str, float], float]:
    """Threshold by language, and that of all, out of ``raw(doc_id, z, spoken)``.

    Only counts by language, label and bin of the logit reach the driver.  Fitted ids
    count for the share of toxic rows alone, unless no others have both classes.
    """
    spark = raw.sparkSession
    binned = raw.where("doc_id IS NOT NULL").groupBy("doc_id", "spoken", F.round(F.col("z") / STEP).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    fitted = F.broadcast(spark.createDataFrame([(int(i),) for i in model["fitted"]], "doc_id long").withColumn("fitted", F.lit(True)))  # at most twice the sample
    counted = binned.join(marks(labels), "doc_id").join(fitted, "doc_id", "left")
    rows = counted.groupBy("spoken", "label", F.coalesce("fitted", F.lit(False)).alias("fitted"), "bin").agg(F.sum("n").alias("n")).collect()
    if {r["label"] for r in rows if not r["fitted"]} != {0, 1}:
        rows = [{**r.asDict(), "fitted": False} for r in rows]
    at = sorted({r["bin"] for r in rows})
    place = {b: i for i, b in enumerate(at)}
    names = sorted({r["spoken"] for r in rows})
    hist = {s: np.zeros((2, len(at))) for s in names}
    total = {s: np.zeros(2) for s in names}
    for r in rows:
        total[r["spoken"]][r["label"]] += r["n"]
        if not r["fitted"]:
            hist[r["spoken"]][r["label"], place[r["bin"]]] += r["n"]
    every, z = sum(hist.values(), np.zeros((2, len(at)))), STEP * np.array(at, float)
    if not every.sum(axis=1).all():
        return {}, 0.0
    overall = sum(total.values())
    limits = {}
    for s in names:
        rest, n = every - hist[s], overall - total[s]
        lend = min(1.0, BORROWED / max(rest[1].sum(), 1e-12))
        both, share = hist[s] + lend * rest, total[s] + lend * n
        if both.sum(axis=1).all():
            limits[s] = threshold(z, both[1], both[0], share[1] / share.sum())
    return limits, threshold(z, every[1], every[0], overall[1] / overall.sum())


def probability(raw: DataFrame, labels: DataFrame, model: dict) -> Column:
    """The calibrated score of a row of ``raw``."""
    limits, default = calibrate(raw, labels, model)
    limit = F.lit(default)
    if limits:
        by = F.create_map(*[x for s, v in limits.items() for x in (F.lit(s), F.lit(v))])
        limit = F.coalesce(by[F.col("spoken")], limit)
    return 1 / (1 + F.exp(-(F.col("z") - limit + math.log(LIMIT / (1 - LIMIT)))))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, from the text alone; the labels train.

    Null text scores as the empty text.  Null ids are held in; rows that repeat get equal
    rows; other columns are not read.  Without labels of both classes all score 0.
    """
    model = train(docs, labels, **options)
    ids = F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out")
    if not model["net"]:
        return docs.select(*ids, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    raw = raw_scores(docs, model, *ids)
    p = probability(raw, labels, model)
    return raw.select("doc_id", "held_out", p.alias("score"), (p >= LIMIT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns as given; all of them
    without labels of both classes."""
    model = train(docs, labels, **options)
    if not model["net"]:
        return docs
    raw = raw_scores(docs, model, F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"))
    return raw.where(probability(raw.select("doc_id", "z", "spoken"), labels, model) < LIMIT).select("doc.*")
