"""Ranked search, centroid clustering and byte-level BPE against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from vellum.llm import bpe, centroids, lexical

DOCS = "doc_id long, text string, item_id string, term string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 7) for i, t in rows], DOCS)


def fold_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranked(rows, items, k=10):
    docs = [(i, TERM.findall(fold_ascii(t))) for i, t in rows]
    n_docs, n_terms = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    out = []
    for item, text in items:
        found = []
        for doc, ts in docs:
            tf, m = Counter(ts), 25 + 75 * len(ts) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in TERM.findall(fold_ascii(text)) if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: rng.choice(["An", "to", "ri", "é", "ÉÉ", "x9", "sel", "日本", "the", "the"]) + rng.choice(["", "a", "B", "ou"])
    sign = lambda: rng.choice([" ", ", ", "\n", "--", "_", " ", "."])
    out = [(i, "".join(word() + sign() for _ in range(rng.randint(0, 60)))) for i in range(150)]
    out += [(500, None), (501, ""), (502, " ,;"), (503, out[4][1]), (503, out[4][1]), (None, out[4][1]), (None, "the same"), (504, "the " * 30000 + "rare")]
    return out


def test_search_against_brute_force(spark, texts, monkeypatch):
    items = [(0, texts[3][1]), (1, "the THE the to rare"), (2, None), (3, "nowhere"), (4, "the"), (4, "to é ÉÉ"), (None, "rare an " * 9)]
    rows = documents(spark, texts).repartition(5)
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    want = ranked(texts, items)
    got = lexical.search(rows, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(lexical, "ASKED", 3)  # several passes over the texts
    assert sorted(map(tuple, lexical.search(rows, asked).collect()), key=str) == want
    assert lexical.search(rows.limit(0), asked).count() == 0 and lexical.search(rows, asked.limit(0)).count() == 0


def test_blocks_end_at_documents_and_postings(texts, monkeypatch):
    import pyarrow as pa

    class Shared:
        value = {b"the": 0, b"to": 1}

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts]}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    whole = list(lexical._postings(Shared)(iter([batch])))
    monkeypatch.setattr(lexical, "DOCS", 9)
    few = list(lexical._postings(Shared)(iter([batch, batch])))
    assert len(whole) == 1 and len(few) == -(-2 * len(texts) // 9)
    assert sum(sum(b["tf"][0].as_py()) for b in few) == 2 * sum(whole[0]["tf"][0].as_py())
    monkeypatch.setattr(lexical, "POSTINGS", 1)
    assert all(sum(b["size"][0].as_py()) <= 2 for b in lexical._postings(Shared)(iter([batch])))


def test_sums_of_slices_and_their_best():
    rng = random.Random(1)
    for n in (1, 7, 300):
        sums, total = [0] * n, []
        for _ in range(12):
            part = [rng.choice([0, 0, 1, rng.randrange(1 << 34)]) for _ in range(n)]
            shift = rng.randrange(3)
            slices = [sum((v >> d & 1) << i for i, v in enumerate(part)) for d in range(35)]
            lexical.add(total, slices, shift)
            sums = [a + (b << shift) for a, b in zip(sums, part, strict=True)]
        sums = [s if i % 3 else 0 for i, s in enumerate(sums)]
        total = [sum((v >> d & 1) << i for i, v in enumerate(sums)) for d in range(max(sums).bit_length())]
        for k in (1, 2, 10, 500):
            want = sorted((i for i in range(n) if sums[i]), key=lambda i: (-sums[i], i))[:k]
            assert sorted(lexical.best(total, k)) == sorted(want)
    assert sorted(lexical.best([0b110111], 3)) == [0, 1, 2]


def lloyd(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes())
    centres = [list(v) for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [near(v) for _, v in kept]
    cost = Counter()
    for d, j in last:
        cost[j] += d
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(((i, j, fits(d), fits(cost[j]), fits(sum(cost.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


@pytest.mark.parametrize("extra", [[], [(900, [1e9] + [0.0] * 63), (901, [-1e9] * 64)]])
def test_lloyd_against_brute_force(spark, extra):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(7, rows[7][1]), (None, rows[9][1]), (None, [0.5] * 64)]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, [math.nan] * 64), (305, [math.inf] * 64)]
    rows += extra
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows + odd], "vec_id long, embedding array<double>, v string").repartition(4)
    assert sorted(map(tuple, centroids.lloyd(table).collect()), key=str) == lloyd(rows)
    assert centroids.lloyd(table.where("vec_id IN (1, 2, 303)")).count() == 2
    assert centroids.lloyd(table.limit(0)).count() == 0


def test_lloyd_breaks_ties_to_the_lowest_centroid(spark):
    table = spark.createDataFrame([(i, [float(i % 2)] * 64) for i in range(30)], "vec_id long, embedding array<float>")
    got = centroids.lloyd(table).collect()
    assert len({r.cluster for r in got}) == 2 and all(r.distance == 0 for r in got)
    assert sorted(map(tuple, got), key=str) == lloyd([(i, [float(i % 2)] * 64) for i in range(30)])


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(8)
    later = "\u088f"  # a letter in Python's regex module, not in the tokenizer library's Unicode version
    letters = ["a", "e", "th", "he", "in", "er", "A", "Z", "é", "ß", "日", "本", "語", "я", "д", "ع", "ิ", "👍🏽", "1", "٣", "²", " ", "  ", "\n", "\t", " ", " ", "\x1c", "'s", "'ll", "-", "=", "\x00", later, "\U0001fae9"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(250)]
    out += ["".join(rng.choice(["a", "b", "ab", "ba", "aa"]) for _ in range(rng.randint(1, 90))) for _ in range(80)]
    return [*out, "", " ", "\n\n\n", "a" * 3000, "ha" * 700, "=" * 999, " " * 500 + "x", "word " * 20000, later, "x" + later + "y 1" + later, "don't we'll I'M"]


def test_bpe_against_the_library_and_round_trip(spark, odd_texts):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    rows = [*enumerate(odd_texts), (None, "no id"), (3, "same"), (3, "same"), (900, None)]
    got = bpe.round_trip(documents(spark, rows), RANKS)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def want(text):
        ids = own.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *want(t)) for i, t in rows), key=str)
    assert bpe.round_trip(documents(spark, rows).limit(0), RANKS).count() == 0
    ids = bpe.encode(documents(spark, rows), RANKS, most=5)  # nearly all words are folded with their document
    assert sorted(((r.doc_id, tuple(r.ids)) for r in ids.collect()), key=str) == sorted(((i, tuple(own.encode_ordinary(t or ""))) for i, t in rows), key=str)


def test_runs_of_ids_between_rare_words():
    rng = random.Random(5)
    docs = [[rng.choice([-1, -2, 5, 6, 7, 8]) for _ in range(rng.randint(0, 9))] for _ in range(60)] + [[], [-1], [], [3], [-1, -1]]
    runs, gaps = bpe._parted(np.array([i for d in docs for i in d], np.int32), np.cumsum([0, *map(len, docs)]))
    for ids, own, rare in zip(docs, runs.to_pylist(), gaps.to_pylist(), strict=True):
        assert len(own) == len(rare) + 1 and rare == [-1 - i for i in ids if i < 0]
        assert [i for run, g in zip(own, [*rare, None], strict=True) for i in [*run, *([-1 - g] if g is not None else [])]] == ids


def test_merges_take_their_turn_where_a_merge_makes_a_lower_rank(spark):
    rng = random.Random(2)
    for _ in range(6):
        known = {bytes([b]): b for b in range(256)}
        pool = [b"a", b"b", b"c"]
        for _ in range(14):  # ranks in no order that training would give
            token = rng.choice(pool) + rng.choice(pool)
            if len(token) < 9 and token not in known:
                known[token] = 0
                pool.append(token)
        long = [t for t in known if len(t) > 1]
        known |= {t: 256 + r for t, r in zip(long, rng.sample(range(len(long)), len(long)), strict=True)}
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 14))) for _ in range(60)})
        own = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=known, special_tokens={})
        table = spark.createDataFrame([(words,)], "w array<string>")
        got = table.select(bpe.fold_all(bpe.rank_map(known), F.col("w")).alias("ids")).first()["ids"]
        assert got == [own.encode_ordinary(w) for w in words]


def test_decode_of_an_unknown_id_is_null(spark):
    rows = spark.createDataFrame([([0, 1],), ([10**6],), ([],), (None,)], "ids array<int>")
    got = [r[0] for r in rows.select(bpe.decode(F.col("ids"), RANKS)).collect()]
    assert bytes(got[0]) == b"".join(sorted(bpe.ranks(RANKS), key=bpe.ranks(RANKS).get)[:2]) and got[1] is None and bytes(got[2]) == b"" and got[3] is None
