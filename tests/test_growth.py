"""Whole jobs whose work has to grow no faster than their input."""

import random
from collections import Counter
from math import log2

from pyspark.sql import functions as F

from vellum.functions import affine, distance, moves, waves, windows
from vellum.functions import text as tx
from vellum.operators import collocate, corpus, correct, metrics

WORDS = "the of fish sea ship storm of the Sea. ſea a-\nway"


def test_collocations_are_counted_by_word_ids(spark, monkeypatch):
    monkeypatch.setattr(collocate, "HELD", 7)  # so that a pair's counts come from several parts
    texts = [(i, " ".join((WORDS.split(" ") * 2)[i % 5 : i % 5 + 9])) for i in range(30)] + [(30, None), (31, ""), (32, "x"), (33, "ﬁsh ﬁsh ﬁsh")]
    df = spark.createDataFrame(texts, "doc_id long, t string").repartition(3)
    found = collocate.counts(df, ["t"])
    assert dict(found.dtypes) == {"a": "bigint", "b": "bigint", "word": "string", "n_t": "bigint"}
    tokens = [r.tokens for r in collocate.token_arrays(df, "t").collect() if r.tokens]
    one = Counter(w for t in tokens for w in t)
    two = Counter(tuple(sorted((t[i], t[i + k]))) for t in tokens for k in (1, 2) for i in range(len(t) - k))
    assert {r.word: r.n_t for r in found.where("b IS NULL").collect()} == dict(one)
    want = {}
    for (a, b), n in two.items():
        n *= 2 if a == b else 1
        if min(n, one[a], one[b]) >= 4:
            want[a, b] = (round(log2(n * n / (one[a] * one[b] / sum(one.values()))), 9), n, one[a], one[b])
    got = {(r.w1, r.w2): (round(r.mi2, 9), r.f12, r.f1, r.f2) for r in collocate.collocations(df, "t").collect()}
    assert got == want and any(a == b for a, b in want)


def test_distances_of_many_texts_equal_one_by_one(monkeypatch):
    rng = random.Random(3)

    def changed(text, p):
        return "".join(rng.choice(["", "x", c + "y"]) if rng.random() < p else c for c in text)

    texts = ["".join(rng.choice("abcdé🙂") for _ in range(rng.choice((0, 1, 3, 20, 90, 400)))) for _ in range(300)]
    pairs = [(t, changed(t, rng.choice((0, 0.02, 0.3)))) for t in texts] + list(zip(texts, reversed(texts), strict=True))
    monkeypatch.setattr(distance, "FEW", 0)
    assert distance.distances(pairs) == [distance.edits(a, b) for a, b in pairs]
    assert distance.distances([]) == []


def test_bags_are_counted_without_a_shuffle(spark):
    rows = [(1, "a b b c", "a b d"), (2, "", "x"), (3, None, "x y"), (4, "x", None), (None, "x", "x"), (5, "x y\x1cx", "x x")]
    found = metrics.bag_counts(spark.createDataFrame(rows, "doc_id long, p string, r string"), "p", "r")
    assert "Exchange" not in found._jdf.queryExecution().toString()
    got = {r.doc_id: (r.tp, r.fp, r.fn, r.f1) for r in found.collect()}
    assert got == {1: (2, 2, 1, 4 / 7), 2: (0, 0, 1, 0.0), 3: (0, 0, 2, 0.0), 4: (0, 1, 0, 0.0), None: (0, 0, 0, 0.0), 5: (2, 1, 0, 0.8)}


def test_alignments_of_many_texts_equal_one_by_one():
    rng = random.Random(5)
    pairs = []
    for _ in range(250):
        text = "".join(rng.choice("abcdé🙂xyzt"[: rng.choice((2, 5, 10))]) for _ in range(rng.choice((0, 1, 4, 30, 90))))
        other = "".join(rng.choice(["", "b", c + "a"]) if rng.random() < 0.1 else c for c in text)
        pairs.append((text, other[rng.randint(0, 9) :] if rng.random() < 0.5 else "cab" * rng.randint(0, 12) + other))
    for mode, free in (("local", False), ("global", True)):
        want = [affine.align(a, b, mode, free_ends=free) for a, b in pairs]
        for band, held in ((32, 1 << 23), (1, 1 << 23), (3, 2000)):  # little held: rows are computed again
            assert waves.align_all(pairs, mode, free_ends=free, band=band, held=held, few=0) == want
    ends = [(affine.align(a, b)[1], affine.align(b, a)[1]) for a, b in pairs]
    assert waves.local_ends(pairs) == [(x[-1][1], y[-1][1]) if x else None for x, y in ends]
    assert waves.sound("local") and not waves.sound("local", mismatch=-1.0) and not waves.sound("global")


def test_distances_within_a_bound_equal_whole_ones():
    rng = random.Random(5)
    for case in range(400):
        a = "".join(rng.choice("abé🙂" if case % 2 else "ab") for _ in range(rng.choice((0, 1, 30, 300))))
        b = "".join(rng.choice(["", "x", c + "y"]) if rng.random() < case % 7 / 20 else c for c in a)
        b = b[10:] + b[:10] if case % 5 == 0 else b
        d, least = distance.edits(a, b), distance.surplus(waves.codes(a), waves.codes(b))
        for most in {0, max(d - 1, 0), d, d + 1, 2 * d + 3, rng.randrange(40)}:
            want = d if d <= most else None
            assert distance.within(a, b, most) == distance.within(a, b, most, least) == want


def test_moves_of_long_texts_fill_no_whole_table(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghst") for _ in range(rng.randrange(2, 9))) for _ in range(1500)]
    noisy = [w.replace("s", "f") if i > 40 and i % 9 == 0 else w for i, w in enumerate(words)]
    turned = " ".join(noisy[30:] + noisy[:30])
    plain, sizes = moves.edits, []
    monkeypatch.setattr(moves, "edits", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    cost, n, moved = moves.character_edits(turned, " ".join(words))
    assert (n, moved) == (1, 30)
    assert cost == plain(" ".join(noisy), " ".join(words)) + sum(map(len, noisy[:30])) / 30
    assert max(sizes) < 1e6 < len(turned) ** 2 / 20


def test_answers_of_a_stretch_are_given_before_the_next_is_asked(spark):
    big = 2**53 + 1
    rows = [(big + i if i % 7 else None, f"p{i}" if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, prompt string").coalesce(1)
    model = lambda asked: [None if p is None else p.upper() + str(len(asked)) for p in asked]
    got = sorted(((r.k, r.prompt, r.answer) for r in correct.generate(df, model, batch=7).collect()), key=str)
    sizes = [min(7, 300 - i // 7 * 7) for i in range(300)]
    assert got == sorted(((k, p, p and p.upper() + str(n)) for (k, p), n in zip(rows, sizes)), key=str)


def test_windows_of_a_batch_leave_python_in_stretches(spark, monkeypatch):
    import public_tokenizers

    path, kinds = public_tokenizers.path("word_bpe_49k.json"), []
    plain = windows.F.arrow_udf
    monkeypatch.setattr(windows.F, "arrow_udf", lambda kind: kinds.append(kind) or plain(kind))
    texts = [(i, "the fish of é sea " * (i % 5) if i % 9 else None) for i in range(3 * windows.STRETCH + 5)]
    df = spark.createDataFrame(texts, "i long, t string").coalesce(1)
    got = {r.i: r.w for r in df.select("i", windows.token_windows(F.col("t"), path, 4, 0.5).alias("w")).collect()}
    assert kinds == [windows.WINDOWS] and len(got) == len(texts)
    tokens = windows.tokenizer(path)
    for i, t in texts:
        want = None if t is None else [b - a for a, b in windows.cuts(len(tokens.encode(t).ids), 4, 0.5)]
        assert (got[i] if got[i] is None else [w.tokens for w in got[i]]) == want


def test_vocabularies_compose_words_and_no_text(spark, monkeypatch):
    rng = random.Random(11)
    signs = "aAßſﬁsS éİµ①…¨´\u0308\u0301\u0327\u0345\u00a0\u2003\u3000\n\t\x1c-.,한글\u1100\u1161\u11a8ΣςﷺẞǄ\u0958🙂"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", " ", "the - end", "the the"]
    df = spark.createDataFrame([(i, t, t and t[::-1]) for i, t in enumerate(texts)], "i long, a string, b string")
    whole = {}
    for low in (False, True):
        for c in "ab":
            words = df.select(F.explode(tx.tokenize(tx.normalize_words(F.col(c), low))).alias("w"))
            whole[low, c] = Counter(r.w for r in words.collect())
    seen, plain = [], tx.compose
    monkeypatch.setattr(tx, "compose", lambda text, casefold=False: seen.append(text) or plain(text, casefold))
    for low in (False, True):
        got = corpus.vocabulary(df, ("a", "b"), low).collect()
        assert {r.word: r.a for r in got if r.a} == whole[low, "a"] and {r.word: r.b for r in got if r.b} == whole[low, "b"]
        freq = corpus.word_freq(df, "a", low)
        assert freq.dtypes == [("word", "string"), ("n", "bigint")] and {r.word: r.n for r in freq.collect()} == whole[low, "a"]
    assert len(seen) == 4 and all("_word" in str(c) for c in seen)
