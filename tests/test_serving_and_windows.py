"""Tokenizer windows, model serving, listed shards and mergeable vocabularies."""

import json
import os
import random
import time
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vellum.functions.windows import cuts, token_windows
from vellum.operators import corpus, serve
from vellum.sources import wanted

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_windows(text, window, overlap):
    """Windows one after the other, by hand."""
    from tokenizers import Tokenizer

    places, out, i = Tokenizer.from_file(PATH).encode(text).offsets, [], 0
    shared = window * overlap
    while places:
        start, end = int(i * (window - shared)), int((i + 1) * window - i * shared)
        if end >= len(places):
            return [*out, text[places[start][0] : max(b for _, b in places)]]
        out.append(text[places[start][0] : places[end][0]])
        i += 1
    return out


@pytest.mark.parametrize(("window", "overlap"), [(7, 0.2), (10, 0.0), (3, 0.5), (5, 0.33)])
def test_token_windows_against_slices(spark, window, overlap):
    rng = random.Random(window)
    texts = ["", " ", "word", "naïve 😀 café\n\nÄrger", "x" * 5000] + [" ".join(rng.choice(["the", "unbelievable", "cöté", "a-b", "12,5", "😀"]) for _ in range(rng.randrange(1, 90))) for _ in range(30)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.w for r in rows.select("i", token_windows(F.col("t"), PATH, window, overlap).alias("w")).collect()}
    for i, text in enumerate(texts):
        assert [w.text for w in got[i]] == plain_windows(text, window, overlap)
        assert all(text[w.start : w.end] == w.text and w.tokens <= window + 1 for w in got[i])
    assert got[len(texts)] is None and got[0] == []
    assert cuts(0, 5, 0.2) == []
    with pytest.raises(ValueError, match="move on"):
        token_windows(F.col("t"), PATH, 4, 1.0)


def test_a_model_is_set_up_once_a_worker_and_errors_are_rows(spark, tmp_path):
    log, calls = str(tmp_path / "setups"), str(tmp_path / "flaky")

    def setup():
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        time.sleep(0.2)

        def model(prompts):
            if any(p == "slow" for p in prompts):
                time.sleep(30)
            if any(p == "bad" for p in prompts):
                raise ValueError("no")
            if any(p == "flaky" for p in prompts) and len(prompts) == 1:
                with open(calls, "a") as out:
                    out.write("x")
                if os.path.getsize(calls) < 2:
                    raise OSError("busy")
            elif any(p == "flaky" for p in prompts):
                raise OSError("busy")
            return [p.upper() for p in prompts]

        return model

    prompts = [f"p{i}" for i in range(200)] + ["bad", "flaky", None, "", "p0", "p0"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, prompt string").repartition(12)
    served = rows.select("i", serve.serve(F.col("prompt"), setup, batch=4, tries=3).alias("r"))
    got = {r.i: r.r for r in served.collect()}
    loads = Counter(open(log).read().split())
    assert loads and set(loads.values()) == {1} and len(loads) <= 4
    for i, p in enumerate(prompts):
        if p == "bad":
            assert (got[i].answer, got[i].error, got[i].tries) == (None, "ValueError: no", 4)
        elif p is None:
            assert (got[i].answer, got[i].error, got[i].tries) == (None, None, 0)
        else:
            assert got[i].answer == p.upper() and got[i].error is None and got[i].tries >= 1
    assert got[201].tries in (2, 3)  # by whether its batch held other prompts
    slow = spark.createDataFrame([("slow",), ("quick",)], "prompt string").coalesce(1)
    begin = time.time()
    told = {r.prompt: r.r for r in slow.select("prompt", serve.serve(F.col("prompt"), setup, tries=1, timeout=0.5).alias("r")).collect()}
    assert time.time() - begin < 20
    assert told["quick"].answer == "QUICK" and told["slow"].error == "TimeoutError: no answer in 0.5 s"
    assert serve.answered(lambda ps: [], ["a"], 1, None)[0]["error"] == "ValueError: 0 answers to 1 prompts"
    empty = spark.createDataFrame([], "prompt string")
    assert empty.select(serve.serve(F.col("prompt"), setup)).count() == 0


def test_listed_shards_parse_no_other_lines(spark, tmp_path):
    line = lambda url, **more: json.dumps({"url": url, "text-orig": ["a b", "c"], "answer": [f"of {url}"], "flagged": "no", **more})
    lines = [line(f"./x/{i}.txt") for i in range(300)]
    lines[7] = line("./x/7.txt", answer=['says "url": "./x/999.txt"'])
    lines[11] = json.dumps({"flagged": "no", "answer": ["\\"], "url": "./x/a/b/11.txt"}).replace("/", "\\/")
    lines[250] = '{"url": "./x/250.txt", "text-orig": [broken'
    lines += [line("./x/5.txt"), json.dumps({"answer": ["no url"]}), '{"url": null}', "not json at all"]
    (tmp_path / "0.jsonl").write_text("\n".join(lines[:150]))
    (tmp_path / "1.jsonl").write_text("\n".join(lines[150:]))
    ids = spark.createDataFrame([("5",), ("5",), ("7",), ("11",), ("299",), (None,), ("no such",)], "book_id string")
    got = wanted.read_wanted(spark, str(tmp_path), ids, mode="FAILFAST").collect()  # the broken line would fail it
    assert sorted(r.book_id for r in got) == ["11", "299", "5", "5", "7"]
    assert {r.book_id: r.answer for r in got}["7"] == ['says "url": "./x/999.txt"'] and {r["text-orig"] is None for r in got if r.book_id == "11"} == {True}
    assert wanted.read_wanted(spark, str(tmp_path), ids.limit(0)).count() == 0


def test_the_filter_loses_no_id_and_lets_few_others_pass(spark):
    ids = spark.range(20000).select(F.concat(F.lit("b"), F.col("id")).alias("k"))
    asked = spark.range(40000).select(F.concat(F.lit("b"), F.col("id")).alias("k"), (F.col("id") < 20000).alias("in"))
    row = asked.crossJoin(F.broadcast(wanted.bloom(ids, "k"))).select("in", wanted.may_hold(F.col("k"), F.col("bits"), F.col("words")).alias("hit"))
    counts = {(r["in"], r.hit): r["count"] for r in row.groupBy("in", "hit").count().collect()}
    assert counts[True, True] == 20000 and counts.get((False, True), 0) < 400


def test_sketches_of_groups_merge_to_the_whole_vocabulary(spark):
    rng = random.Random(3)
    docs = [(i % 5, " ".join(f"w{rng.randrange(4000)}" for _ in range(200))) for i in range(200)] + [(0, None), (1, "")]
    df = spark.createDataFrame(docs, "part int, original string")
    sketches = corpus.vocabulary_sketches(df, "part", ["original"])
    whole = corpus.merged_vocabulary(sketches).collect()
    by_part = {r.part: r.words for r in corpus.merged_vocabulary(sketches, "part").collect()}
    exact = lambda part=None: len({w for p, t in docs if t and part in (None, p) for w in t.split()})
    assert len(whole) == 1 and abs(whole[0].words - exact()) <= 4 * 1.04 / 64 * exact()
    assert set(by_part) == set(range(5)) and all(abs(n - exact(p)) <= 4 * 1.04 / 64 * exact(p) for p, n in by_part.items())
    assert corpus.merged_vocabulary(corpus.vocabulary_sketches(df.limit(0), "part", ["original"])).count() == 0
