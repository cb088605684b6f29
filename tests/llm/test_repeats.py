"""Rows that repeat, ids that are null and columns that clash, in the trained operators, the
span operator and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import langid, substring, toxicity

rng = random.Random(12)
FR, EN = ["le", "chat", "est", "dans", "maison", "rouge"], ["the", "cat", "is", "in", "house", "red"]
some = lambda words, n=30: " ".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("doc_id", [0, 1, 3, 4, 6, 7, None])
def test_language_and_toxicity_with_thousands_of_copies_of_one_row(spark, doc_id):
    rows = [(doc_id, "a plain text", "en")] * 6000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model["names"] in (["en"], [])  # none if the id lies in the test fold
    got = langid.predict(docs, model).groupBy("lang_pred").count().collect()
    assert [tuple(r) for r in got] == [("en" if model["names"] else "und", 6000)]
    labels = spark.createDataFrame([(doc_id, 1), (None, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 6000


def test_every_language_is_learned_however_few_its_texts(spark):
    rows = [(i, some(EN), "en") for i in range(300)] + [(1000 + i, "le chat est dans la maison", "fr") for i in range(500)] + [(None, "der hund und das haus", "de")] * 700
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=30)
    assert model["names"] == ["de", "en", "fr"]
    assert langid.spoken(model, ["le chat est", "the cat is red", "der hund", "12", ""]) == ["fr", "en", "de", "und", "und"]


def test_more_languages_than_the_sample_and_reruns_agree(spark):
    rows = [(i, f"{chr(97 + i % 20) * 5} text {i}", f"l{i % 20:02}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first, again = langid.train(docs, sample=7), langid.train(docs.repartition(7), sample=7)
    assert len(first["names"]) == 7 and first["names"] == again["names"] and np.array_equal(first["w"], again["w"])


def test_toxicity_with_copies_of_both_classes_and_empty_texts(spark):
    bad, good = "vile slur here", "kind words here"
    rows = [(i, bad if i % 2 else good, "en") for i in range(200)] + [(3, bad, "en")] * 3000 + [(None, bad, "en"), (500, None, None), (501, "", "en"), (502, good + " x" * 60000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, 0), (501, 0), (502, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels)
    by = {r.doc_id: r.predicted for r in got.collect()}
    assert got.count() == len(rows) and by[None] == 1 and by[500] == by[501] and by[502] == 0
    assert all(by[i] == i % 2 for i in range(200))


def test_codes_hold_the_buckets_and_bound_long_texts():
    text = "One two one " + "filler " * 40000 + "last"
    got = toxicity.codes("One two one")
    assert len(got) == 3 and got[0] == got[2]
    code = int(got[1])
    held = []
    for _ in range(1 + len(toxicity.PREFIXES)):
        code, b = divmod(code, toxicity.BUCKETS)
        held.append(b)
    assert held[::-1] == toxicity.buckets("two")
    long = toxicity.codes(text)
    assert len(long) == toxicity.PLACES and long[0] == got[0] and long[-1] == toxicity.codes("last")[0]
    assert len(toxicity.codes(None)) == 0


def test_pooled_responses_are_a_plain_convolution():
    net = toxicity.Net(4)
    words = np.random.default_rng(1).normal(size=(9, toxicity.DIM)).astype(np.float32)
    words[0] = 0
    for ids in (toxicity.padded([]), toxicity.padded([3, 1, 3, 8, 2]), toxicity.padded([5] * (toxicity.BLOCK + 7) + [2])):
        top, where = toxicity.pooled(net.taps(words), ids)
        n, at = len(ids) - max(toxicity.WIDTHS) + 1, 0
        for kernel in net.kernels:
            for f in range(toxicity.FILTERS):
                plain = [sum(float(words[ids[p + t]] @ kernel[t, :, f]) for t in range(len(kernel))) for p in [*range(min(n, 50)), *range(max(0, n - 50), n)]]
                assert abs(max(plain) - top[at]) < 1e-4
                at += 1
        assert (where < n).all()


def test_spans_tell_texts_of_null_and_repeated_ids_apart(spark):
    shared = " ".join(some(EN, 12).capitalize() + "." for _ in range(4))
    rows = [(None, f"Text {i} has its own start {some(FR, 5)}. {shared} " + some(FR, i % 9)) for i in range(60)]
    rows += [(7, f"Row {i} of one id {some(FR, 6)}. {shared}") for i in range(30)] + [(None, None), (7, None), (7, ""), (None, rows[3][1])]
    docs = spark.createDataFrame([(i, t, b"clash", 1) for i, t in rows], "doc_id long, text string, k binary, pos int")
    got = substring.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r.text and shared in r.text]
    assert len(kept) == 1 and kept[0].doc_id == 7
    for own in ("Text 0 ", "Text 59 ", "Row 29 "):
        assert any(r.text and r.text.startswith(own) for r in got)


def test_dedup_stages_keep_columns_that_clash(spark, tmp_path):
    rows = [(i, f"text {i // 2} " + some(EN, 40) if i % 2 == 0 else None, 70 + i, -i, i % 3) for i in range(20)]
    rows = [(i, rows[i - 1][1] if t is None else t, a, b, c) for i, t, a, b, c in rows] + [(None, rows[0][1], 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, _group long, doc int")
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] is not None and r[0] % 2 == 0)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs.withColumn("lang", F.lit(None).cast("string"))
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and left.where(F.col("_row") > 100).count() == 0
