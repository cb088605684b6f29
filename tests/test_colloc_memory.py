"""collocations are counted in little memory and given on in short batches."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa

from vellum.operators import collocate


def test_counts_of_many_words_stay_small():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 50]), pa.array([None, *texts[i + 1 : i + 50]], pa.string())], ["t0", "t1"]) for i in range(0, 400, 50)]
    pairs, words = 0, Counter()
    for text in texts:
        t = text.split(" ")
        words.update(t)
        pairs += len(t) - 1 + len(t) - 2
    rows, seen, most = Counter(), Counter(), 0
    tracemalloc.start()
    for out in collocate._counted(["x", "y"], 2)(iter(batches)):
        most = max(most, out.num_rows)
        named = out.column(1).is_null().to_numpy(zero_copy_only=False)
        for word, n in zip(out.column(2).to_numpy(zero_copy_only=False)[named], out.column(3).to_numpy()[named]):
            seen[word] += n
        for k in (3, 4):
            rows[k] += int(out.column(k).to_numpy()[~named].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == words and rows[3] == pairs and rows[4] == pairs * 392 // 400
    assert most <= 1 << 16 and peak < 150_000_000


def test_texts_are_counted_once(spark):
    """Words, pairs and totals share one aggregation and its shuffle."""
    texts = spark.createDataFrame([(1, "a b a b a b a b c", "a b"), (2, None, "b")], "doc_id int, x string, y string")
    found = collocate.collocations_by(texts, ["x", "y"]).where("w1 < w2")
    assert [(r.w1, r.w2, r.f12_x, r.f12_y) for r in found.collect()] == [("a", "b", 7, None)]
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 1 and "Reused" in final
