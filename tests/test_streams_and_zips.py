"""Zip archives split by member, and a stream that is answered once."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.sources import io, zipped
from vellum.streaming import resume


def test_archives_are_split_by_member_and_never_read_whole(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    want = []
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("folder")
            for m in range(5):
                lines = ["" if rng.random() < 0.2 else f"[[{rng.randrange(99)}, {rng.randrange(99)}]] é" for _ in range(rng.choice([0, 1, 7, 2500]))]
                z.writestr(f"folder/{m}.txt", "\r\n".join(lines) if m % 2 else "\n".join(lines))
                want += [(f"{a}.zip", f"folder/{m}.txt", i, t) for i, t in enumerate(lines) if t]
    (tmp_path / "notes.txt").write_text("not an archive")
    got = io.read_zipped(spark, str(tmp_path))
    rows = [(r.archive.rsplit("/", 1)[-1], r.name, r.line, r.text) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    assert [tuple(s) for s in got.where("line = 0").first().spans] != []
    one = io.read_zipped(spark, str(tmp_path / "1.zip"))
    assert one.count() == sum(w[0] == "1.zip" for w in want)

    reader = zipped.ZipReader(str(tmp_path), 1)
    full = {w[:2] for w in want}
    assert all(sum((f.rsplit("/", 1)[-1], n) in full for f, n in p.members) <= 1 for p in reader.partitions())  # none fits beside another
    assert sum(len(p.members) for p in reader.partitions()) == 15
    assert len(zipped.ZipReader(str(tmp_path), 1 << 30).partitions()) == 1
    monkeypatch.setattr(zipfile.ZipExtFile, "readlines", None)
    monkeypatch.setattr(zipfile.ZipFile, "read", None)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) >= len(want)
    with pytest.raises(FileNotFoundError):
        zipped.ZipReader(str(tmp_path / "none"), 1).partitions()


def test_batches_end_at_lines_and_at_characters():
    lines = [b"x" * 10 + b"\n"] * (2 * zipped.LINES + 5) + [b"y" * zipped.CHARACTERS + b"\r\n", b"last \xff"]
    got = list(zipped.batches("a", "m", iter(lines)))
    assert [b.num_rows for b in got] == [zipped.LINES, zipped.LINES, 6, 1]
    assert [n for b in got for n in b["line"].to_pylist()] == list(range(len(lines))) and got[-1]["text"][0].as_py() == "last �"


def test_archives_that_are_written_are_read_again(spark, tmp_path):
    rows = [(f"m{i}.txt", f"[[{i}, {i + 1}]]\n\nsecond {i}") for i in range(40)] + [("null.txt", None), ("m3.txt", "[[3, 4]]\n\nsecond 3")]
    df = spark.createDataFrame(rows, "name string, text string").repartition(4, "name")
    zipped.write_archives(df, str(tmp_path / "out"))
    zipped.write_archives(df, str(tmp_path / "out"))  # again: replaces
    got = io.read_zipped(spark, str(tmp_path / "out"))
    assert sorted((r.name, r.line) for r in got.collect()) == sorted((f"m{i}.txt", k) for i in range(40) for k in (0, 2))


def test_a_batch_that_is_delivered_again_changes_nothing(spark, tmp_path):
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    put = lambda name, rows: (folder / name).write_text("".join(json.dumps({"id": i, "input": t}) + "\n" for i, t in rows))
    put("a.json", [(1, "one"), (2, "two"), (2, "two"), (None, "null")])
    schema = "id long, input string"
    seen = spark.sparkContext.accumulator(0)
    fail = spark.sparkContext.broadcast({"on": None})

    def model(prompts):
        seen.add(len(prompts))
        if fail.value["on"] in prompts:
            raise RuntimeError("lost")
        return [p.upper() for p in prompts]

    run = lambda m=model: resume.answer_once(resume.pair_stream(spark, str(folder), 1, schema), m, out, marks, key="id").awaitTermination()
    read = lambda: sorted(((r.id, r.answer) for r in resume.answers(spark, out, spark.createDataFrame([], schema).schema).collect()), key=str)
    run()
    first = [(1, "ONE"), (2, "TWO"), (None, "NULL")]
    assert read() == sorted(first, key=str) and seen.value == 3
    put("b.json", [(2, "two"), (3, "three"), (1, "one")])  # arrives again, with one new row
    run()
    assert read() == sorted([*first, (3, "THREE")], key=str) and seen.value == 4

    put("c.json", [(4, "four"), (5, "five")])

    def broken(prompts):
        if "five" in prompts:
            raise RuntimeError("lost")
        return prompts

    with pytest.raises(Exception, match="lost"):
        run(broken)
    # a part of the batch was left behind; the batch comes again under its number
    spark.createDataFrame([(4, "four", "half")], f"{schema}, answer string").write.mode("overwrite").parquet(f"{out}/batch=2")
    run()
    assert read() == sorted([*first, (3, "THREE"), (4, "FOUR"), (5, "FIVE")], key=str)
    batch = spark.createDataFrame([(4, "four"), (6, "six")], schema)
    assert resume.remaining(batch, resume.answers(spark, out, batch.schema), "id").select(F.collect_list("id")).first()[0] == [6]
