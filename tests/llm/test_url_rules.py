"""Bounded mining of URL rules: parts of wide rows, page floors, the share's lower bound."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from vellum.llm import urls


@pytest.mark.parametrize(("width", "longest"), [(15, 2), (15, 3), (8, 3)])
def test_frequent_sets_in_parts_against_every_short_set(spark, width, longest):
    rng = random.Random(width + longest)
    names = [f"p:{chr(97 + i)}" for i in range(width)]
    rows = [(sorted(n for n in names if rng.random() < 0.55), rng.choice(["allow", "block"])) for _ in range(120)] + [([], "block"), (names, "allow")]
    fewest = 25
    want = {}
    for n in range(1, longest + 1):
        for need in itertools.combinations(names, n):
            hit = [v for bag, v in rows if set(need) <= set(bag)]
            for verdict, count in ((None, len(hit)), ("allow", hit.count("allow")), ("block", hit.count("block"))):
                if count >= fewest:
                    want[need, verdict] = count
    baskets = spark.createDataFrame(rows, "kinds array<string>, verdict string")
    got = urls.frequent_sets(baskets, fewest, width, longest).collect()
    assert {(tuple(r.kinds), r.verdict): r.freq for r in got} == want and len(got) == len(want)


def test_rules_of_long_urls_with_similar_steps(spark):
    rng = random.Random(5)
    url = lambda: "http://h.example/" + "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30) if rng.random() < 0.8)
    made = [url() for _ in range(1500)]
    labels = spark.createDataFrame([(u, "block" if "/sba" in u and "/sca" in u and "/sda" not in u else "allow") for u in made], "url string, verdict string")
    bad, good = "http://h.example/sba/sca/sea/sbb", "http://h.example/sca/sda"
    asked = spark.createDataFrame([(1, good), (2, bad), (3, None), (4, "")], "page_id long, url string")
    begin = time.time()
    got = {r.page_id: r for r in urls.judge(asked, rules=(), labels=labels, support=0.05, least=5, surely=0.5, longest=3).collect()}
    assert time.time() - begin < 90
    assert got[1].verdict == "allow" and got[1].pages >= 5
    assert got[3].verdict == got[4].verdict == "allow" and got[3].pages is None and got[4].pages is None


def test_rules_rest_on_pages_and_their_lower_bound(spark):
    known = [(["h:a", "p:x"], "block")] * 4 + [(["h:b", "p:x"], "block")] * 9 + [(["h:c", "p:x"], "allow")] * 9
    rows = spark.createDataFrame(known, "tokens array<string>, verdict string")
    mined = lambda **more: {(*r.kinds, r.verdict): r for r in urls.mine(rows, urls.classes(rows, 0.002, more.get("least", 1)), **more).collect()}
    assert ("h:a", "block") in mined() and mined()["h:a", "block"].pages == 4
    strict = mined(least=5, surely=0.5, longest=3)
    assert ("h:a", "block") not in strict and {("h:b", "block"), ("h:c", "allow")} <= set(strict)
    assert ("h:b", "block") not in mined(surely=0.9)
    bound = spark.range(1).select(urls.wilson(F.lit(8), F.lit(10)).alias("b")).first().b
    z, p, n = 1.96, 0.8, 10
    assert abs(bound - (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) < 1e-12


def test_the_query_has_no_rule_on_few_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = urls.judge(pages, least=5, surely=0.5, longest=3)
    assert got.count() == pages.count()
    mined = got.where("pages IS NOT NULL")
    assert mined.where("pages < 5 OR rule IS NOT NULL").count() == 0
    clash = pages.withColumn("pages", F.lit("x")).withColumn("mined", F.lit(1)).withColumn("host", F.lit(2))
    assert urls.judge(clash, least=5, surely=0.5, longest=3).exceptAll(got).count() == 0
    empty = urls.judge(pages.limit(0), least=5, surely=0.5, longest=3)
    assert empty.count() == 0
