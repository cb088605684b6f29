"""Licence scan by sparse TF-IDF cosine, in DataFrame functions only.

Each block of a page's visible text, and the page's text as a whole, is compared with the
templates of licences: references, notices, and whole texts (``license_templates``).  A
vector has a place for each word that some template has, weighted by the logarithm of its
count and its rarity over all blocks and pages; any other word counts as a word of its own
that is as rare as can be.  So the vocabulary is bounded by the templates, and a text's
cosine to each is a join on words and two sums.

Only what cannot come near any template is left out before that join.  The cosine is at
most the root of the share that words of templates have in a text's squared length, which
has a bound that needs no weights (see :data:`STEEP`); and it is at most what it would be
if each word met the template where it weighs most.  No word is asked for.

A page that comes near enough to a template declares that licence, for itself and for its
directory.  Every other page inherits from its nearest ancestor directory for which a
licence is declared, by an equality join of the distinct directories' ancestors with the
declaring directories.  Only words of templates are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, materialise
from vellum.llm.license_templates import templates as published
from vellum.llm.urls import parse

NEAR = 0.75
TOKEN = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"
#: Tags that part blocks; others stand within a line.
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
#: The last step of the path of a file that states a licence.
FILE = r"(?i)^(un)?(licen[sc]es?|copying|copyright|notice)([-._][^/]*)?$"
#: (1 + ln n) ** 2 is at most this times n, which it reaches at n = e.
STEEP = 1.4716


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, versions kept whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def blocks(html: Column) -> Column:
    """The words of each distinct block of visible text; blank lines part blocks too."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n\n"), r"(?s)</?[a-zA-Z][^>]*>", "")
    text = F.regexp_replace(text, "&[a-zA-Z#0-9]+;", " ")
    return F.filter(F.transform(F.array_distinct(F.split(text, r"\r?\n\s*\n")), words), lambda w: F.size(w) > 0)


def units(html: Column, vocabulary: Sequence[str]) -> Column:
    """``array<struct<hits, n>>``: of each block, and last of the whole page if it has
    several, the words of the vocabulary, repeats included, and the number of words.

    The nested one-element transforms keep what is common to all blocks from being
    computed again for each."""
    known = F.split(F.lit(" ".join(vocabulary)), " ")
    pick = lambda own: lambda w: F.struct(F.filter(w, lambda x: F.array_contains(own, x)).alias("hits"), F.size(w).alias("n"))
    both = F.transform(F.array(blocks(html)), lambda all_words: F.transform(F.array(F.array_intersect(F.flatten(all_words), known)), lambda own: F.transform(all_words, pick(own))))
    whole = lambda u: F.struct(F.flatten(F.transform(u, lambda x: x["hits"])).alias("hits"), F.aggregate(u, F.lit(0), lambda s, x: s + x["n"]).alias("n"))
    return F.transform(F.flatten(both), lambda u: F.when(F.size(u) > 1, F.concat(u, F.array(whole(u)))).otherwise(u))[0]


def weight(count: Column, idf: Column) -> Column:
    return (1 + F.log(count)) * idf


def match(rows: DataFrame, templates: Sequence[tuple[str, str]], near: float = NEAR) -> DataFrame:
    """``rows(row, units)`` to the best ``row, license, score`` of those with a text that
    is near enough; of equal scores the later name."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    each = rows.select("row", F.posexplode("units").alias("unit", "u")).select("row", "unit", "u.hits", "u.n")
    total = cut(each.agg(F.count("*").alias("total")))
    rare = F.log(1 + F.col("total")) + 1
    df = each.select(F.explode(F.array_distinct("hits")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    counted = listed.select("template", F.explode(words(F.col("text"))).alias("word")).groupBy("template", "word").agg(F.count("*").alias("tf"))
    # a row for each word of the templates; one row
    idf = counted.select("word").distinct().join(df, "word", "left").crossJoin(F.broadcast(total)).select("word", (F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    idf = cut(idf)
    weighed = counted.join(F.broadcast(idf), "word").select("template", "word", weight(F.col("tf"), F.col("idf")).alias("v"))
    length = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    known = cut(weighed.join(length, "template").join(listed.select("template", "license"), "template").select("template", "license", "word", (F.col("v") / F.col("length")).alias("v")))
    weights = cut(known.groupBy("word").agg(F.max("v").alias("most")).join(idf, "word"))
    share = near * near
    open_ = each.where(STEEP * F.size("hits") * (1 - share) >= share * (F.col("n") - F.size("hits")))
    found = open_.select("row", "unit", (F.col("n") - F.size("hits")).alias("others"), F.explode("hits").alias("word")).groupBy("row", "unit", "others", "word").agg(F.count("*").alias("tf"))
    # the tables of words are bounded by the templates
    vectors = found.join(F.broadcast(weights), "word").select("row", "unit", "others", "word", weight(F.col("tf"), F.col("idf")).alias("w"), "most")
    norms = vectors.groupBy("row", "unit", "others").agg(F.sum(F.col("w") * F.col("w")).alias("squares"), F.sum(F.col("w") * F.col("most")).alias("bound")).crossJoin(F.broadcast(total))
    norms = norms.withColumn("norm", F.sqrt(F.col("squares") + F.col("others") * rare * rare)).where(F.col("bound") >= near * F.col("norm") * (1 - 1e-9))
    norms = materialise(norms.select("row", "unit", "norm"), "licence-candidates")
    near_ones = vectors.join(norms, ["row", "unit"]).select("row", "unit", "norm", "word", "w")
    products = near_ones.join(F.broadcast(known), "word").groupBy("row", "unit", "norm", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("product"))
    scores = products.select("row", "license", (F.col("product") / F.col("norm")).alias("score")).where(F.col("score") >= near)
    best = scores.groupBy("row").agg(F.max(F.struct(F.round("score", 6).alias("score"), "license")).alias("b"))
    return best.select("row", "b.license", "b.score")


def scan(pages: DataFrame, templates: Sequence[tuple[str, str]] | None = None, near: float = NEAR) -> DataFrame:
    """One row per page: page_id, path, license, score, origin, declared_in.

    ``path`` is host and path of the URL, its directory what precedes the last slash.
    ``origin`` is ``own``, ``inherited`` or ``none``; ``declared_in`` the directory that
    counts.  Where a directory declares several licences, its licence files count first,
    then the licence on most pages, then the first by name.  Null or scheme-less URLs have
    an empty path and directory and neither declare nor inherit for others; null html has
    no text; rows that repeat are alike; an empty table gives none.
    """
    templates = list(templates or published())
    host, path, _ = parse(F.col("url"))
    full = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))
    full = F.when(host == "", F.lit("")).otherwise(full)
    vocabulary = sorted({r["word"] for r in pages.sparkSession.createDataFrame(templates, "license string, text string").select(F.explode(words(F.col("text"))).alias("word")).collect()})
    rows = materialise(pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id", full.alias("path"), F.regexp_replace(full, "[^/]*$", "").alias("dir"), F.substring_index(full, "/", -1).rlike(FILE).alias("file"), units(F.col("html"), vocabulary).alias("units"),
    ), "licence-words")
    own = materialise(match(rows.select("row", "units"), templates, near), "licences")
    placed = rows.select("row", "page_id", "path", "dir", "file").join(own, "row", "left")
    votes = placed.where("dir <> '' AND license IS NOT NULL").groupBy("dir", "license").agg(F.max("file").alias("file"), F.count("*").alias("n"))
    declared = votes.groupBy("dir").agg(F.min_by("license", F.struct(~F.col("file"), -F.col("n"), "license")).alias("license"))
    # written, so that the join's sides are plain shuffles, whose skew is split
    declared = materialise(declared.select(F.col("dir").alias("up"), "license"), "declared")
    steps = F.split(F.col("dir"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    folders = rows.where("dir <> ''").select("dir").distinct()
    nearest = folders.select("dir", F.explode(above).alias("up")).join(declared, "up").groupBy("dir").agg(F.max_by(F.struct("up", "license"), F.length("up")).alias("b"))
    nearest = materialise(nearest.select("dir", F.col("b.up").alias("up"), F.col("b.license").alias("inherited")), "nearest")
    return placed.join(nearest, "dir", "left").select(
        "page_id", "path", F.coalesce("license", "inherited").alias("license"), "score",
        F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("dir")).otherwise(F.col("up")).alias("declared_in"),
    )
