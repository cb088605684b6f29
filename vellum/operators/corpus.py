"""Books, vocabularies, term trends and edit statistics (FLT, JOIN, AGG, SET, TOP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.metrics import improvement, ratio


# Pages and books


def not_blank(text: Column) -> Column:
    """FLT1."""
    return F.lower(tx.strip(text)) != "blank"


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """FLT3: (book, page) that occur more than once."""
    return pages.groupBy("book_id", "page").agg(F.count("*").alias("n")).where("n > 1")


def complete_books(pages: DataFrame) -> DataFrame:
    """FLT2: books whose pages run from 1 to their number."""
    return pages.groupBy("book_id").agg(F.count("*").alias("pages"), F.max("page").alias("last")).where("pages = last")


def join_pages(pages: DataFrame) -> DataFrame:
    """AGG12, TXT15, TOP6: a row per complete book, pages in order, blank ones left out
    of each text by itself, a blank line between."""
    kept = pages.join(complete_books(pages).select("book_id"), "book_id", "left_semi")
    one = lambda c: F.collect_list(F.when(not_blank(F.col(c)), F.struct(F.col("page"), F.col(c).alias("t"))))
    books = kept.groupBy("book_id").agg(one("input").alias("i"), one("output").alias("o"))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["t"]), "\n\n")
    return books.select("book_id", text("i").alias("input"), text("o").alias("output"))


def join_books(references: DataFrame, books: DataFrame, combine: bool = True) -> DataFrame:
    """JOIN2, JOIN3, SET3: reference books with their OCR book; ``books(book_id, original,
    corrected, corrected_pp)`` of segments, joined by a space with ``combine``."""
    cols = ("original", "corrected", "corrected_pp")
    ocr = books.select("book_id", *[(F.array_join(c, " ") if combine else F.col(c)).alias(c) for c in cols])
    return references.join(ocr, "book_id").select("book_id", *cols, F.col("input").alias("ref_input"), F.col("output").alias("reference"))


def pair_alignments(books: DataFrame, alignments: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """JOIN5-7, FLT11, FLT12: books with their alignment by url, without the metadata row
    and those already done.  A book without alignment fails the query."""
    todo = books.where(F.col("url") != "./all_files.txt")
    todo = todo.join(done.select("url"), "url", "left_anti") if done is not None else todo
    found = todo.join(alignments.withColumn("_here", F.lit(True)), "url", "left")
    check = F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("no alignment of "), "url"))).otherwise(F.lit(True))
    return found.where(check).drop("_here")


# Vocabularies


def _written(docs: DataFrame, columns) -> DataFrame:
    """``_k, _word``: a row for each word as written, with its text column's number.
    Words are counted before they are folded and composed, so that Python, which has no
    built-in to stand for it, sees each of them once and no text."""
    texts = [F.struct(F.lit(k).alias("_k"), tx.written_words(F.col(c)).alias("_words")) for k, c in enumerate(columns)]
    return docs.select(F.inline(F.array(*texts))).select("_k", F.explode("_words").alias("_word"))


def word_freq(docs: DataFrame, column: str, lowercase: bool = False) -> DataFrame:
    """AGG1: ``word, n``."""
    return vocabulary(docs.select(F.col(column).alias("n")), ("n",), lowercase)


def vocabulary(docs: DataFrame, columns=("original", "corrected", "reference"), lowercase: bool = False) -> DataFrame:
    """JOIN9, JOIN10, SET1, SET2: ``word`` and its count in each text column, 0 if absent,
    out of one scan; words as written are counted, then those that compose alike."""
    written = _written(docs, columns).groupBy("_word").agg(*[F.count_if(F.col("_k") == k).alias(c) for k, c in enumerate(columns)])
    words = written.select(F.explode(tx.composed_words(F.col("_word"), lowercase)).alias("word"), *columns)
    return words.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])


def vocabulary_sketches(docs: DataFrame, group: str, columns=("original", "corrected", "reference"), lowercase: bool = False, log_size: int = 12) -> DataFrame:
    """AGG2 that merges: a HyperLogLog sketch of each group's words in each text column.
    Groups add up later without their texts (:func:`merged_vocabulary`)."""
    words = [docs.select(group, F.lit(c).alias("variant"), F.explode(tx.tokenize(tx.normalize_words(F.col(c), lowercase))).alias("word")) for c in columns]
    every = words[0]
    for more in words[1:]:
        every = every.unionByName(more)
    return every.groupBy(group, "variant").agg(F.hll_sketch_agg("word", log_size).alias("sketch"))


def merged_vocabulary(sketches: DataFrame, *by: str) -> DataFrame:
    """Estimated vocabulary sizes of sketches merged by ``variant`` and more columns.  The
    estimate's standard error is 1.04 / sqrt(2^log_size), 1.6 % of 12."""
    return sketches.groupBy("variant", *by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("words"))


def vocabulary_changes(counts: DataFrame) -> DataFrame:
    """AGG2, AGG3: removed and new words, with the share of singletons and of words that
    the reference lacks; null shares of empty sets."""
    rows = []
    for change, had, has in (("removed", "original", "corrected"), ("new", "corrected", "original")):
        of = counts.where((F.col(had) > 0) & (F.col(has) == 0))
        rows.append(of.agg(
            F.lit(change).alias("change"), F.count("*").alias("words"), ratio(100 * F.count_if(F.col(had) == 1), F.count("*")).alias("singleton_pct"), ratio(100 * F.count_if(F.col("reference") == 0), F.count("*")).alias("unknown_pct"),
        ))
    return rows[0].unionByName(rows[1])


def top(rows: DataFrame, k: int, by: str, *ties: str, ascending: bool = False) -> DataFrame:
    """TOP1, TOP2: ties go by the named columns."""
    return rows.orderBy(F.asc(by) if ascending else F.desc(by), *ties).limit(k)


def idf(docs: DataFrame, column: str) -> DataFrame:
    """AGG20: smoothed inverse document frequency of lower-case words of two letters or
    more: ``word, df, idf``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)))
    n = docs.agg(F.count("*").alias("docs"))
    df = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", "df", (F.log((1 + F.col("docs")).cast("double") / (1 + F.col("df"))) + 1).alias("idf"))  # n: one row


def idf_band(docs: DataFrame, column: str, k: int = 300, low: float = 2, high: float = 5) -> DataFrame:
    """FLT13: of the k most frequent words, those with idf within the band."""
    common = top(word_freq(docs, column, lowercase=True), k, "n", "word")
    return common.join(idf(docs, column), "word").where(F.col("idf").between(low, high))


# Years


def year_stats(years: DataFrame, low: int = 1680, high: int = 1805) -> DataFrame:
    """AGG9, FLT6."""
    return years.where(F.col("year").between(low, high)).agg(F.min("year").alias("first"), F.max("year").alias("last"), F.avg("year").alias("mean"), F.count("*").alias("books"))


def year_hist(years: DataFrame, low: int = 1680, high: int = 1805) -> DataFrame:
    """AGG10: books by year."""
    return years.where(F.col("year").between(low, high)).groupBy("year").agg(F.count("*").alias("books"))


def year_bins(years: DataFrame) -> DataFrame:
    """AGG10 as drawn: as many bins as years between first and last, the last one closed,
    so it holds two years."""
    ends = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    binned = years.crossJoin(F.broadcast(ends))  # one row
    return binned.groupBy(F.least(F.col("year") - F.col("lo"), F.greatest(F.col("hi") - F.col("lo") - 1, F.lit(0))).alias("bin")).agg(F.count("*").alias("books"))


def term_by_year(docs: DataFrame, years: DataFrame, term: str, before: str = "original", after: str = "corrected") -> DataFrame:
    """AGG11, JOIN4, TXT13: occurrences of a term by year in both texts; years without
    any are absent."""
    counted = docs.select("doc_id", tx.term_count(F.col(before), term).alias("b"), tx.term_count(F.col(after), term).alias("a"))
    return counted.join(years, "doc_id").groupBy("year").agg(F.sum("b").alias("before"), F.sum("a").alias("after")).where("before + after > 0")


# Edit strings: parallel original, corrected, ops


def op_counts(edits: DataFrame) -> DataFrame:
    """AGG5, WIN7: operations and their share."""
    n = edits.select(F.explode(F.split("ops", "")).alias("op")).where("op <> ''").groupBy("op").agg(F.count("*").alias("n"))
    return n.withColumn("pct", ratio(100 * F.col("n"), F.sum("n").over(Window.partitionBy())))


def change_runs(edits: DataFrame) -> DataFrame:
    """AGG6, WIN5: maximal runs of operations other than a match that a match follows:
    ``doc_id, start, length, change``, gaps shown.  Texts are split once and indexed."""
    signs = F.struct(*[tx.characters(F.col(c)).alias(c) for c in ("original", "corrected", "ops")])

    def runs(s: Column) -> Column:
        hit = lambda i: F.get(s["ops"], i) == "|"
        at = F.when(F.size(s["ops"]) > 0, F.sequence(F.lit(0), F.size(s["ops"]) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: ~hit(i) & ((i == 0) | hit(F.greatest(i - 1, F.lit(0)))))
        ends = F.filter(at, lambda i: (i > 0) & hit(i) & ~hit(F.greatest(i - 1, F.lit(0))))
        closed = F.filter(F.arrays_zip(starts.alias("i"), ends.alias("j")), lambda r: r["j"].isNotNull())
        part = lambda c, r: tx.show_gaps(F.array_join(F.slice(s[c], r["i"] + 1, r["j"] - r["i"]), ""))
        change = lambda r: F.concat(part("original", r), F.lit(" -> "), part("corrected", r))
        return F.transform(closed, lambda r: F.struct(r["i"].alias("start"), (r["j"] - r["i"]).alias("length"), change(r).alias("change")))

    return edits.select("doc_id", F.inline(tx.once(signs, runs)))


def change_lengths(runs: DataFrame) -> DataFrame:
    """AGG7: runs by length, with their share."""
    n = runs.groupBy("length").agg(F.count("*").alias("n"))
    return n.withColumn("pct", ratio(100 * F.col("n"), F.sum("n").over(Window.partitionBy())))


def long_changes(runs: DataFrame) -> DataFrame:
    """AGG7: runs over five and over ten signs."""
    return runs.agg(F.count("*").alias("changes"), F.count_if(F.col("length") > 5).alias("over_5"), F.count_if(F.col("length") > 10).alias("over_10"))


def change_types(runs: DataFrame, shorter_than: int = 5) -> DataFrame:
    """AGG8: short changes by kind, as a share of all changes."""
    n = runs.groupBy("change", (F.col("length") < shorter_than).alias("short")).agg(F.count("*").alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("total")))  # one row
    return n.where("short").crossJoin(total).select("change", "n", ratio(100 * F.col("n"), F.col("total")).alias("pct"))


# Trials


def trial_chunks(trials: DataFrame, size: int = 200) -> DataFrame:
    """AGG13, MET11: weighted clipped improvement of each full chunk of a model's trials;
    chunks short of ``size`` are dropped.

    ``trials(model, row_id, original, predicted, weight)``.
    """
    part = trials.withColumn("chunk", F.floor(F.col("row_id") / size))
    gain = improvement(F.col("original"), F.col("predicted"))
    rows = part.withColumn("gain", gain).groupBy("model", "chunk").agg(F.count("*").alias("n"), ratio(F.sum(F.col("gain") * F.col("weight")), F.sum("weight")).alias("improvement"))
    return rows.where(F.col("n") == size)


def top_per_group(rows: DataFrame, group: str, by: str, tie: str, k: int = 10) -> DataFrame:
    """TOP4, TOP5, SET7: the best k of each group, with their place."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), tie))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def bin_means(rows: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """AGG15: equal-width bins over x, closed on the right, the lowest value included;
    midpoints and means of non-empty bins."""
    ends = rows.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((F.col(x) - F.col("_lo")) / F.nullif(width, F.lit(0.0))) - 1))
    binned = rows.crossJoin(F.broadcast(ends)).select(F.coalesce(at, F.lit(0)).cast("int").alias("bin"), (F.col("_lo") + width * (F.coalesce(at, F.lit(0)) + 0.5)).alias("mid"), F.col(y).alias("_y"))
    return binned.groupBy("bin").agg(F.min("mid").alias("mid"), F.avg("_y").alias("mean"), F.count("*").alias("n"))


def histogram(rows: DataFrame, x: str, bins: int = 99, low: float = 0, high: float = 1500) -> DataFrame:
    """AGG16: the last bin is closed; values outside are left out."""
    width = (high - low) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(x) - low) / width))
    return rows.where(F.col(x).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def length_stats(rows: DataFrame, x: str) -> DataFrame:
    """AGG17, AGG14: count, mean and true median."""
    return rows.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"))


def minmax_scale(rows: DataFrame, *columns: str) -> DataFrame:
    """AGG18: each column to [0, 1]; null where all values are equal."""
    ends = F.broadcast(rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]))  # one row
    scaled = {c: ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in columns}
    return rows.crossJoin(ends).select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in rows.columns])


def parallel_coordinates(trials: DataFrame, parameters: list[str], value: str) -> DataFrame:
    """SNK6: the frame behind parallel coordinates: each trial's parameters and value, each
    scaled to [0, 1]."""
    return minmax_scale(trials.select("trial", *parameters, value), *parameters, value)


def uniform_rank(rows: DataFrame, x: str, out: str, pieces: int = 200) -> DataFrame:
    """AGG19: a value's share of smaller ones, ties averaged; null without a value or
    where there is only one row.

    Counts are added up over distinct values, within pieces that approximate quantiles
    part, and over the pieces; the result does not depend on where they are parted.
    """
    n = rows.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("_n"))
    ends = n.agg(F.percentile_approx(x, [i / pieces for i in range(1, pieces)], 10_000).alias("_ends"))
    dealt = n.crossJoin(F.broadcast(ends)).select(x, "_n", F.size(F.filter("_ends", lambda e: e < F.col(x))).alias("_piece"))  # one row
    totals = dealt.groupBy("_piece").agg(F.sum("_n").alias("_t"))
    before = lambda w: F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.broadcast(totals.select("_piece", before(Window.orderBy("_piece")).alias("_ahead"), F.sum("_t").over(Window.partitionBy()).alias("_total")))  # a row for each piece
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_piece").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_below", within).join(ahead, "_piece")
    rank = placed.select(x, ratio(F.col("_ahead") + F.col("_below") + (F.col("_n") - 1) / 2, F.col("_total") - 1).alias(out))
    return rows.join(rank, x, "left")
