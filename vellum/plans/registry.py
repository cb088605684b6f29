"""Queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.windows import token_windows
from vellum.operators import align, anchored, collocate, corpus, correct, metrics, serve, tune
from vellum.plans.derive import EDITS, PAGES, TRIALS, TRIPLES, edits, pages, r6, table, trials, triples, years
from vellum.sources import io, wanted, zipped
from vellum.streaming.resume import answer_once, answers, pair_stream, remaining

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, which any order of summation gives."""
    return df.select(*[r6(c).alias(c) if t == "double" else c for c, t in df.dtypes])


#: Token and word-count fragments of the SQL.
WORDS = lambda c: f"list_filter(string_split_regex({c}, '[ \\n]+'), lambda x: x <> '')"
NORM = lambda c: f"translate(regexp_replace({c}, '-[ \\n]+', '', 'g'), '-.,?!:;', '')"
NORM_LOW = lambda c: f"lower(translate(regexp_replace({c}, '-[ \\n]+', '', 'g'), '-.,?!:;\"', ''))"
ONE_SPACE = lambda c: f"regexp_replace({c}, '[ \\n]+', ' ', 'g')"

#: The edit distance of whole texts takes SQL half a minute; that of words has no SQL, and
#: ``tests/test_library.py`` holds it against brute force.
SCORES = f"""WITH {TRIPLES},
n AS (SELECT doc_id, {ONE_SPACE('reference')} AS r, {ONE_SPACE('corrected')} AS c, {ONE_SPACE('original')} AS o, length(corrected) AS raw_length, length(original) AS input_length FROM triples),
m AS (SELECT doc_id, raw_length, input_length, length(r) AS ref_length, length(c) AS weight, length(o) AS orig_weight, CASE WHEN c = r THEN 0 ELSE levenshtein(c, r) END AS edits, CASE WHEN o = r THEN 0 ELSE levenshtein(o, r) END AS orig_edits FROM n),
s AS (SELECT *, edits::DOUBLE / nullif(ref_length, 0) AS score, orig_edits::DOUBLE / nullif(ref_length, 0) AS orig_score FROM m),
scores AS (SELECT *, CASE WHEN score IS NOT NULL THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN orig_score = 0 THEN 0.0 - score ELSE (orig_score - score) / nullif(orig_score, 0) END)) END AS improvement FROM s)
"""


# Metrics


@query(SCORES + "SELECT doc_id, edits, ref_length, round(score, 6) AS score, orig_edits, round(orig_score, 6) AS orig_score, round(improvement, 6) AS improvement FROM scores")
def cer_doc(spark, d):
    """MET1, MET7."""
    return rounded(metrics.document_scores(triples(spark, d)).select("doc_id", "edits", "ref_length", "score", "orig_edits", "orig_score", "improvement"))


_STATS = """stats AS (SELECT unnest([
  {'metric': 'predicted', 'stat': 'micro', 'value': sum(edits)::DOUBLE / nullif(sum(ref_length), 0)}, {'metric': 'predicted', 'stat': 'mean', 'value': avg(score)},
  {'metric': 'predicted', 'stat': 'median', 'value': median(score)}, {'metric': 'predicted', 'stat': 'weighted average', 'value': sum(score * weight) / sum(weight) FILTER (score IS NOT NULL)},
  {'metric': 'original', 'stat': 'micro', 'value': sum(orig_edits)::DOUBLE / nullif(sum(ref_length), 0)}, {'metric': 'original', 'stat': 'mean', 'value': avg(orig_score)},
  {'metric': 'original', 'stat': 'median', 'value': median(orig_score)}, {'metric': 'original', 'stat': 'weighted average', 'value': sum(orig_score * orig_weight) / sum(orig_weight) FILTER (orig_score IS NOT NULL)},
  {'metric': 'improvement', 'stat': 'mean', 'value': avg(improvement)}, {'metric': 'improvement', 'stat': 'median', 'value': median(improvement)},
  {'metric': 'improvement', 'stat': 'weighted average', 'value': sum(improvement * weight) / sum(weight) FILTER (improvement IS NOT NULL)}]) AS r FROM scores)"""


@query(f"{SCORES}, {_STATS} SELECT r.metric, r.stat, round(r.value, 6) AS value FROM stats")
def cer_summary(spark, d):
    """MET4-6, MET8, MET14, MET15."""
    return rounded(metrics.evaluate(triples(spark, d), "cer").drop("score"))


@query()
def wer_summary(spark, d):
    """MET2."""
    return rounded(metrics.evaluate(triples(spark, d), "wer").drop("score"))


@query(SCORES + "SELECT doc_id, round(orig_score, 6) AS orig_score, CASE WHEN orig_score < 0.02 THEN 'kept' ELSE 'listed' END AS part FROM scores WHERE orig_score <> 0.02")
def outliers(spark, d):
    """FLT4."""
    return rounded(metrics.outliers(metrics.document_scores(triples(spark, d)), 0.02).select("doc_id", "orig_score", "part"))


@query(SCORES + "SELECT count(*) FILTER (score < orig_score) AS improved, count(*) AS total FROM scores")
def improved_counts(spark, d):
    """FLT5."""
    return metrics.improved_counts(metrics.document_scores(triples(spark, d)))


@query(SCORES + """SELECT round(sum(score * raw_length) / sum(raw_length) FILTER (score IS NOT NULL), 6) AS corrected,
round(sum(improvement * input_length) / sum(input_length) FILTER (improvement IS NOT NULL), 6) AS objective,
round(avg(CASE WHEN orig_score > 0 THEN 100 * greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (orig_score - score) / orig_score)) END), 6) AS percent FROM scores""")
def eval_books(spark, d):
    """MET9-12: book rows summed up with raw lengths as weights."""
    s = metrics.document_scores(triples(spark, d))
    percent = 100 * metrics.improvement(F.col("orig_score"), F.col("score"), guard=False)
    return rounded(s.agg(metrics.weighted(F.col("score"), F.col("raw_length")).alias("corrected"), metrics.weighted(F.col("improvement"), F.col("input_length")).alias("objective"), F.avg(percent).alias("percent")))


@query()
def character_doc(spark, d):
    """MET3: half of the corrected texts have their first thirty words at the end."""
    words = F.split(F.trim("corrected"), r"\s+")
    turned = tx.once(words, lambda w: F.array_join(F.concat(F.slice(w, 31, F.size(w)), F.slice(w, 1, 30)), " "))
    t = triples(spark, d).withColumn("turned", F.when(F.col("doc_id") % 2 == 1, turned).otherwise(F.col("corrected")))
    return rounded(metrics.character_scores(t, "turned"))


_BAG = lambda v: f"""{v}_t AS (SELECT doc_id, unnest({WORDS(v)}) AS token FROM triples), {v}_c AS (SELECT doc_id, token, count(*) AS n FROM {v}_t GROUP BY ALL)"""
_BOW = lambda v: f"""{v}_b AS (SELECT coalesce(p.doc_id, r.doc_id) AS doc_id, coalesce(p.n, 0) AS p, coalesce(r.n, 0) AS r FROM {v}_c p FULL JOIN reference_c r ON p.doc_id = r.doc_id AND p.token = r.token),
{v}_s AS (SELECT t.doc_id, coalesce(sum(least(p, r)), 0)::BIGINT AS tp, coalesce(sum(greatest(p - r, 0)), 0)::BIGINT AS fp, coalesce(sum(greatest(r - p, 0)), 0)::BIGINT AS fn FROM triples t LEFT JOIN {v}_b b ON t.doc_id = b.doc_id GROUP BY 1),
{v}_f AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END::DOUBLE AS f1 FROM {v}_s)"""  # noqa: E731


@query(f"WITH {TRIPLES}, {_BAG('corrected')}, {_BAG('reference')}, {_BOW('corrected')} SELECT doc_id, tp, fp, fn, round(f1, 6) AS f1 FROM corrected_f")
def bow_f1_doc(spark, d):
    """MET16, SET6."""
    return rounded(metrics.bag_counts(triples(spark, d), "corrected", "reference"))


@query(f"WITH {TRIPLES}, {_BAG('corrected')}, {_BAG('original')}, {_BAG('reference')}, {_BOW('corrected')}, {_BOW('original')} SELECT 'original' AS variant, round(avg(f1), 6) AS f1 FROM original_f UNION ALL SELECT 'corrected', round(avg(f1), 6) FROM corrected_f")
def bow_f1_macro(spark, d):
    """MET17."""
    return rounded(metrics.bag_macro(triples(spark, d)))


@query(f"""WITH {TRIPLES}, s AS (SELECT unnest({WORDS('original')}) AS a FROM triples), e AS (SELECT unnest({WORDS('corrected')}) AS a FROM triples),
b AS (SELECT sum(length(a))::BIGINT AS before FROM s), c AS (SELECT sum(length(a))::BIGINT AS after FROM e) SELECT before, after, round(100 * (after - before)::DOUBLE / before, 6) AS change_pct FROM b, c""")
def nonspace_change_pct(spark, d):
    """MET19, TXT11, TXT16."""
    rows = triples(spark, d).select(tx.word_segments(F.col("original"), 50).alias("a"), tx.word_segments(F.col("corrected"), 50).alias("b"))
    return rounded(metrics.volume_change(rows, "a", "b"))


@query(f"WITH {TRIPLES}, {_BAG('corrected')}, {_BAG('reference')}, {_BOW('corrected')} SELECT doc_id, round(f1, 6) AS f1 FROM corrected_f SEMI JOIN labels USING (doc_id)")
def scores_in_order(spark, d):
    """JOIN8: scores of the labelled documents."""
    books = table(spark, d, "labels").select("doc_id").distinct().withColumn("row_id", F.col("doc_id"))
    return rounded(metrics.scores_in_order(books, metrics.bag_counts(triples(spark, d), "corrected", "reference").select("doc_id", "f1"), "doc_id").drop("row_id"))


@query(f"WITH {TRIPLES}, {_BAG('corrected')}, {_BAG('original')}, {_BAG('reference')}, {_BOW('corrected')}, {_BOW('original')} SELECT doc_id, round(o.f1, 6) AS original_f1, round(c.f1, 6) AS corrected_f1 FROM original_f o JOIN corrected_f c USING (doc_id)")
def scores_merged(spark, d):
    """JOIN13."""
    one = lambda c: metrics.bag_counts(triples(spark, d), c, "reference").select("doc_id", F.col("f1").alias(f"{c}_f1"))
    return rounded(metrics.merge_scores(one("original"), one("corrected"), "doc_id"))


@query(f"WITH {TRIALS}, p AS (SELECT row_number() OVER (PARTITION BY model ORDER BY row_id) - 1 AS row_id, model, original, predicted FROM trials) SELECT a.row_id, a.original, b.predicted AS low, c.predicted AS high FROM p a JOIN p b ON a.row_id = b.row_id JOIN p c ON a.row_id = c.row_id WHERE a.model = 0 AND b.model = 1 AND c.model = 2")
def improvements_by_position(spark, d):
    """JOIN14: two models' scores beside the original rows of the same position."""
    t = trials(spark, d)
    place = F.row_number().over(Window.partitionBy("model").orderBy("row_id")) - 1
    placed = t.withColumn("row_id", place.cast("long"))
    own = lambda m: placed.where(F.col("model") == m)
    return metrics.by_position(own(0).select("row_id", "original"), {"low": own(1), "high": own(2)}, "predicted")


# Vocabularies


@query(f"WITH {TRIPLES}, w AS (SELECT unnest({WORDS(NORM('reference'))}) AS word FROM triples) SELECT word, count(*) AS n FROM w GROUP BY 1")
def word_freq(spark, d):
    """AGG1, TXT2, TXT12."""
    return corpus.word_freq(triples(spark, d), "reference")


_VOCAB = f"""WITH {TRIPLES}, t AS (SELECT unnest({WORDS(NORM('original'))}) AS word, 'o' AS k FROM triples UNION ALL SELECT unnest({WORDS(NORM('corrected'))}), 'c' FROM triples UNION ALL SELECT unnest({WORDS(NORM('reference'))}), 'r' FROM triples),
v AS (SELECT word, count(*) FILTER (k = 'o') AS original, count(*) FILTER (k = 'c') AS corrected, count(*) FILTER (k = 'r') AS reference FROM t GROUP BY 1) """


@query(_VOCAB + "SELECT count(*) FILTER (original > 0) AS original, count(*) FILTER (corrected > 0) AS corrected, count(*) FILTER (reference > 0) AS reference FROM v")
def vocab_size(spark, d):
    """AGG2, SET2."""
    v = corpus.vocabulary(triples(spark, d))
    return v.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in ("original", "corrected", "reference")])


@query(_VOCAB + """SELECT 'removed' AS change, count(*) AS words, round(100.0 * count(*) FILTER (original = 1) / count(*), 6) AS singleton_pct, round(100.0 * count(*) FILTER (reference = 0) / count(*), 6) AS unknown_pct FROM v WHERE original > 0 AND corrected = 0
UNION ALL SELECT 'new', count(*), round(100.0 * count(*) FILTER (corrected = 1) / count(*), 6), round(100.0 * count(*) FILTER (reference = 0) / count(*), 6) FROM v WHERE corrected > 0 AND original = 0""")
def vocab_changes(spark, d):
    """AGG3, SET1."""
    return rounded(corpus.vocabulary_changes(corpus.vocabulary(triples(spark, d))))


@query(_VOCAB + "(SELECT word, corrected - original AS diff, reference FROM v ORDER BY 2 DESC, word LIMIT 10) UNION ALL (SELECT word, corrected - original, reference FROM v ORDER BY 2, word LIMIT 10)")
def freq_diff_top(spark, d):
    """AGG4, JOIN9, JOIN10, TOP2."""
    rows = corpus.vocabulary(triples(spark, d)).select("word", (F.col("corrected") - F.col("original")).alias("diff"), "reference")
    return corpus.top(rows, 10, "diff", "word").unionByName(corpus.top(rows, 10, "diff", "word", ascending=True))


@query(_VOCAB + "SELECT word, original, reference FROM v WHERE original > 0 AND corrected = 0 ORDER BY original DESC, word LIMIT 20")
def removed_top(spark, d):
    """TOP1."""
    rows = corpus.vocabulary(triples(spark, d)).where("original > 0 AND corrected = 0").select("word", "original", "reference")
    return corpus.top(rows, 20, "original", "word")


@query(f"WITH {TRIPLES}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(reference), '\\b\\w\\w+\\b')) AS word FROM triples) SELECT word, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM triples)) / (1 + count(*))) + 1, 6) AS idf FROM w GROUP BY 1")
def idf(spark, d):
    """AGG20."""
    return rounded(corpus.idf(triples(spark, d), "reference"))


@query(f"WITH {TRIPLES}, a AS (SELECT unnest({WORDS(NORM('lower(reference)'))}) AS word FROM triples), k AS (SELECT word, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, word LIMIT 300), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(reference), '\\b\\w\\w+\\b')) AS word FROM triples), i AS (SELECT word, count(*) AS df, ln((1.0 + (SELECT count(*) FROM triples)) / (1 + count(*))) + 1 AS idf FROM w GROUP BY 1) SELECT word, n, df, round(idf, 6) AS idf FROM k JOIN i USING (word) WHERE idf BETWEEN 2 AND 5")
def idf_band(spark, d):
    """FLT13."""
    return rounded(corpus.idf_band(triples(spark, d), "reference"))


@query(_VOCAB + """SELECT 'original' AS variant, count(*) FILTER (original > 0) AS words, true AS close FROM v UNION ALL SELECT 'corrected', count(*) FILTER (corrected > 0), true FROM v UNION ALL SELECT 'reference', count(*) FILTER (reference > 0), true FROM v""")
def vocab_sketches(spark, d):
    """AGG1, AGG2: exact sizes, and whether those out of merged sketches of 16 groups of
    documents are within four standard errors of them."""
    t = triples(spark, d).withColumn("part", F.pmod("doc_id", F.lit(16)))
    v = corpus.vocabulary(t)
    sizes = v.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in ("original", "corrected", "reference")])
    exact = sizes.unpivot([], ["original", "corrected", "reference"], "variant", "exact")
    merged = corpus.merged_vocabulary(corpus.vocabulary_sketches(t, "part"))
    close = F.abs(F.col("words") - F.col("exact")) <= 4 * 1.04 / 64 * F.col("exact")
    return exact.join(merged, "variant").select("variant", F.col("exact").alias("words"), close.alias("close"))


# Pages and books


@query(f"WITH {PAGES}, k AS (SELECT book_id FROM pages_ GROUP BY 1 HAVING count(*) = max(page)) SELECT book_id, string_agg(input, chr(10) || chr(10) ORDER BY page) FILTER (lower(trim(input)) <> 'blank') AS input, coalesce(string_agg(output, chr(10) || chr(10) ORDER BY page) FILTER (lower(trim(output)) <> 'blank'), '') AS output FROM pages_ SEMI JOIN k USING (book_id) GROUP BY 1")
def books_from_pages(spark, d):
    """FLT1, FLT2, AGG12, TXT15, TOP6."""
    return corpus.join_pages(pages(spark, d))


@query(f"WITH {PAGES} SELECT book_id, count(*) AS pages, max(page) AS last FROM pages_ GROUP BY 1 HAVING count(*) = max(page)")
def pages_complete(spark, d):
    """FLT2."""
    return corpus.complete_books(pages(spark, d))


@query(f"WITH {PAGES}, t AS (SELECT * FROM pages_ UNION ALL SELECT * FROM pages_ WHERE page % 5 = 0) SELECT book_id, page, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) > 1")
def pages_duplicates(spark, d):
    """FLT3, SET7."""
    p = pages(spark, d)
    return corpus.duplicate_pages(p.unionByName(p.where("page % 5 = 0")))


@query(f"WITH {TRIPLES}, {PAGES}, k AS (SELECT book_id FROM pages_ GROUP BY 1 HAVING count(*) = max(page)), b AS (SELECT book_id, coalesce(string_agg(output, chr(10) || chr(10) ORDER BY page) FILTER (lower(trim(output)) <> 'blank'), '') AS reference FROM pages_ SEMI JOIN k USING (book_id) GROUP BY 1) SELECT book_id, original, corrected, b.reference FROM b JOIN triples ON book_id = doc_id::VARCHAR")
def triple_join(spark, d):
    """JOIN2, JOIN3, SET3."""
    ocr = triples(spark, d).select(F.col("doc_id").cast("string").alias("book_id"), F.array("original").alias("original"), F.array("corrected").alias("corrected"), F.array("corrected").alias("corrected_pp"))
    return corpus.join_books(corpus.join_pages(pages(spark, d)), ocr).select("book_id", "original", "corrected", "reference")


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def semi_filter(spark, d):
    """FLT12, JOIN3."""
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def anti_resume(spark, d):
    """JOIN6, LM11."""
    return remaining(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT page_id, replace(string_split(url, '/')[-1], '.txt', '') AS book_id FROM pages")
def url_book_id(spark, d):
    """TXT14."""
    return table(spark, d, "pages").select("page_id", tx.url_id(F.col("url")).alias("book_id"))


# Years


@query("SELECT year(o_orderdate) AS year, count(*) AS books FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY 1")
def year_hist(spark, d):
    """AGG10, FLT6."""
    return corpus.year_hist(years(spark, d), 1996, 2000)


@query("SELECT min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last, round(avg(year(o_orderdate)), 6) AS mean, count(*) AS books FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000")
def year_stats(spark, d):
    """AGG9."""
    return rounded(corpus.year_stats(years(spark, d), 1996, 2000))


@query("WITH y AS (SELECT year(o_orderdate) AS year FROM orders), e AS (SELECT min(year) AS lo, max(year) AS hi FROM y) SELECT least(year - lo, greatest(hi - lo - 1, 0))::INT AS bin, count(*) AS books FROM y, e GROUP BY 1")
def year_bins(spark, d):
    """AGG10."""
    return corpus.year_bins(years(spark, d))


@query(f"WITH {TRIPLES}, y AS (SELECT o_orderkey AS doc_id, year(o_orderdate) AS year FROM orders), c AS (SELECT doc_id, len(regexp_extract_all(lower(original), '\\bthe\\b')) AS b, len(regexp_extract_all(lower(corrected), '\\bthe\\b')) AS a FROM triples) SELECT year, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after FROM c JOIN y USING (doc_id) GROUP BY 1 HAVING sum(a) + sum(b) > 0")
def term_by_year(spark, d):
    """AGG11, JOIN4, TXT13."""
    return corpus.term_by_year(triples(spark, d), years(spark, d), "the")


# Collocations


_TOKENS = lambda v: f"""{v}_w AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {WORDS(NORM_LOW(v))} AS t FROM triples)),
{v}_u AS (SELECT w, count(*) AS n FROM {v}_w GROUP BY 1),
{v}_p AS (SELECT a.w AS w1, b.w AS w2, count(*) AS n FROM {v}_w a JOIN {v}_w b ON a.doc_id = b.doc_id AND b.i IN (a.i - 2, a.i - 1, a.i + 1, a.i + 2) GROUP BY 1, 2),
{v}_m AS (SELECT w1, w2, log2(p.n::DOUBLE * p.n / (x.n::DOUBLE * y.n / (SELECT sum(n) FROM {v}_u))) AS mi2, p.n AS f12, x.n AS f1, y.n AS f2 FROM {v}_p p JOIN {v}_u x ON x.w = w1 JOIN {v}_u y ON y.w = w2 WHERE w1 <= w2 AND p.n >= 4 AND x.n >= 4 AND y.n >= 4)"""  # noqa: E731


@query(f"WITH {TRIPLES}, {_TOKENS('reference')} SELECT w1, w2, n FROM reference_p")
def cooc_counts(spark, d):
    """COL1, JOIN11, WIN1."""
    return collocate.neighbour_counts(collocate.token_arrays(triples(spark, d), "reference"))


@query(f"WITH {TRIPLES}, {_TOKENS('reference')} SELECT w1, w2, round(mi2, 6) AS mi2, f12, f1, f2 FROM reference_m")
def mi2_all(spark, d):
    """COL2, COL3, JOIN12, FLT7."""
    return rounded(collocate.collocations(triples(spark, d), "reference"))


_REGIONS = f"WITH {TRIPLES}, {_TOKENS('reference')}, {_TOKENS('original')}, {_TOKENS('corrected')}, " + ", ".join(f"{v}_s AS (SELECT w1, w2, mi2 FROM {v}_m WHERE mi2 >= 3 AND w1 <> w2)" for v in ("reference", "original", "corrected"))


@query(_REGIONS + """, j AS (SELECT coalesce(g.w1, o.w1, c.w1) AS w1, coalesce(g.w2, o.w2, c.w2) AS w2, g.mi2 AS g, o.mi2 AS o, c.mi2 AS c FROM reference_s g FULL JOIN original_s o ON g.w1 = o.w1 AND g.w2 = o.w2 FULL JOIN corrected_s c ON coalesce(g.w1, o.w1) = c.w1 AND coalesce(g.w2, o.w2) = c.w2)
SELECT w1, w2, (CASE WHEN g IS NULL THEN '' ELSE 'G' END) || (CASE WHEN o IS NULL THEN '' ELSE 'O' END) || (CASE WHEN c IS NULL THEN '' ELSE 'C' END) AS region, round(coalesce(g, o, c), 6) AS mi2 FROM j""")
def colloc_regions(spark, d):
    """COL5-7, SET4, SET5, FLT9, FLT10."""
    columns = ["reference", "original", "corrected"]
    return rounded(collocate.significant_by(collocate.collocations_by(triples(spark, d), columns), columns))


@query(_REGIONS + """, j AS (SELECT coalesce(g.w1, o.w1, c.w1) AS w1, g.mi2 AS g, o.mi2 AS o, c.mi2 AS c FROM reference_s g FULL JOIN original_s o ON g.w1 = o.w1 AND g.w2 = o.w2 FULL JOIN corrected_s c ON coalesce(g.w1, o.w1) = c.w1 AND coalesce(g.w2, o.w2) = c.w2)
SELECT (CASE WHEN g IS NULL THEN '' ELSE 'G' END) || (CASE WHEN o IS NULL THEN '' ELSE 'O' END) || (CASE WHEN c IS NULL THEN '' ELSE 'C' END) AS region, count(*) AS pairs FROM j GROUP BY 1""")
def colloc_venn(spark, d):
    """SNK6, COL7."""
    columns = ["reference", "original", "corrected"]
    return collocate.venn(collocate.significant_by(collocate.collocations_by(triples(spark, d), columns), columns))


@query(_REGIONS + """, b AS (SELECT count(*) AS n FROM original_s JOIN reference_s USING (w1, w2)), p AS (SELECT (SELECT n FROM b)::DOUBLE / (SELECT count(*) FROM original_s) AS precision, (SELECT n FROM b)::DOUBLE / (SELECT count(*) FROM reference_s) AS recall)
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM p""")
def colloc_pr(spark, d):
    """MET18."""
    both = ["reference", "original"]
    found = collocate.significant_by(collocate.collocations_by(triples(spark, d), both), both)
    return rounded(metrics.set_scores(found.where("region LIKE '%O%'"), found.where("region LIKE 'G%'"), ["w1", "w2"]))


@query(f"WITH {TRIPLES}, {_TOKENS('reference')} SELECT count(*) AS pairs, count(*) FILTER (mi2 >= 3) AS significant FROM reference_m")
def colloc_report(spark, d):
    """COL4."""
    return collocate.report(collocate.collocations(triples(spark, d), "reference"))


@query(f"WITH {TRIPLES}, {_TOKENS('reference')} SELECT w1, w2, round(mi2, 6) AS mi2, f12, f1, f2 FROM reference_m ORDER BY round(mi2, 6) DESC, w1, w2 LIMIT 100")
def colloc_top(spark, d):
    """COL4, TOP3."""
    return collocate.ranked(rounded(collocate.collocations(triples(spark, d), "reference")), 100)


_PICKED = ("the", "of", "under")


@query(f"WITH {TRIPLES}, {_TOKENS('reference')}, k AS (SELECT * FROM reference_m WHERE w1 IN {_PICKED} OR w2 IN {_PICKED}) SELECT CASE WHEN w1 IN {_PICKED} THEN w1 ELSE w2 END AS w1, CASE WHEN w1 IN {_PICKED} THEN w2 ELSE w1 END AS w2, round(mi2, 6) AS mi2, f12, CASE WHEN w1 IN {_PICKED} THEN f1 ELSE f2 END AS f1, CASE WHEN w1 IN {_PICKED} THEN f2 ELSE f1 END AS f2 FROM k")
def colloc_selected(spark, d):
    """FLT8."""
    return rounded(collocate.collocations(triples(spark, d), "reference", selected=_PICKED))


# Text and segments


@query(f"WITH {TRIPLES} SELECT doc_id, replace(replace(replace(original, chr(10), ''), ' ', ''), '-', '') AS compact, length(original) - length(replace(replace(replace(original, chr(10), ''), ' ', ''), '-', '')) AS removed FROM triples")
def compact_text(spark, d):
    """TXT7, TXT9."""
    f = tx.suppress_format(F.col("original"))
    return triples(spark, d).select("doc_id", f["text"].alias("compact"), f["removed"].alias("removed"))


@query(f"WITH {TRIPLES}, w AS (SELECT doc_id, {WORDS('reference')} AS w FROM triples), s AS (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // 300)) AS seg FROM w WHERE len(w) > 0) SELECT doc_id, seg, array_to_string(w[seg * 300 + 1 : seg * 300 + 300], ' ') AS segment FROM s")
def segment_words(spark, d):
    """TXT16."""
    return triples(spark, d).select("doc_id", F.posexplode(tx.word_segments(F.col("reference"))).alias("seg", "segment")).withColumn("seg", F.col("seg").cast("long"))


@query()
def overlap_windows(spark, d):
    """TXT17."""
    return triples(spark, d).select("doc_id", F.posexplode(tx.overlap_windows(F.col("reference"), 100, 0.2)).alias("slice", "text"))


@query()
def token_slices(spark, d):
    """TXT17 by a subword tokenizer."""
    import public_tokenizers

    found = token_windows(F.col("reference"), public_tokenizers.path("word_bpe_49k.json"), 300, 0.2)
    return triples(spark, d).select("doc_id", F.posexplode(found).alias("slice", "w")).select("doc_id", "slice", "w.*")


#: Words of a segment, the operators' own size.
SEGMENT = 300


def _segments(spark, d, n=SEGMENT):
    pieces = F.arrays_zip(tx.word_segments(F.col("original"), n).alias("a"), tx.word_segments(F.col("corrected"), n).alias("b"))
    rows = triples(spark, d).select("doc_id", F.posexplode(pieces).alias("seg", "p"))
    # one file may hold all texts; the kernels that follow cost far more than this shuffle
    spread = rows.repartition(max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id", "seg")
    return spread.select("doc_id", "seg", F.coalesce("p.a", F.lit("")).alias("a"), F.coalesce("p.b", F.lit("")).alias("b"))


@query(f"""WITH {TRIPLES}, w AS (SELECT doc_id, {WORDS('original')} AS o, {WORDS('corrected')} AS c FROM triples), s AS (SELECT doc_id, o, c, unnest(generate_series(0, (greatest(len(o), len(c)) - 1) // {SEGMENT})) AS seg FROM w WHERE greatest(len(o), len(c)) > 0),
t AS (SELECT doc_id, seg, length(replace(array_to_string(o[seg * {SEGMENT} + 1 : seg * {SEGMENT} + {SEGMENT}], ''), '-', '')) AS a, length(replace(array_to_string(c[seg * {SEGMENT} + 1 : seg * {SEGMENT} + {SEGMENT}], ''), '-', '')) AS b FROM s)
SELECT doc_id, seg::INT AS seg, coalesce(sum(a) OVER q, 0)::INT AS a_before, coalesce(sum(b) OVER q, 0)::INT AS b_before FROM t WINDOW q AS (PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def segment_offsets(spark, d):
    """WIN2."""
    return align.segment_offsets(_segments(spark, d)).select("doc_id", "seg", "a_before", "b_before")


# Edit strings


@query(f"WITH {EDITS} SELECT doc_id, ops FROM edits")
def match_string(spark, d):
    """ALN5."""
    return edits(spark, d).select("doc_id", "ops")


@query(f"WITH {EDITS}, o AS (SELECT unnest(string_split(ops, '')) AS op FROM edits), n AS (SELECT op, count(*) AS n FROM o WHERE op <> '' GROUP BY 1) SELECT op, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM n")
def op_counts(spark, d):
    """AGG5, WIN7."""
    return rounded(corpus.op_counts(edits(spark, d)))


_RUNS = f"""WITH {EDITS}, c AS (SELECT doc_id, length(ops) AS len, unnest(string_split(ops, '')) AS op, unnest(string_split(original, '')) AS a, unnest(string_split(corrected, '')) AS b, generate_subscripts(string_split(ops, ''), 1) - 1 AS pos FROM edits WHERE ops <> ''),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM c WHERE op <> '|'),
runs AS (SELECT doc_id, min(pos)::INT AS start, count(*)::INT AS length, replace(string_agg(a, '' ORDER BY pos), ' ', '∅') || ' -> ' || replace(string_agg(b, '' ORDER BY pos), ' ', '∅') AS change FROM g GROUP BY doc_id, i, len HAVING max(pos) + 1 < len) """


@query(_RUNS + "SELECT * FROM runs")
def change_runs(spark, d):
    """AGG6, WIN5, TXT26."""
    return corpus.change_runs(edits(spark, d))


@query(_RUNS + ", n AS (SELECT length, count(*) AS n FROM runs GROUP BY 1) SELECT length, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM n")
def change_lengths(spark, d):
    """AGG7."""
    return rounded(corpus.change_lengths(corpus.change_runs(edits(spark, d))))


@query(_RUNS + "SELECT count(*) AS changes, count(*) FILTER (length > 5) AS over_5, count(*) FILTER (length > 10) AS over_10 FROM runs")
def long_changes(spark, d):
    """AGG7."""
    return corpus.long_changes(corpus.change_runs(edits(spark, d)))


@query(_RUNS + ", n AS (SELECT change, length < 5 AS s, count(*) AS n FROM runs GROUP BY 1, 2), t AS (SELECT *, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM n) SELECT change, n, pct FROM t WHERE s")
def change_types(spark, d):
    """AGG8."""
    return rounded(corpus.change_types(corpus.change_runs(edits(spark, d))))


@query(f"""WITH {EDITS}, o AS (SELECT doc_id, unnest(string_split(ops, '')) = '|' AS hit, generate_subscripts(string_split(ops, ''), 1) - 1 AS pos FROM edits WHERE ops <> ''),
s AS (SELECT doc_id, pos, greatest(CASE WHEN pos >= 10 THEN sum(hit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) ELSE 0 END, sum(hit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) >= 8 AS good FROM o),
g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM s WHERE good), r AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM g GROUP BY doc_id, i),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a - b, a) AS n FROM r) SELECT e.doc_id, coalesce(a, -1)::INT AS "start", coalesce(b, -1)::INT AS "end" FROM edits e LEFT JOIN k ON e.doc_id = k.doc_id AND n = 1""")
def density_runs(spark, d):
    """ALN18, ALN19, WIN4."""
    return align.dense_runs(edits(spark, d))


#: Spans of 20 characters in every 25, of which b's begin two characters before a's.
_SPANS = "get(transform(array(length(original)), n -> filter(transform(sequence(0, n div 25), k -> named_struct('a_start', 25 * k + 2, 'a_end', least(25 * k + 22, n), 'b_start', 25 * k, 'b_end', least(25 * k + 20, n - 2))), s -> s.a_end > s.a_start)), 0)"
_SHIFTED = f"""WITH {EDITS}, c AS (SELECT doc_id, unnest(string_split(original, '')) AS x, unnest(string_split(corrected, '')) AS y, generate_subscripts(string_split(original, ''), 1) - 1 AS pos FROM edits WHERE original <> ''),
h AS (SELECT doc_id, pos, y, lead(x, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS x FROM c), cells AS (SELECT doc_id, pos, x = y AS hit, pos % 25 < 20 AND x IS NOT NULL AS aligned FROM h)"""


def _shifted(spark, d):
    spans = F.expr(_SPANS).cast(f"array<{align.SPAN.removeprefix('array')}>")
    return edits(spark, d).select("doc_id", F.col("original").alias("a"), F.col("corrected").alias("b"), spans.alias("spans"))


@query(_SHIFTED + ", m AS (SELECT doc_id, string_agg(CASE WHEN aligned AND hit THEN '1' ELSE '0' END, '' ORDER BY pos) AS mask FROM cells GROUP BY 1) SELECT e.doc_id, coalesce(mask, '') AS mask FROM edits e LEFT JOIN m USING (doc_id)")
def match_masks(spark, d):
    """ALN12, SNK7: which characters of a text are aligned to equal ones."""
    mask = F.transform(align.match_mask(F.col("b"), F.col("spans"), F.col("a")), lambda x: F.when(x, "1").otherwise("0"))
    return _shifted(spark, d).select("doc_id", F.array_join(mask, "").alias("mask"))


@query(_SHIFTED + " SELECT doc_id, count(*) AS cells, sum(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS value, sum((pos + 2) * CASE WHEN hit THEN 2 ELSE 1 END)::BIGINT AS rows_, sum(pos * CASE WHEN hit THEN 2 ELSE 1 END)::BIGINT AS columns_ FROM cells WHERE aligned GROUP BY 1")
def matrix_cells(spark, d):
    """ALN13: the sparse alignment matrix, summed up by document."""
    weight = (2 * F.col("v")).cast("long")
    found = align.alignment_cells(_shifted(spark, d))
    return found.groupBy("doc_id").agg(F.count("*").alias("cells"), F.sum("v").alias("value"), F.sum(F.col("i") * weight).alias("rows_"), F.sum(F.col("j") * weight).alias("columns_"))


@query(f"""WITH {TRIPLES}, c AS (SELECT doc_id, unnest(string_split(original, '')) AS x, generate_subscripts(string_split(original, ''), 1) - 1 AS pos FROM triples WHERE original <> ''),
w AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM c WHERE x NOT IN (' ', chr(10), '-')),
r AS (SELECT doc_id, min(pos) FILTER (i = n // 4)::INT AS a, min(pos + 1) FILTER (i = n - n // 5 - 1)::INT AS b FROM w GROUP BY 1) SELECT doc_id, a AS "start", b AS "end" FROM triples LEFT JOIN r USING (doc_id)""")
def raw_extents(spark, d):
    """ALN15, ALN20: the aligned extent of a compact text as places in the raw one."""
    n = F.length(tx.compact(F.col("original")))
    end = lambda k: F.floor(n / k).cast("int")
    span = F.struct(*[x.alias(c) for c, x in (("a_start", end(4)), ("a_end", n - end(5)), ("b_start", end(4)), ("b_end", n - end(5)))])
    spans = F.when(n > 0, F.array(span)).otherwise(F.array().cast(f"array<{align.SPAN.removeprefix('array')}>"))
    found = align.project_extent(tx.suppress_format(F.col("original")), spans)
    return triples(spark, d).select("doc_id", found.alias("e")).select("doc_id", "e.*")


@query(f"""WITH {EDITS}, t AS (SELECT doc_id, original AS a, translate(original, 'sw', 'fv') AS b, length(original) AS n FROM edits), k AS (SELECT *, unnest(generate_series(0, n // 25)) AS k FROM t),
p AS (SELECT doc_id, k, CASE WHEN k = 0 THEN 0 ELSE 25 * k - 3 END AS before, 25 * k + 2 AS s, least(25 * k + 22, n) AS e, a, b FROM k WHERE n > 25 * k + 2),
q AS (SELECT doc_id, k, s - before AS gap, substr(a, before + 1, s - before) AS x, substr(b, before + 1, s - before) AS y, substr(a, s + 1, e - s) AS p, substr(b, s + 1, e - s) AS q, e FROM p),
m AS (SELECT doc_id, max(e) AS e, string_agg(x || repeat(' ', gap) || p, '' ORDER BY k) AS a, string_agg(repeat(' ', gap) || y || q, '' ORDER BY k) AS b, string_agg(repeat('+', gap) || repeat('-', gap) || regexp_replace(regexp_replace(p, '[^sw]', '|', 'g'), '[sw]', '.', 'g'), '' ORDER BY k) AS ops FROM q GROUP BY 1)
SELECT doc_id, coalesce(m.a, '') || substr(t.a, coalesce(e, 0) + 1) || repeat(' ', n - coalesce(e, 0)) AS a, coalesce(m.b, '') || repeat(' ', n - coalesce(e, 0)) || substr(t.b, coalesce(e, 0) + 1) AS b, coalesce(m.ops, '') || repeat('+', n - coalesce(e, 0)) || repeat('-', n - coalesce(e, 0)) AS ops FROM t LEFT JOIN m USING (doc_id)""")
def edit_documents(spark, d):
    """ALN6-8 out of given spans, told from the reference's side."""
    spans = F.expr(_SPANS.replace("25 * k, 'b_end', least(25 * k + 20, n - 2)", "25 * k + 2, 'b_end', least(25 * k + 22, n)"))
    rows = edits(spark, d).select("doc_id", F.col("original").alias("a"), F.translate("original", "sw", "fv").alias("b"), spans.cast(f"array<{align.SPAN.removeprefix('array')}>").alias("spans"))
    return align.edit_documents(rows, "reference")


@query()
def anchored_align(spark, d):
    """ALN10: 300-word segments against the whole other text, re-anchored."""
    books = triples(spark, d).select("doc_id", tx.word_segments(F.col("original"), SEGMENT).alias("segments"), F.col("corrected").alias("text"))
    return anchored.align_anchored(books).select("doc_id", "seg", "span.*")


@query(f"""WITH {TRIPLES}, {EDITS}, e AS (SELECT doc_id, ops FROM edits ANTI JOIN labels USING (doc_id) WHERE doc_id % 97 <> 0) SELECT doc_id::VARCHAR AS url, length(original) AS size, ops FROM triples JOIN e USING (doc_id)""")
def aligned_books(spark, d):
    """JOIN5-7, FLT11: books with their alignment, without metadata rows and those done."""
    url = F.when(F.col("doc_id") % 97 == 0, "./all_files.txt").otherwise(F.col("doc_id").cast("string"))
    books = triples(spark, d).select(url.alias("url"), F.length("original").alias("size"))
    found = edits(spark, d).select(F.col("doc_id").cast("string").alias("url"), "ops")
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("url"))
    return corpus.pair_alignments(books, found, done)


# Trials


_GAIN = f"WITH {TRIALS}, t AS (SELECT *, greatest(-1.0, least(1.0, CASE WHEN original = 0 THEN -predicted ELSE (original - predicted) / original END)) AS gain, row_id // 200 AS chunk FROM trials), k AS (SELECT model, chunk::BIGINT AS chunk, count(*) AS n, round(sum(gain * weight) / sum(weight), 6) AS improvement FROM t GROUP BY ALL HAVING count(*) = 200) "


@query(_GAIN + "SELECT * FROM k")
def trial_improvement(spark, d):
    """AGG13, MET11, WIN6."""
    return rounded(corpus.trial_chunks(trials(spark, d)))


@query(_GAIN + ", p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY improvement DESC, chunk) AS place FROM k) SELECT model, chunk, improvement, place::INT AS place FROM p WHERE place <= 10")
def trial_top10_per_model(spark, d):
    """TOP4, TOP5, SET7."""
    return corpus.top_per_group(trial_improvement(spark, d), "model", "improvement", "chunk").drop("n")


@query("WITH t AS (SELECT value FROM events) SELECT count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM t")
def param_median(spark, d):
    """AGG14, AGG17."""
    return rounded(corpus.length_stats(table(spark, d, "events"), "value"))


@query("""WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents), b AS (SELECT greatest(0, least(9, ceil((n_chars - lo) / ((hi - lo) / 10.0::DOUBLE)) - 1))::INT AS bin, lo, hi, doc_id FROM documents, e)
SELECT bin, round(min(lo + (hi - lo) / 10.0::DOUBLE * (bin + 0.5)), 6) AS mid, round(avg(doc_id), 6) AS mean, count(*) AS n FROM b GROUP BY 1""")
def bin_means(spark, d):
    """AGG15."""
    return rounded(corpus.bin_means(table(spark, d, "documents"), "n_chars", "doc_id"))


@query("SELECT least(98, floor(n_chars / (1500.0::DOUBLE / 99)))::INT AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 1500 GROUP BY 1")
def len_hist(spark, d):
    """AGG16."""
    return corpus.histogram(table(spark, d, "documents"), "n_chars")


@query("SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value FROM events")
def minmax_scale(spark, d):
    """AGG18."""
    return rounded(corpus.minmax_scale(table(spark, d, "events").select("event_id", "value"), "value"))


@query("WITH v AS (SELECT event_id, value FROM events), r AS (SELECT event_id, value, rank() OVER (ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY value) AS ties, count(*) OVER () AS n FROM v WHERE value IS NOT NULL) SELECT event_id, round((below + (ties - 1) / 2.0::DOUBLE) / (n - 1), 6) AS rank FROM v LEFT JOIN r USING (event_id)")
def uniform_rank(spark, d):
    """AGG19."""
    return rounded(corpus.uniform_rank(table(spark, d, "events").select("event_id", "value"), "value", "rank").select("event_id", "rank"))


# Files, written and read again


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """A table whose files, in order of their paths, hold the rows in order of a key."""
    return df.repartitionByRange(4, key).sortWithinPartitions(key)


@query(f"WITH {TRIPLES} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, original AS input, reference AS output FROM triples QUALIFY row_id < 500")
def file_pairs(spark, d):
    """SRC2, SRC3, SNK1, JOIN1, TOP7."""
    path = io.scratch_dir(spark, "pairs")
    io.write_jsonl(_in_order(triples(spark, d), "doc_id").select(F.col("original").alias("input"), F.col("reference").alias("output")), path)
    return io.read_pairs(spark, path, 500)


@query(f"WITH {TRIPLES} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, CASE WHEN doc_id % 2 = 0 THEN corrected ELSE original END AS text FROM triples")
def file_text_key(spark, d):
    """SRC1."""
    path, even = io.scratch_dir(spark, "texts"), F.col("doc_id") % 2 == 0
    rows = _in_order(triples(spark, d), "doc_id").select(F.when(even, F.struct(F.col("corrected").alias("output"))).alias("originals"), F.when(~even, F.col("original")).alias("output"))
    io.write_jsonl(rows, path)
    return io.read_text_key(spark, path)


@query(f"WITH {TRIPLES} SELECT corrected FROM triples")
def file_field(spark, d):
    """SRC5, SRC13."""
    path = io.scratch_dir(spark, "field")
    io.write_jsonl(triples(spark, d), path)
    return io.read_field(spark, path, "corrected")


@query(f"WITH {TRIPLES} SELECT doc_id::VARCHAR AS book_id, len({WORDS('original')}) AS words, array_to_string({WORDS('corrected')}, ' ') AS answer FROM triples SEMI JOIN labels USING (doc_id)")
def shards_wanted(spark, d):
    """SRC6, FLT12: listed books out of written shards, whose other lines are not parsed."""
    path = io.scratch_dir(spark, "shards")
    segments = lambda c: tx.word_segments(F.col(c))
    url = F.concat(F.lit("./books/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    io.write_jsonl(triples(spark, d).select(url.alias("url"), segments("original").alias("text-orig"), segments("corrected").alias("answer")), path)
    found = wanted.read_wanted(spark, path, table(spark, d, "labels"), "doc_id")
    return found.select("book_id", F.size(tx.tokenize(F.array_join("text-orig", " "))).cast("long").alias("words"), F.array_join("answer", " ").alias("answer"))


@query(f"WITH {PAGES} SELECT * FROM pages_")
def file_pages(spark, d):
    """SRC7."""
    path = io.scratch_dir(spark, "pages")
    io.write_jsonl(pages(spark, d).select(F.concat_ws("_", "book_id", "page").alias("doc_id"), "input", "output"), path)
    return io.read_pages(spark, path)


@query("SELECT c_custkey::VARCHAR AS book_id, c_acctbal::DOUBLE AS corrected, c_nationkey / 7.0::DOUBLE AS original, NULL::DOUBLE AS improvement FROM customer")
def file_scores(spark, d):
    """SRC9, SNK3."""
    path = io.scratch_dir(spark, "scores")
    null = F.lit(None).cast("double")
    io.write_tsv(table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_acctbal").cast("double").alias("corrected"), (F.col("c_nationkey") / 7).alias("original"), null.alias("improvement")), path)
    return io.read_scores(spark, path)


@query("SELECT replace(n_name, ' ', '_') AS w1, replace(r_name, ' ', '_') AS w2, n_nationkey / 3.0::DOUBLE AS mi2, n_nationkey::BIGINT AS f12, n_regionkey::BIGINT AS f1, 7::BIGINT AS f2 FROM nation JOIN region ON n_regionkey = r_regionkey")
def file_collocations(spark, d):
    """SRC10, SNK4."""
    path = io.scratch_dir(spark, "collocations")
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    io.write_spaced(both.select(F.replace("n_name", F.lit(" "), F.lit("_")), F.replace("r_name", F.lit(" "), F.lit("_")), F.col("n_nationkey") / 3, "n_nationkey", "n_regionkey", F.lit(7)), path)
    return io.read_collocations(spark, path)


@query(f"WITH {TRIPLES}, {_TOKENS('reference')} SELECT w1, w2, round(mi2, 6) AS mi2, f12, f1, f2 FROM reference_m WHERE (w1 IN {_PICKED} OR w2 IN {_PICKED}) AND w1 <> w2 AND mi2 >= 3")
def file_significant(spark, d):
    """COL5, TXT25: collocations of selected words out of a file, which has these first."""
    path = io.scratch_dir(spark, "selected")
    found = collocate.collocations(triples(spark, d), "reference", selected=_PICKED)
    io.write_spaced(found.select("w1", "w2", "mi2", "f12", "f1", "f2"), path)
    return rounded(collocate.significant(io.read_collocations(spark, path)))


@query("SELECT o_custkey::VARCHAR AS ecco_id, arg_max(year(o_orderdate), o_orderkey)::INT AS start_year FROM orders GROUP BY 1")
def file_years(spark, d):
    """SRC11."""
    path = io.scratch_dir(spark, "years")
    io.write_jsonl(_in_order(table(spark, d, "orders"), "o_orderkey").select(F.col("o_custkey").cast("string").alias("ecco_id"), F.year("o_orderdate").alias("start_year")), path)
    return io.read_years(spark, path)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderkey LIMIT 1")
def file_lookup(spark, d):
    """SRC12."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return io.lookup(orders, "o_custkey", orders.agg(F.min("o_custkey")).scalar(), "o_orderkey")


@query("""WITH n AS (SELECT doc_id, n_chars, unnest(generate_series(0, doc_id % 4)) AS k FROM documents), m AS (SELECT *, unnest(generate_series(0, (doc_id + k) % 3)) AS s FROM n)
SELECT 'doc' || doc_id || '.txt' AS name, (2 * k)::BIGINT AS line, s::INT AS place, (s * 10 + k)::INT AS start, (s * 10 + k + n_chars % 9)::INT AS "end" FROM m""")
def file_zip_spans(spark, d):
    """SRC8: span lists in several notations, a member a document, in zip archives."""
    i, n = F.col("doc_id"), F.col("n_chars")
    start = lambda s, k: (s * 10 + k).cast("string")
    number = lambda s, k: F.when(k % 2 == 0, start(s, k)).otherwise(F.concat(F.lit("np.int64("), start(s, k), F.lit(")")))
    pair = lambda s, k: F.concat(F.lit("["), number(s, k), F.lit(", "), (s * 10 + k + n % 9).cast("string"), F.lit("]"))
    line = lambda k: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), ((i + k) % 3).cast("int")), lambda s: pair(s, k)), ", "), F.lit("]"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), line), "\n\n")
    rows = table(spark, d, "documents").repartition(3, "doc_id").select(F.concat(F.lit("doc"), i.cast("string"), F.lit(".txt")).alias("name"), text.alias("text"))
    path = io.scratch_dir(spark, "zips")
    zipped.write_archives(rows, path)
    return io.read_zipped(spark, path).select("name", "line", F.posexplode("spans").alias("place", "s")).select("name", "line", "place", "s.*")


@query(f"WITH {EDITS} SELECT doc_id::VARCHAR AS url, original, corrected, ops AS alignments FROM edits")
def file_edit_strings(spark, d):
    """SRC13, SNK8."""
    path = io.scratch_dir(spark, "edits")
    io.write_jsonl(edits(spark, d).select(F.col("doc_id").cast("string").alias("url"), "original", "corrected", F.col("ops").alias("alignments")), path)
    return io.read_edit_strings(spark, path)


@query("""SELECT '{"first":' || min(year(o_orderdate)) || ',"last":' || max(year(o_orderdate)) || ',"books":' || count(*) || '}' AS value FROM orders""")
def report_json(spark, d):
    """SNK5."""
    return io.json_lines(corpus.year_stats(years(spark, d), 0, 9999).select("first", "last", "books"))


@query("WITH t AS (SELECT event_id AS trial, value, (event_id % 11)::DOUBLE AS k FROM events) SELECT trial, round(k / 10, 6) AS k, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value FROM t")
def parallel_coordinates(spark, d):
    """SNK6, AGG18."""
    t = table(spark, d, "events").select(F.col("event_id").alias("trial"), "value", (F.col("event_id") % 11).cast("double").alias("k"))
    return rounded(corpus.parallel_coordinates(t, ["k"], "value"))


# Kernels that SQL has no counterpart for


@query()
def align_spans(spark, d):
    """ALN1: local alignment of short segments."""
    rows = _segments(spark, d)  # before the function, which takes what is shipped by then
    found = rows.select("doc_id", "seg", align.aligner("local")(F.col("a"), F.col("b")).alias("f"))  # twice in one step would run twice
    return found.select("doc_id", "seg", F.col("f.score").alias("score"), F.size("f.spans").alias("spans"))


@query()
def segment_align(spark, d):
    """ALN9."""
    return align.align_segments(_segments(spark, d))


@query()
def edit_strings(spark, d):
    """ALN2, ALN6, ALN8: whole texts."""
    c = triples(spark, d).select("doc_id", tx.compact(F.col("original")).alias("a"), tx.compact(F.col("corrected")).alias("b"))
    spans = align.aligner("global", free_ends=True)(F.col("a"), F.col("b"))["spans"]
    return align.edit_documents(c.withColumn("spans", spans))


#: What a model says around its answer.
BEFORE, AFTER = "Sure! Corrected text:\n\n", "\n\n(END OF TEXT)"


def _pruned(spark, d):
    said = F.concat(F.lit(BEFORE), "corrected", F.lit(AFTER))
    return align.prune_predictions(triples(spark, d).select("doc_id", F.col("original").alias("input"), said.alias("output")))


@query()
def prune_prediction(spark, d):
    """ALN14, FLT14: whole predictions with a model's talk around them, which goes."""
    return _pruned(spark, d)


@query()
def merge_overlap(spark, d):
    """ALN16, ALN17: overlapping windows merged again."""
    parts = triples(spark, d).select("doc_id", tx.overlap_windows(F.col("reference"), 60, 0.25).alias("parts"))
    return align.merge_documents(parts)


@query()
def diff_opcodes(spark, d):
    """ALN11."""
    return align.diff_lines(triples(spark, d), "original", "corrected")


def stub_model(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model."""
    return [p.rsplit(":", 1)[-1].replace("fh", "sh") for p in prompts]


@query(f"WITH {TRIPLES} SELECT doc_id, replace(string_split(original, ':')[-1], 'fh', 'sh') AS answer FROM triples")
def stream_answers(spark, d):
    """SRC4, SNK2, LM11: a folder drained as a stream; a fifth of the rows arrive twice."""
    rows = triples(spark, d).select("doc_id", F.col("original").alias("input"))
    folder, out, marks = (io.scratch_dir(spark, label) for label in ("arrivals", "answers", "marks"))
    io.write_jsonl(rows.repartition(6, "doc_id"), folder)
    io.write_jsonl(rows.where("doc_id % 5 = 0").repartition(2, "doc_id"), folder, append=True)
    stream = pair_stream(spark, folder, 3, "doc_id long, input string")
    answer_once(stream, stub_model, out, marks, key="doc_id").awaitTermination()
    return answers(spark, out, stream.schema).select("doc_id", "answer")


def stub_setup():
    """Stands for loading a model; it refuses some prompts."""

    def model(prompts: list[str]) -> list[str]:
        if any(len(p) % 7 == 0 for p in prompts):
            raise ValueError("refused")
        return stub_model(prompts)

    return model


@query(f"WITH {TRIPLES} SELECT doc_id, CASE WHEN length(original) % 7 <> 0 THEN replace(string_split(original, ':')[-1], 'fh', 'sh') END AS answer, CASE WHEN length(original) % 7 = 0 THEN 'ValueError: refused' END AS error FROM triples")
def served_answers(spark, d):
    """LM1-3: a model set up once a worker; what it refuses becomes a row's error."""
    asked = triples(spark, d).select("doc_id", serve.serve(F.col("original"), stub_setup).alias("r"))
    return asked.select("doc_id", "r.answer", "r.error")


@query()
def correct_stub(spark, d):
    """LM4-7, WIN3."""
    docs = triples(spark, d).select("doc_id", tx.word_segments(F.col("original"), 60).alias("blocks"))
    return correct.correct_documents(docs, stub_model, degree=1)


@query()
def trial_search_stub(spark, d):
    """LM9, LM10."""
    space = correct.trial_table(spark, {"temperature": [0.0, 0.5], "top_k": [1, 2]})
    answer = lambda t, p: (t or "").replace("f", "s", int(40 * p["temperature"] * p["top_k"]))
    return rounded(correct.search(triples(spark, d), space, answer).drop("parameters"))


@query()
def trial_search_adaptive(spark, d):
    """LM9: rounds that are drawn by what the rounds before gave."""
    answer = lambda t, p: (t or "").replace("f", "s", int(40 * p["share"])) + "x" * int(p["noise"])
    space = {"share": ("float", 0.0, 1.0), "noise": ("int", 0, 3)}
    found = tune.adaptive_search(triples(spark, d), space, answer, io.scratch_dir(spark, "trials"), trials=12, batch=6)
    return rounded(found.select("trial", "round", "objective"))
