"""Readers and writers of the corpus formats, with explicit schemas (SRC1-13, SNK1-5)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.sources import zipped

PAIR = "input string, output string"
BLOCKS = "input_1 string, input_2 string, output_1 string, output_2 string"
TRIAL = (
    "alignments struct<aligned_ocr:string,aligned_correction:string,alignment_string:string>, "
    "originals struct<input:string,output:string,model_correction_not_aligned:string,model_correction:string>, "
    "scores struct<model_vs_GT:double,input_vs_GT:double>, parameters map<string,double>, time_taken double"
)
PAGE = "doc_id string, input string, output string"
SHARD = "url string, `text-orig` array<string>, answer array<string>, `post-processed-answer` array<string>, `removed-chunks` array<string>, flagged string"
EDIT_STRINGS = "url string, original string, corrected string, alignments string"
META = "ecco_id string, start_year int"
SCORES = "book_id string, corrected double, original double, improvement double"
SPAN_PAIR = "array<struct<a_start:int,a_end:int,b_start:int,b_end:int>>"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; one
    of our own only in local mode with none set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="vellum-")
    return f"{root.rstrip('/')}/vellum-{label}-{uuid.uuid4().hex}"


def read_text_key(spark: SparkSession, path: str, key: str = "output") -> DataFrame:
    """SRC1: one text of each JSON line, from ``originals`` where a line has that object.

    Returns ``row_id, text``; the row id follows the line order (see :func:`with_row_id`).
    """
    raw = with_row_id(spark.read.schema(f"originals struct<`{key}`:string>, `{key}` string").json(path))
    return raw.select("row_id", F.when(F.col("originals").isNotNull(), F.col("originals")[key]).otherwise(F.col(key)).alias("text"))


def with_row_id(read: DataFrame) -> DataFrame:
    """JOIN1's key for a table just read from files: line numbers from 0, files in order of
    their paths.

    Two light passes: rows are counted by file split, and each takes its place after the
    rows of the splits before it, so no row moves.
    """
    marked = read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_mono"))
    counts = marked.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.broadcast(counts.select("_file", "_start", before.alias("_before"), "_first"))  # a row for each split
    return marked.join(ahead, ["_file", "_start"]).select((F.col("_mono") - F.col("_first") + F.col("_before")).alias("row_id"), *read.columns)


def read_pairs(spark: SparkSession, path: str, max_examples: int | None = None) -> DataFrame:
    """SRC2, SRC3: plain or gzipped pairs; a falsy limit means all rows."""
    rows = with_row_id(spark.read.schema(PAIR).json(path))
    return rows.where(F.col("row_id") < max_examples) if max_examples else rows


def read_field(spark: SparkSession, path: str, field: str) -> DataFrame:
    """SRC5, SRC13: a single field; other fields are never parsed."""
    return spark.read.schema(f"`{field}` string").json(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: a directory of numbered shards, with the shard's number."""
    shard = F.regexp_extract(F.input_file_name(), r"([0-9]+)\.jsonl(?:\.gz)?$", 1).try_cast("int")
    return spark.read.schema(SHARD).json(path).withColumn("shard", shard)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: pages whose id is ``<book>_<page>``, split at the first underscore."""
    return split_page_id(spark.read.schema(PAGE).json(path))


def split_page_id(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.substring_index("doc_id", "_", 1).alias("book_id"), F.expr("substr(doc_id, instr(doc_id, '_') + 1)").try_cast("int").alias("page"), "input", "output"
    )


def parse_spans(text: Column) -> Column:
    """SRC8: ``[[a, b), ...]`` out of any rendering of nested number lists, also with
    numbers written ``np.int64(n)``; pairs in order."""
    plain = F.regexp_replace(text, r"np\.int(?:32|64)\(\s*(-?[0-9]+)\s*\)", "$1")
    number = lambda x, i: F.regexp_extract(x, r"(-?[0-9]+)\s*,\s*(-?[0-9]+)", i).cast("int")
    pairs = F.regexp_extract_all(plain, F.lit(r"[\[(]\s*-?[0-9]+\s*,\s*-?[0-9]+\s*[\])]"), F.lit(0))
    return F.transform(pairs, lambda x: F.struct(number(x, 1).alias("start"), number(x, 2).alias("end")))


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: ``archive, name, line, text, spans`` of the lines of all members of the zip
    archives at a path; blank lines are left out but counted.  See ``zipped``."""
    zipped.register(spark)
    text = spark.read.format(zipped.FORMAT).load(path)
    return text.where("trim(text) <> ''").select("archive", "name", "line", "text", parse_spans(F.col("text")).alias("spans"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: book scores with a header line."""
    return spark.read.csv(path, sep="\t", header=True, schema=SCORES)


def read_collocations(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: ``w1 w2 mi2 f12 f1 f2`` by white space, without a header."""
    parts = F.split(F.trim("value"), r"\s+")
    kinds = (("w1", "string"), ("w2", "string"), ("mi2", "double"), ("f12", "long"), ("f1", "long"), ("f2", "long"))
    return spark.read.text(path).where(F.trim("value") != "").select(*[parts[i].cast(t).alias(c) for i, (c, t) in enumerate(kinds)])


def read_years(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: publication years; of repeated ids the last line counts."""
    return last_by_key(with_row_id(spark.read.schema(META).json(path)), "ecco_id", "row_id")


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    own = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), order).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in own])


def lookup(rows: DataFrame, key: str, value, order: str) -> DataFrame:
    """SRC12: the first row with a key."""
    return rows.where(F.col(key) == value).orderBy(order).limit(1)


def read_edit_strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDIT_STRINGS).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """SNK1, SNK2."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """SNK3: with a header in each part."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_spaced(df: DataFrame, path: str) -> None:
    """SNK4: columns separated by a space, no header."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])).write.mode("overwrite").text(path)


def json_lines(df: DataFrame) -> DataFrame:
    """SNK5: a report as one JSON text a row, for the caller to print."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
