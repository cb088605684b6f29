"""What the training-data operators share: table access, scratch tables, word counts.

Scratch tables cut lineage.  They are Parquet folders under the directory named in
``spark.checkpoint.dir``, which driver and executors share, so a lost executor costs a
recomputed task and never a lost intermediate.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.ship import ship

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a folder of our own only in local mode with none set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a scratch table and return a DataFrame that scans it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/vellum-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint of a small table; Spark removes it with its last reference."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths of the scratch tables of this driver that still stand.
_made: list[str] = []


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables; one that cannot be deleted stays for whoever clears the
    folder."""
    for path in paths:
        with contextlib.suppress(ValueError):
            _made.remove(path)
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for table in tables:
        drop_paths(table.sparkSession, table.scratch_path)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what was written within it, but for the tables put in the list it gives."""
    keep, before = [], list(_made)
    yield keep
    kept = {t.scratch_path for t in keep}
    drop_paths(spark, *[p for p in _made if p not in before and p not in kept])


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python runs in tasks: ship the code, and keep Arrow batches small, for rows
    may hold very long texts.

    The session's batch size is lowered and stays so: Spark reads it when the returned
    DataFrame runs, which is after the operator has returned.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def one_space(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id as text leaves remainder 2 by 4 (null: False)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def seeded_order(seed: int, *keys: Column) -> Column:
    """A hexadecimal string that orders rows at random, the same on each run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def slices(n: int, size: int) -> Iterator[tuple[int, int]]:
    for start in range(0, n, size):
        yield start, min(n, start + size)
