"""Files of pairs as a stream: answered once, appended, resumed (SRC4, SNK2, LM11)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vellum.operators.correct import Model, generate
from vellum.sources.io import PAIR


def pair_stream(spark: SparkSession, folder: str, files_per_batch: int = 10, schema: str = PAIR) -> DataFrame:
    """Lines of the JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def answer_stream(stream: DataFrame, model: Model, out: str, checkpoint: str) -> StreamingQuery:
    """Append the model's answers; the checkpoint makes a restart go on where it ended,
    each input file counted once."""
    answered = generate(stream, model, prompt="input")
    return answered.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def answer_once(stream: DataFrame, model: Model, out: str, checkpoint: str, key: str = "input", prompt: str = "input") -> StreamingQuery:
    """Answers to the rows of a stream, each ``key`` answered once, as Parquet under ``out``.

    A batch is written to the folder of its number, which replaces what an attempt at the
    same batch had left there, and leaves out the keys that other batches hold, so a batch
    that is delivered again, or rows that arrive again in other files, change nothing.  Of
    rows of a batch that share a key one is answered; null keys are answered each.  Only
    the keys of earlier answers are read, by column.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(key).isNull()).unionByName(batch.where(F.col(key).isNotNull()).dropDuplicates([key]))
        done = answers(batch.sparkSession, out, batch.schema)
        if done is not None:
            rows = remaining(rows, done.where(F.col("batch") != number), key)
        generate(rows, model, prompt=prompt).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(spark: SparkSession, out: str, schema: StructType) -> DataFrame | None:
    """What :func:`answer_once` has written, with its batch; None before the first batch."""
    try:
        return spark.read.schema(StructType([*schema.fields, StructField("answer", StringType()), StructField("batch", LongType())])).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """LM11, JOIN6: batch resume by key; a count of lines would go wrong where rows were
    filtered."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
