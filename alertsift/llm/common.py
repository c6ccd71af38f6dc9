"""Column expressions and folders that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path

# The six blanks that separate words.
BLANKS = "\\x20\\x09-\\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also if ``body`` names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, begin: Column, step: Callable, out: Callable, kind: str, size: int = 256) -> Column:
    """``out(state, item)`` of every item of an array, where ``step(state, item)`` gives the next item's state.

    ``kind`` is the type of an output. The items go in pieces of ``size``, so that a long array is not copied
    for each of its items.
    """
    none = F.array().cast(f"array<{kind}>")

    def inside(acc: Column, item: Column) -> Column:
        return F.struct(step(acc["state"], item).alias("state"), F.array_append(acc["made"], out(acc["state"], item)).alias("made"))

    def piece(whole: Column) -> Callable[[Column, Column], Column]:
        def take(acc: Column, k: Column) -> Column:
            start = F.struct(acc["state"].alias("state"), none.alias("made"))
            done = F.aggregate(F.slice(whole, k * size + 1, F.lit(size)), start, inside)
            return let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["made"], d["made"]).alias("made")))

        return take

    def whole(array: Column) -> Column:
        start = F.struct(begin.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("made"))
        pieces = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / size).cast("int"))
        found = F.aggregate(pieces, start, piece(array), lambda acc: F.flatten(acc["made"]))
        return F.when(F.size(array) > 0, found).otherwise(none)

    return let(items, whole)


def words_of(text: Column) -> Column:
    """The words of a text in order, an empty array for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Send at most ``rows`` rows at a time to Python, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage.

    The rows survive lost executors; the folder belongs to the job and goes with the shared folder.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stage_path = path
    return table


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads, in whatever store they lie."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stage_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
