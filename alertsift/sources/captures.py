"""Capture files in, stage and metric tables out."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.keys import label_of
from ..operators.flows import epoch_micros, parse_timestamp, split_null_flow_ids
from ..operators.ordering import number_rows
from ..session import bounded

_TEXT = {"Flow ID", "Src IP", "Dst IP", "Timestamp", "Label"}


def flow_schema() -> T.StructType:
    """The 84 columns of a flow capture, in file-independent order (CSV is read by header)."""
    r = S.CAPTURE_RULES
    statistics = [
        *r.sums, *r.maxima, *r.minima, *r.first, *r.weighted, *r.pooled, *r.squared, *r.rates, *S.DROPPED_STATISTICS,
    ]
    names = [*S.FLOW_METADATA, *statistics, "Label"]
    return T.StructType([T.StructField(n, T.StringType() if n in _TEXT else T.DoubleType()) for n in names])


def capture_name(path: Column) -> Column:
    """Name of the capture a row came from: a ``.csv`` file, or a ``.csv`` folder of parts."""
    return F.regexp_extract(F.url_decode(path), r"([^/=]+\.csv)(?:/part-[^/]*)?$", 1)


def capture_headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the header of their capture; files without a byte are left out.

    Names come from the listing alone. Of every capture one file's first line is read; a part
    with another header than its capture is found when it is scanned.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    files = listing.where("length > 0").select("path", capture_name(F.col("path")).alias("capture")).collect()
    captures: dict[str, list[str]] = {}
    for row in sorted(files, key=lambda r: r["path"]):
        literal = re.sub(r"([\[\]{}*?\\])", r"\\\1", row["path"])  # a name, not a pattern
        captures.setdefault(row["capture"] or row["path"], []).append(literal)
    first_line = lambda parts: tuple(spark.read.option("header", True).csv(parts[0]).columns)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(first_line, captures.values()))
    grouped: dict[tuple[str, ...], list[str]] = {}
    for header, parts in zip(headers, captures.values(), strict=True):
        grouped.setdefault(header, []).extend(parts)
    return grouped


def _scan(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None) -> DataFrame:
    """One scan of files with the same header; a file with another one is an error."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("enforceSchema", False)
    raw = reader.csv(list(paths))
    if schema is None:
        return raw.select("*", F.col("_metadata.file_path").alias("_path"))

    def taken(field: T.StructField):
        if field.name not in raw.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        column = F.col(f"`{field.name}`")
        return (column if isinstance(field.dataType, T.StringType) else column.try_cast(field.dataType)).alias(field.name)

    return raw.select(*[taken(f) for f in schema.fields], F.col("_metadata.file_path").alias("_path"))


def scan_captures(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """All capture CSVs of a folder as one dataset with ``source_file`` and ``label``.

    Captures are united by column name: their headers may differ in order, and a column that a
    capture lacks is null there. With a schema the needed columns are picked by name and converted;
    text that does not convert becomes null. Without one every column is read as text. A column of
    the schema that no capture has is an error, as is a part of a capture whose header differs from
    the capture's other parts.
    """
    paths = [path] if isinstance(path, str) else list(path)
    headers = capture_headers(spark, paths)
    if schema is not None and headers:
        absent = [f.name for f in schema.fields if not any(f.name in h for h in headers)]
        if absent:
            raise ValueError(f"no capture has the columns {absent}")
    groups = [paths] if len(headers) < 2 else list(headers.values())
    scans = [_scan(spark, group, schema) for group in groups]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    named = raw.withColumn("source_file", capture_name(F.col("_path"))).drop("_path")
    return named.withColumn("label", label_of(F.col("source_file")))


def with_row_key(df: DataFrame, name: str = "packet_key") -> DataFrame:
    """A reproducible row key for data without one: content digest and number among equal rows.

    Equal rows are numbered over range partitions in scan order, so a row that makes up a
    third of the data is spread over many tasks.
    """
    content = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]
    marked = df.withColumns(
        {"_digest": F.md5(F.concat_ws("\1", *content)), "_scan": F.monotonically_increasing_id()}
    )
    numbered = number_rows(marked, ["_digest"], ["_scan"], "_copy")
    return numbered.withColumn(name, F.concat("_digest", F.lit("#"), F.col("_copy").cast("string"))).drop(
        "_digest", "_scan", "_copy"
    )


def read_flow_segments(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(segments, rejected rows without Flow ID), with ``ts`` in seconds and a content tie-break."""
    df = scan_captures(spark, path, flow_schema())
    columns = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumns(
        {
            "ts": F.floor(epoch_micros(parse_timestamp(F.col("Timestamp"))) / 1_000_000),
            "tie": F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1)),
        }
    )
    return split_null_flow_ids(df)


def label_from_file_map(df: DataFrame, file_map: Mapping[str, Sequence[str]], file: str = "source_file") -> DataFrame:
    """Category from lists of files; rows of files in no list are left out."""
    pairs = [(f, category) for category, files in file_map.items() for f in files]
    table = df.sparkSession.createDataFrame(pairs, f"{file} string, category string")
    return df.join(bounded(table), file)


def missing_files(df: DataFrame, file_map: Mapping[str, Sequence[str]], file: str = "source_file") -> DataFrame:
    """Listed files of which no row was read."""
    pairs = [(f, category) for category, files in file_map.items() for f in files]
    table = df.sparkSession.createDataFrame(pairs, f"{file} string, category string")
    return table.join(df.select(file).distinct(), file, "left_anti")


def pair_captures(packets: DataFrame, flows: DataFrame, file: str = "source_file") -> DataFrame:
    """Packet captures and flow captures of the same stem."""
    stem = lambda ending: F.regexp_replace(F.col(file), ending, "")
    left = packets.select(stem(r"\.csv$").alias("stem"), F.col(file).alias("packet_file")).distinct()
    right = flows.select(stem(r"\.pcap_Flow\.csv$").alias("stem"), F.col(file).alias("flow_file")).distinct()
    return left.join(right, "stem")


def stage_table(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path`` if it is there, else ``build()`` written there first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def write_metrics(df: DataFrame, path: str, form: str = "json") -> None:
    """A metric table as JSON lines or CSV."""
    writer = df.write.mode("errorifexists")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
