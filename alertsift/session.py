"""Session set-up, reliable checkpoints and size-checked small tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 100_000


def get_session(app: str = "alertsift", cores: str = "*") -> SparkSession:
    """A local session for tests and the bench; on a cluster spark-submit sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the session names it in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="alertsift-"))
    return context.getCheckpointDir()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for one stage table under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame) -> DataFrame:
    """Fix the rows of ``df`` by a reliable checkpoint, so later passes see one result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_groups(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal groups, a null group being equal to a null group; columns as of a named join."""
    names = {c: f"_group{i}" for i, c in enumerate(on)}
    other = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for c, alias in names.items():
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(alias))
    return left.join(other, same, how).drop(*names.values())


def bounded(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """``df`` as a broadcast table when it has at most ``limit`` rows, else ``df`` itself.

    The check reads no more than ``limit + 1`` rows. Beyond the limit the caller's join is
    planned as an ordinary shuffle join (with adaptive skew handling).
    """
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))
