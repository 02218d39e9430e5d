"""Session-level helpers used by every operator."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def process_cache() -> dict:
    """A dictionary of this process; unlike a module's variables it never travels with a function."""
    return sys.__dict__.setdefault("_quarry_cache", {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named test table under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only where neither it nor
    ``setCheckpointDir`` names one (tests on one machine) make a private folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quarry-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The files are reliable storage, so a lost executor costs a re-read and no more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast where it was counted to have at most ``rows`` rows, else as it is.

    ``df`` is counted here and read again by the join: materialise it where it is not cheap.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"
