"""Table access and the few plan helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many rows and bytes, counted before the join is planned.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 * 1024 * 1024
#: Types whose values have one size, so rows alone tell how large they are.
FIXED_TYPES = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows and BROADCAST_BYTES bytes, else unchanged.

    The count stops at ``limit + 1`` rows, so a large side costs little and is
    then joined by shuffle (with AQE's skew handling).
    """
    first = df.limit(limit + 1)
    open_ = [name for name, kind in df.dtypes if kind not in FIXED_TYPES]
    if not open_:
        return F.broadcast(df) if first.count() <= limit else df
    size = F.octet_length(F.to_json(F.struct(*open_)))
    rows, size = first.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only in local mode."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "codeweft-checkpoints")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def collapse_blanks(text: Column) -> Column:
    """``text`` with each run of white space as one blank and trimmed ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def short_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``text``."""
    return F.substring(F.sha2(text, 256), 1, 16)


def latest_content(rows: DataFrame, values: list[str], at: str = "ingested_at") -> DataFrame:
    """(file_id, *values) of each file's row with the greatest ``at``; equal ones are told apart by ``values``.

    Rows with a null file_id, file_path or content are left out.
    """
    known = rows.where("file_id IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL")
    return known.groupBy("file_id").agg(F.max(F.struct(at, *values)).alias("r")).select("file_id", *[F.col(f"r.{v}").alias(v) for v in values])
