"""Buckets whose members meet in pairs, cut into cells so that none is too large for a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a bucket that one task compares with each other.
CELL = 500


def celled(placed: DataFrame, keys: Sequence[str], node: str, size: int = CELL) -> DataFrame:
    """Rows of buckets of several members, with the bucket's number of cells and the row's own: placed's columns, cells, cell."""
    keys = list(keys)
    full = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_members")).where("_members > 1")
    return placed.join(full, keys).withColumn("cells", F.ceil(F.col("_members") / size).cast("int")).withColumn("cell", F.pmod(F.xxhash64(node), F.col("cells")).cast("int")).drop("_members")


def in_cells(placed: DataFrame, keys: Sequence[str], node: str, size: int = CELL) -> DataFrame:
    """Rows of buckets of several members, once for each meeting (i <= j) of their cell with another: placed's columns, cell, i, j.

    A bucket of n members has n / ``size`` cells; every two cells meet in a
    group (keys, i, j) of their own, so a bucket that holds a third of all
    rows is spread over tasks and no pair is lost. Within a group, rows with
    cell = i are one side and rows with cell = j the other.
    """
    met = celled(placed, keys, node, size).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return met.withColumn("i", F.least("cell", "_other")).withColumn("j", F.greatest("cell", "_other")).drop("cells", "_other")
