"""Graphs kept by content: a folder of Parquet tables for each source tree, built once and never refreshed.

The key is that of what a graph is made of: the tree, the version, the profile and the
ignore files in their order. A new tree is a new key. A folder counts once its
marker is written, which is last; so a build that dies leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import relations

TABLES = ("files", "symbols", "relations", "failures")
MARKER = "complete"


def cache_key(tree: str, profile: str = "full", version: str = "1", ignore_files: Sequence[tuple[str, str]] = ()) -> str:
    """SHA-256 over the tree's id and all that shapes the result; the order of ignore files matters."""
    parts = [version, tree, profile, *(x for pair in ignore_files for x in pair)]
    return hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()


def tree_key(files: DataFrame) -> str:
    """The id of a source tree (repo_key, file_path, content): equal for equal files in any order; combined before the shuffle."""
    whole = [F.xxhash64(F.lit(seed), "repo_key", "file_path", F.sha2("content", 256)) for seed in (1, 2)]
    row = files.agg(F.count(F.lit(1)), *[F.bit_xor(h) for h in whole], *[F.sum(h.cast("decimal(38,0)")) for h in whole]).first()
    return hashlib.sha256(repr(tuple(map(str, row))).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def load(spark: SparkSession, folder: str, key: str) -> dict[str, DataFrame] | None:
    """The tables of a key, or None if it was never built to the end."""
    at = f"{folder}/{key}"
    return {name: spark.read.parquet(f"{at}/{name}") for name in TABLES} if _exists(spark, f"{at}/{MARKER}/_SUCCESS") else None


def build(files: DataFrame, parse: Callable[[DataFrame], DataFrame], folder: str, key: str, profile: str = "full") -> None:
    """Writes the tables of a key, and its marker when all are there."""
    spark, at = files.sparkSession, f"{folder}/{key}"
    facts = parse(files).persist()
    tables = {
        "files": facts.where("fact = 'file'").select("repo_key", "file_path", "language", F.col("body_hash").alias("blob"), F.col("start_line").alias("n_bytes"), F.col("end_line").alias("n_lines")),
        "symbols": relations.symbols(facts),
        "relations": relations.code_graph(facts, profile),
        "failures": facts.where("fact = 'failure'").select("repo_key", "file_path", "language", F.col("kind").alias("code")),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{at}/{name}")
    facts.unpersist()
    spark.createDataFrame([(key, profile)], "key string, profile string").coalesce(1).write.mode("overwrite").parquet(f"{at}/{MARKER}")


def load_or_build(files: DataFrame, parse: Callable[[DataFrame], DataFrame], folder: str, profile: str = "full", ignore_files: Sequence[tuple[str, str]] = ()) -> tuple[dict[str, DataFrame], bool]:
    """The tables of a source tree and whether they were there already."""
    key = cache_key(tree_key(files), profile, ignore_files=ignore_files)
    held = load(files.sparkSession, folder, key)
    if held is not None:
        return held, True
    build(files, parse, folder, key, profile)
    return load(files.sparkSession, folder, key), False


def selected(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables cut to some paths (file_path): their files and symbols, and relations between these or to external nodes."""
    keep = paths.select("file_path").distinct()
    own = {name: tables[name].join(keep, "file_path", "left_semi") for name in ("files", "symbols", "failures")}
    ids = own["symbols"].select(F.col("symbol_id").alias("id")).unionByName(own["files"].select(relations.file_id(F.col("repo_key"), F.col("file_path")).alias("id")))
    inside = tables["relations"].join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    local = inside.where("to_id NOT LIKE 'external:%'").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return own | {"relations": local.select(*tables["relations"].columns).unionByName(inside.where("to_id LIKE 'external:%'").select(*tables["relations"].columns))}
