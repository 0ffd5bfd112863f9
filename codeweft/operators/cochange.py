"""Files that change together: pairs within a commit, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.tables import small


def cochange_pairs(changes: DataFrame, max_files: int = 50, min_count: int = 2, last_commits: int | None = None) -> DataFrame:
    """Pairs left < right of ``changes`` (space, commit, seq, path): space, left, right, count.

    Commits of more than ``max_files`` distinct paths don't count; with
    ``last_commits`` only each space's latest commits by ``seq`` do. A commit
    is small once it is kept, so its pairs are made from its own sorted list.
    """
    rows = changes.where("space IS NOT NULL AND commit IS NOT NULL AND path IS NOT NULL").select("space", "commit", "seq", "path").dropDuplicates(["space", "commit", "path"])
    sizes = rows.groupBy("space", "commit").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))
    if last_commits is not None:
        latest = Window.partitionBy("space").orderBy(F.col("seq").desc_nulls_last(), "commit")
        sizes = sizes.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= last_commits)
    kept = rows.join(sizes.where(F.col("n").between(2, max_files)).select("space", "commit"), ["space", "commit"], "left_semi")
    lists = kept.groupBy("space", "commit").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    lefts = lists.select("space", "paths", F.posexplode("paths").alias("at", "left"))
    pairs = lefts.select("space", "left", F.explode(F.slice("paths", F.col("at") + 2, F.size("paths"))).alias("right"))
    return pairs.groupBy("space", "left", "right").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)


def top_pairs(pairs: DataFrame, limit: int = 1000) -> DataFrame:
    """The most frequent pairs of each space: by count, then left and right."""
    order = Window.partitionBy("space").orderBy(F.col("count").desc(), "left", "right")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def partners(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Partners of each file (space, path) on either side of a pair: space, path, partner, count."""
    both = pairs.select("space", F.col("left").alias("path"), F.col("right").alias("partner"), "count").unionByName(
        pairs.select("space", F.col("right").alias("path"), F.col("left").alias("partner"), "count")
    )
    return both.join(small(files.select("space", "path").distinct()), ["space", "path"])
