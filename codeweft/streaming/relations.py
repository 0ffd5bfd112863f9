"""Relations as a stream: repeats dropped and counts kept by window, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_stream(relations: DataFrame, late: str = "14 days") -> DataFrame:
    """Each edge once within the time that rows may come late (by emitted_at)."""
    return relations.withWatermark("emitted_at", late).dropDuplicatesWithinWatermark(["repo_key", "from_id", "to_id", "relation"])


def counts_stream(relations: DataFrame, window: str = "1 day", late: str = "14 days") -> DataFrame:
    """Edges by type and window of emitted_at; works on a batch as well."""
    timed = relations.where("emitted_at IS NOT NULL AND relation IS NOT NULL").withWatermark("emitted_at", late)
    counted = timed.groupBy(F.window("emitted_at", window).alias("w"), "relation").agg(F.count(F.lit(1)).alias("n_edges"))
    return counted.select(F.col("w.start").alias("window_start"), "relation", "n_edges")
