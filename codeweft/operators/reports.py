"""Reports over files, endpoints and relations: scaled statistics, totals by language, checks, sizes and sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LONG = 2**63 - 1
# ---- fixed values: what languages of the graph support, by relation
CALL_LANGUAGES = ("Go", "Python", "TypeScript", "JavaScript", "Java", "Rust", "C", "C#", "PHP")
CAPABILITIES = {
    "DEFINES": (), "CONTAINS": (), "CALLS": CALL_LANGUAGES, "CONSTRUCTS": CALL_LANGUAGES, "IMPORTS": CALL_LANGUAGES,
    "READS_FIELD": ("Go", "TypeScript", "JavaScript", "Java", "Rust", "C#"), "WRITES_FIELD": ("Go", "TypeScript", "JavaScript", "Java", "Rust", "C#"),
    "CONFIGURES": ("YAML", "HCL", "Dockerfile", "TOML"), "RESOURCE_DEPENDS_ON": ("YAML", "HCL", "Dockerfile", "Makefile"),
}


def scaled(value: Column, total: Column, observed: Column) -> Column:
    """A count over ``observed`` files as it would be over ``total``, rounded up, at most the largest whole number."""
    wide = F.ceil(value.cast("decimal(38,0)") * total.cast("decimal(19,0)") / observed.cast("decimal(19,0)"))
    return F.when((value <= 0) | (total <= observed) | (observed <= 0), value).when(wide > MAX_LONG, F.lit(MAX_LONG)).otherwise(wide).cast("bigint")


def completeness_level(failures: Column, files: Column, parsed: Column, symbols: Column) -> Column:
    """ok, degraded or unsafe by how much of what was found could be read."""
    return (
        F.when(files == 0, "ok")
        .when((parsed * 2 < files) | (failures * 5 > files), "unsafe")
        .when((failures > 0) | (symbols == 0), "degraded")
        .otherwise("ok")
    )


def language_totals(files: DataFrame) -> DataFrame:
    """Files, bytes, lines and failures of ``files`` (language, n_bytes, n_lines, failed, seconds) by language and in all (language null).

    Failed files don't count for bytes, lines and seconds; lines a second is
    that of the sums, not a mean of rates.
    """
    good = lambda c: F.coalesce(F.sum(F.when(~F.col("failed"), F.col(c))), F.lit(0))
    out = files.where("language IS NOT NULL").rollup("language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("failed").alias("n_failed"), good("n_bytes").alias("n_bytes"), good("n_lines").alias("n_lines"), good("seconds").alias("seconds"))
    return out.withColumn("lines_a_second", F.round(F.when(F.col("seconds") > 0, F.col("n_lines") / F.col("seconds")), 2))


def coverage_counts(endpoints: DataFrame, relations: DataFrame) -> DataFrame:
    """How many endpoints of each kind and relations of each type there are: what, name, n."""
    kinds = endpoints.where("endpoint_kind IS NOT NULL").groupBy(F.lit("kind").alias("what"), F.col("endpoint_kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(relations.where("relation IS NOT NULL").groupBy(F.lit("relation").alias("what"), F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def best_of(rows: DataFrame, key: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The best row of each key by score, then the least ``ties``; combined before the shuffle."""
    best = F.min(F.struct((-F.coalesce(F.col(score), F.lit(float("-inf")))).alias("_s"), *ties)).alias("b")
    return rows.groupBy(*key).agg(best, F.count(F.lit(1)).alias("n_rows")).select(*key, F.when(F.col("b._s") < float("inf"), -F.col("b._s")).alias(score), *[F.col(f"b.{t}").alias(t) for t in ties], "n_rows")


def record_bytes(rows: DataFrame, kind: str, columns: Sequence[str]) -> DataFrame:
    """One row: kind, n_rows and the bytes of the texts in ``columns``."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes")).select(F.lit(kind).alias("kind"), "n_rows", "n_bytes")


def violations(relations: DataFrame) -> DataFrame:
    """How many relations break a rule that every answer must keep: rule, n_relations; rules that none breaks give no row."""
    rules = {
        "no source": F.col("from_id").isNull(), "no target": F.col("to_id").isNull(), "no type": F.col("relation").isNull(), "confidence out of range": ~F.coalesce(F.col("confidence").between(0, 1) & (F.col("confidence") > 0), F.lit(False)),
        "points at itself": F.coalesce(F.col("from_id") == F.col("to_id"), F.lit(False)), "no warning codes": F.col("warning_codes").isNull(), "no resolution": F.col("resolution").isNull(),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    return relations.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_relations"))


def supported(relations: DataFrame, languages: DataFrame) -> DataFrame:
    """Relations whose source's language (endpoint_id, language) supports their type; a type without a list is supported by all."""
    listed = [(r, lang) for r, langs in CAPABILITIES.items() for lang in langs]
    table = relations.sparkSession.createDataFrame(listed, "relation string, language string")
    limited = F.col("relation").isin(*[r for r, langs in CAPABILITIES.items() if langs])
    named = relations.join(languages.select(F.col("endpoint_id").alias("from_id"), "language"), "from_id")
    held = named.join(F.broadcast(table.withColumn("listed", F.lit(True))), ["relation", "language"], "left")
    return held.where(~limited | F.coalesce("listed", F.lit(False))).drop("listed")


def capabilities(spark) -> DataFrame:
    """(language, relation) of what is supported by name."""
    return spark.createDataFrame([(lang, r) for r, langs in CAPABILITIES.items() for lang in langs], "language string, relation string")


def impact_sections(callers: DataFrame, endpoints: DataFrame, limit: int = 15) -> DataFrame:
    """The first ``limit`` callers of each focus (focus_id, caller_id, depth, via) by depth, path, line, name and id, with the totals before the limit."""
    named = callers.join(endpoints.select(F.col("endpoint_id").alias("caller_id"), "file_path", "start_line", "endpoint_name"), "caller_id")
    totals = named.groupBy("focus_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("depth") == 1).alias("direct"))
    order = Window.partitionBy("focus_id").orderBy("depth", "file_path", "start_line", "endpoint_name", "caller_id")
    parts = Window.partitionBy("focus_id", F.pmod(F.xxhash64("caller_id"), F.lit(16))).orderBy("depth", "file_path", "start_line", "endpoint_name", "caller_id")
    first = named.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= limit).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return first.join(totals, "focus_id").select("focus_id", "rank", "total", "direct", (F.col("total") > limit).alias("truncated"), "caller_id", "depth", "via")


def definitions(endpoints: DataFrame) -> DataFrame:
    """Names that several endpoints have, with each in order of path, line and id: what is shown instead of an answer to an ambiguous name."""
    named = endpoints.where("endpoint_name IS NOT NULL AND NOT coalesce(is_external, false)").withColumn("name", F.lower("endpoint_name"))
    counted = named.groupBy("name").agg(F.count(F.lit(1)).alias("n_definitions")).where("n_definitions > 1")
    order = Window.partitionBy("name").orderBy("file_path", "start_line", "endpoint_id")
    return named.join(counted, "name").withColumn("rank", F.row_number().over(order)).select("name", "n_definitions", "rank", "endpoint_id", "endpoint_kind", "file_path", "start_line")
