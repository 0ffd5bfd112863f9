"""The graph as lines of JSON: header, files and symbols, relations and externals, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.relations import file_id
from codeweft.operators.reports import completeness_level

SCHEMA_VERSION = "1.1"
#: Relation types of the profiles (fixed values).
RELATION_SET = (
    "DEFINES", "CONTAINS", "ACCESSES", "ASYNC_CALLS", "CALLS", "CONFIGURES", "CONSTRUCTS", "DATA_FLOWS", "EMITS", "EXTENDS", "FILE_CHANGES_WITH", "HANDLES_GRAPHQL", "HANDLES_GRPC", "HANDLES_ROUTE", "HANDLES_TOOL", "HANDLES_TRPC",
    "HTTP_CALLS", "IMPLEMENTS", "IMPORTS", "INHERITS", "LISTENS_ON", "OVERRIDES", "PARAM_TYPE", "READS_FIELD", "RESOURCE_DEPENDS_ON", "RETURNS_TYPE", "SIMILAR_TO", "TESTS", "USES_TYPE", "WRITES_FIELD",
)
FAST_SET = ("DEFINES", "CONTAINS", "IMPORTS", "CALLS", "CONSTRUCTS", "ASYNC_CALLS", "HANDLES_ROUTE", "HANDLES_GRPC", "HANDLES_GRAPHQL", "HANDLES_TRPC", "HANDLES_TOOL", "HTTP_CALLS", "EMITS", "LISTENS_ON", "CONFIGURES", "RESOURCE_DEPENDS_ON")
MODES = {"snapshot": ("file", "symbol", "external", "relation"), "symbols": ("file", "symbol"), "edges": ("external", "relation")}


def snapshot_stats(facts: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: repo_key, languages, stats, completeness, warnings and partial failures of a snapshot."""
    files = facts.where("fact = 'file'").agg(F.min("repo_key").alias("repo_key"), F.count(F.lit(1)).alias("files"), F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias("languages"))
    failures = facts.where("fact = 'failure'")
    failed = failures.agg(F.count_if(F.col("kind") != "E_UNSUPPORTED_LANGUAGE").alias("partial_failures"), F.count(F.lit(1)).alias("unread"))
    kinds = failures.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.struct(F.col("kind").alias("code"), F.when(F.col("kind") == "E_UNSUPPORTED_LANGUAGE", "info").otherwise("warning").alias("severity"), F.col("n").alias("files")).alias("w")).agg(F.sort_array(F.collect_list("w")).alias("warnings"))
    per = facts.where("fact = 'file' AND language <> ''").groupBy("language").agg(F.count(F.lit(1)).alias("files")).join(symbols.groupBy("language").agg(F.count(F.lit(1)).alias("symbols")), "language", "left")
    languages = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", F.struct("files", F.coalesce("symbols", F.lit(0)).alias("symbols")))))).alias("by_language"))
    types = relations.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation", "n")))).alias("by_relation"), F.coalesce(F.sum("n"), F.lit(0)).alias("relations"))
    counted = symbols.agg(F.count(F.lit(1)).alias("symbols"))
    row = files
    for part in (failed, kinds, languages, types, counted):  # one row each
        row = row.join(F.broadcast(part))
    parsed = F.col("files") - F.col("unread")
    level = completeness_level(F.col("partial_failures"), F.col("files"), parsed, F.col("symbols")).alias("completeness_level")
    return row.select(
        "repo_key", "languages", F.struct("files", parsed.alias("parsed_files"), "symbols", "relations", "partial_failures", level).alias("stats"),
        F.struct(F.col("by_language").alias("languages"), F.col("by_relation").alias("relations")).alias("completeness"), "warnings",
    )


def record_lines(facts: DataFrame, symbols: DataFrame, relations: DataFrame, mode: str = "snapshot", profile: str = "full") -> DataFrame:
    """(section, key, value): one JSON text a record, in the order section, key. Null fields are left out."""
    wanted = MODES[mode]
    files = facts.where("fact = 'file'").select(file_id(F.col("repo_key"), F.col("file_path")).alias("id"), F.col("file_path").alias("path"), F.col("body_hash").alias("blob"), "language", F.col("start_line").alias("bytes"))
    external = relations.where("to_id LIKE 'external:%'").select(F.col("to_id").alias("id"), F.split("to_id", ":", 3)[1].alias("kind"), F.split("to_id", ":", 3)[2].alias("value"), "evidence").groupBy("id", "kind", "value").agg(F.min(F.element_at("evidence", 1)).alias("e"))
    inside = F.col("kind").isin("import", "symbol")
    external = external.select("id", "kind", "value", inside.alias("external"), *[F.when(~inside, F.col(f"e.{c}")).alias(c) for c in ("file_path", "start_line", "end_line")])
    edge = relations.withColumnRenamed("relation", "type").drop("repo_key")
    own = symbols.withColumnRenamed("symbol_id", "id").withColumn("stable_id_version", F.lit("compound-v1"))
    parts = {"file": (1, files, F.col("id")), "symbol": (1, own.drop("body"), F.col("id")), "external": (2, external, F.col("id")), "relation": (2, edge, F.concat("type", "from_id", "to_id"))}
    stats = snapshot_stats(facts, symbols, relations).persist()
    kinds = F.array(*map(F.lit, RELATION_SET if profile == "full" else FAST_SET if profile == "fast" else FAST_SET[:2]))
    skipped = F.array_except(F.array(*map(F.lit, RELATION_SET)), kinds)
    limits = F.struct(F.lit("symbol").alias("evidence"), F.lit("full" if profile == "full" else "shallow").alias("call_resolution"))
    head = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("codeweft").alias("provider"), "repo_key", "languages", F.lit(profile).alias("profile"), limits.alias("profile_limits"), kinds.alias("relation_set"), skipped.alias("skipped_relation_families"), "warnings", "stats", "completeness")
    out = stats.select(F.lit(0).alias("section"), F.lit("").alias("key"), F.to_json(head).alias("value"))
    for name in wanted:
        section, rows, key = parts[name]
        out = out.unionByName(rows.select(F.lit(section).alias("section"), F.concat(F.lit(name + " "), key).alias("key"), F.to_json(F.struct(F.lit(name).alias("record_type"), *rows.columns)).alias("value")))
    return out.unionByName(stats.select(F.lit(3).alias("section"), F.lit("").alias("key"), F.to_json(F.struct(F.lit("summary").alias("record_type"), "stats", "completeness")).alias("value")))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Writes the lines as text files whose names sort in the records' order."""
    lines.orderBy("section", "key").select("value").write.mode("overwrite").text(folder)
