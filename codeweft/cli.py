"""Commands over a folder of source files: ``python -m codeweft.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import codeweft
from codeweft import render
from codeweft.operators import entity_diff, graph, ranked_search, reports, search
from codeweft.sources import cache, git, parse
from codeweft.sources.ignore import without_vendored

FILE = "repo_key string, file_path string, content string"


def session() -> SparkSession:
    return SparkSession.builder.appName("codeweft").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def worktree(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder: repo_key, file_path, content; ignored, vendored and binary ones are left out."""
    return git.source_tree(spark, folder).select(F.lit(f"local/{os.path.basename(os.path.abspath(folder))}").alias("repo_key"), "file_path", "content")


def revision(spark: SparkSession, folder: str, rev: str) -> DataFrame:
    """Files of a revision."""
    blobs = git.read_blobs(without_vendored(git.list_tree(spark, folder, rev)), folder, rev).where("content IS NOT NULL")
    return blobs.select(F.lit(f"local/{os.path.basename(os.path.abspath(folder))}").alias("repo_key"), "file_path", "content")


def _tables(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    held, _ = cache.load_or_build(worktree(spark, a.folder), parse.facts, a.cache or f"{a.folder}/.codeweft", a.profile)
    n = held["files"].count()
    failed, symbols = held["failures"].count(), held["symbols"].count()
    level = spark.range(1).select(reports.completeness_level(F.lit(failed), F.lit(n), F.lit(n - failed), F.lit(symbols)).alias("v")).first().v
    banner = render.coverage_banner(n, n - failed, level)
    if banner:
        print(banner, file=sys.stderr)
    return held


def _endpoints(held: dict[str, DataFrame]) -> DataFrame:
    own = held["symbols"].select(F.col("symbol_id").alias("endpoint_id"), F.col("name").alias("endpoint_name"), "qualified_name", F.col("kind").alias("endpoint_kind"), "file_path", "start_line", F.lit(False).alias("is_external"))
    outside = held["relations"].where("to_id LIKE 'external:%'").select(F.col("to_id").alias("endpoint_id"), F.element_at(F.split("to_id", ":", 3), 3).alias("endpoint_name"), F.lit(None).cast("string").alias("qualified_name"), F.element_at(F.split("to_id", ":", 3), 2).alias("endpoint_kind"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("start_line"), F.lit(True).alias("is_external"))
    return graph.merge_endpoints(own, outside)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run_index(spark: SparkSession, a: argparse.Namespace) -> str:
    held, there = cache.load_or_build(revision(spark, a.folder, "HEAD"), parse.facts, a.cache or f"{a.folder}/.codeweft", a.profile)
    return render.as_json({"built": not there, "files": held["files"].count(), "symbols": held["symbols"].count(), "relations": held["relations"].count()}) + "\n"


def run_search(spark: SparkSession, a: argparse.Namespace) -> str:
    held = _tables(spark, a)
    files = worktree(spark, a.folder).selectExpr("file_path AS doc_id", "file_path AS path", "content AS body")
    queries = search.build_queries(spark.createDataFrame([("1", a.text)], "query_id string, text string"))
    if queries.isEmpty():
        raise SystemExit("query contains no meaningful terms")
    found = ranked_search.search_tree(files, held["symbols"].withColumnRenamed("file_path", "doc_id"), held["relations"], queries, a.top_k)
    rows = render.fit(_rows(found.orderBy("rank")), a.bytes)
    return {"text": render.search_text, "lines": render.as_lines, "agent": render.search_agent}.get(a.format, lambda r: render.as_json(r) + "\n")(rows)


def run_neighbors(spark: SparkSession, a: argparse.Namespace) -> str:
    held = _tables(spark, a)
    ends = _endpoints(held)
    focus = graph.focus(ends, a.name, a.file)
    rows = _rows(focus.orderBy("file_path", "start_line", "endpoint_id"))
    if len(rows) > 1:
        return render.ambiguous_text(a.name, rows)
    found = _rows(graph.neighbors(held["relations"], ends, focus, a.limit, a.relation, a.internal, a.no_tests).orderBy("direction", "rank"))
    return render.as_json(found) + "\n" if a.format == "json" else render.neighbors_text(a.name, found, a.bytes)


def run_impact(spark: SparkSession, a: argparse.Namespace) -> str:
    held = _tables(spark, a)
    ends = _endpoints(held)
    rows = _rows(reports.impact_sections(graph.impact(held["relations"], graph.focus(ends, a.name, a.file), a.depth), ends, a.limit).orderBy("focus_id", "rank"))
    return render.as_json(rows) + "\n" if a.format == "json" else render.impact_text({"callers": rows}, a.bytes)


def run_diff(spark: SparkSession, a: argparse.Namespace) -> str:
    head = a.head or "HEAD"
    base = a.base or git.first_parent(a.folder, head)
    changes, warnings = entity_diff.within_budget(revision(spark, a.folder, base), revision(spark, a.folder, head), parse.facts, a.seconds, batches=1)
    for w in warnings.collect():
        print(f"{w.code}: {w.file_path}", file=sys.stderr)
    rows = _rows(changes)
    return render.as_json(rows) + "\n" if a.format == "json" else render.diff_text(rows, a.color)


def run_snapshot(spark: SparkSession, a: argparse.Namespace) -> str:
    held = _tables(spark, a)
    wanted = {"snapshot": ("files", "symbols", "relations"), "symbols": ("files", "symbols"), "edges": ("relations",)}[a.mode]
    return "".join(render.as_lines({"table": name, **r} for r in held[name].toLocalIterator() for r in [r.asDict(recursive=True)]) for name in wanted)


def run_capabilities(spark: SparkSession, a: argparse.Namespace) -> str:
    return render.as_json({r: list(langs) or "all" for r, langs in reports.CAPABILITIES.items()}) + "\n"


def run_version(spark: SparkSession, a: argparse.Namespace) -> str:
    return f"codeweft {codeweft.__version__}, Spark {spark.version}\n"


COMMANDS = {"index": run_index, "search": run_search, "neighbors": run_neighbors, "impact": run_impact, "diff": run_diff, "snapshot": run_snapshot, "capabilities": run_capabilities, "version": run_version}


def arguments(given: Sequence[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="codeweft")
    parts = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = parts.add_parser(name)
        p.add_argument("--folder", default=".")
        p.add_argument("--cache")
        p.add_argument("--profile", default="full", choices=("full", "fast", "syntax-only"))
        p.add_argument("--format", default="text", choices=("text", "json", "lines", "agent"))
        p.add_argument("--bytes", type=int, default=16 * 1024)
        p.add_argument("--limit", type=int, default=20)
        if name == "search":
            p.add_argument("text")
            p.add_argument("--top-k", type=int, default=ranked_search.TOP_K)
        elif name in ("neighbors", "impact"):
            p.add_argument("name")
            p.add_argument("--file")
            p.add_argument("--relation")
            p.add_argument("--internal", action="store_true")
            p.add_argument("--no-tests", action="store_true")
            p.add_argument("--depth", type=int, default=2)
        elif name == "diff":
            p.add_argument("base", nargs="?")
            p.add_argument("head", nargs="?")
            p.add_argument("--seconds", type=float, default=120)
            p.add_argument("--color", action="store_true")
        elif name == "snapshot":
            p.add_argument("mode", nargs="?", default="snapshot", choices=("snapshot", "symbols", "edges"))
    return top.parse_args(given)


def run(spark: SparkSession, given: Sequence[str]) -> str:
    """What a command prints. All jobs of a command are one group, which an interrupt cancels."""
    a = arguments(given)
    spark.sparkContext.setJobGroup("codeweft", json.dumps(list(given)), interruptOnCancel=True)
    try:
        return COMMANDS[a.command](spark, a)
    except KeyboardInterrupt:
        spark.sparkContext.cancelJobGroup("codeweft")
        raise
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


if __name__ == "__main__":
    print(run(session(), sys.argv[1:]), end="")
