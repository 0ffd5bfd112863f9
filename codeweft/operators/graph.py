"""Questions about a code graph: endpoints and typed relations between them.

Endpoints: endpoint_id, endpoint_name, qualified_name, endpoint_kind,
file_path, start_line, is_external. Relations: from_id, to_id, relation,
confidence, reason, resolution. Rows may repeat; ids may lack an endpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import CALL_RELATIONS, CENTRAL_RELATIONS, confidence_band, endpoint_tier, is_test_path, resolution_tier
from codeweft.tables import cut, small

ENDPOINT = ["endpoint_id", "endpoint_name", "qualified_name", "endpoint_kind", "file_path", "start_line", "is_external"]
EDGE = ["from_id", "to_id", "relation"]


def merge_endpoints(*tables: DataFrame) -> DataFrame:
    """One row an endpoint id: the union of ``tables``, repeats folded to the least value of each column that isn't null."""
    both = tables[0].select(*ENDPOINT)
    for t in tables[1:]:
        both = both.unionByName(t.select(*ENDPOINT))
    return both.where("endpoint_id IS NOT NULL").groupBy("endpoint_id").agg(*[F.min(c).alias(c) for c in ENDPOINT[1:]])


def distinct_relations(relations: DataFrame) -> DataFrame:
    """One row an edge (from_id, to_id, relation): the most confident, then the least resolution and reason. Edges with a null end are dropped."""
    kept = relations.where("from_id IS NOT NULL AND to_id IS NOT NULL AND relation IS NOT NULL")
    tie = F.min(F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), resolution_tier(F.col("resolution")).alias("t"), "resolution", "reason")).alias("b")
    return kept.groupBy(*EDGE).agg(tie).select(*EDGE, F.when(F.col("b.c") <= 0, -F.col("b.c")).alias("confidence"), "b.resolution", "b.reason")


def edge_filter(relations: DataFrame, source: str | None = None, target: str | None = None, relation: str | None = None) -> DataFrame:
    """Edges whose ends match a selector (the id, or its end after a colon) and whose type is ``relation``."""

    def match(column: str, selector: str) -> Column:
        return (F.col(column) == selector) | F.col(column).endswith(":" + selector)

    out = relations
    if source:
        out = out.where(match("from_id", source))
    if target:
        out = out.where(match("to_id", target))
    return out.where(F.col("relation") == relation) if relation else out


def focus(endpoints: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    """Endpoints called ``name``, by name or qualified name without letter case, in a file if one is given."""
    wanted = name.lower()
    found = endpoints.where((F.lower("endpoint_name") == wanted) | (F.lower("qualified_name") == wanted))
    return found.where(F.col("file_path") == file_path) if file_path else found


def incident(relations: DataFrame, focuses: DataFrame) -> DataFrame:
    """Edges into and out of each focus (focus_id): focus_id, direction, other_id and the relation's columns."""
    keys = small(focuses.select(F.col("endpoint_id").alias("focus_id")).distinct())
    rest = ["relation", "confidence", "resolution", "reason"]
    into = relations.join(keys, relations.to_id == F.col("focus_id")).select("focus_id", F.lit("in").alias("direction"), F.col("from_id").alias("other_id"), *rest)
    out = relations.join(keys, relations.from_id == F.col("focus_id")).select("focus_id", F.lit("out").alias("direction"), F.col("to_id").alias("other_id"), *rest)
    return into.unionByName(out)


def neighbors(
    relations: DataFrame, endpoints: DataFrame, focuses: DataFrame, limit: int = 20, relation: str | None = None, internal_only: bool = False, exclude_tests: bool = False
) -> DataFrame:
    """The ``limit`` best edges of each focus and direction, with the total before the limit.

    Order: production code before tests before externals, then resolution,
    confidence, path, line, name, id, relation, resolution and reason. Edges
    to an id without an endpoint are dropped. Asking for CALLS admits
    CONSTRUCTS. The best of hashed parts are found first, so a focus with
    very many edges is ranked by many tasks.
    """
    if relation:
        relations = relations.where(F.col("relation").isin(*CALL_RELATIONS) if relation == "CALLS" else F.col("relation") == relation)
    edges = incident(relations, focuses).join(endpoints.withColumnRenamed("endpoint_id", "other_id"), "other_id")
    if internal_only:
        edges = edges.where(~F.coalesce("is_external", F.lit(False)))
    if exclude_tests:
        edges = edges.where(~is_test_path(F.col("file_path")))
    full = F.when(F.coalesce("qualified_name", F.lit("")) != "", F.col("qualified_name")).otherwise(F.col("endpoint_name"))
    ranked = edges.select(
        "*", endpoint_tier(F.coalesce("is_external", F.lit(False)), F.col("file_path")).alias("tier"), resolution_tier(F.col("resolution")).alias("resolution_tier"), full.alias("full_name")
    )
    order = ["tier", "resolution_tier", F.col("confidence").desc_nulls_last(), "file_path", "start_line", "full_name", "other_id", "relation", "resolution", "reason"]
    key = ["focus_id", "direction"]
    totals = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    part = Window.partitionBy(*key, "part").orderBy(*order)
    best = (
        ranked.withColumn("part", F.pmod(F.xxhash64("other_id", "relation"), F.lit(32)))
        .withColumn("rank", F.row_number().over(part))
        .where(F.col("rank") <= limit)
        .withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        .where(F.col("rank") <= limit)
    )
    return best.join(totals, key).select(*key, "rank", "total", "other_id", "relation", "confidence", "resolution", F.col("endpoint_kind").alias("other_kind"), "file_path")


def two_hop_paths(relations: DataFrame, focuses: DataFrame, limit: int = 20) -> DataFrame:
    """caller -> focus -> callee: the first ``limit`` of each focus by caller and callee.

    The first of the product are made of the first callers and callees, so
    each side is cut to ``limit`` before they are combined.
    """
    edges = incident(relations.where(F.col("relation").isin(*CALL_RELATIONS)), focuses).where("other_id IS NOT NULL").select("focus_id", "direction", "other_id").distinct()
    first = edges.withColumn("n", F.row_number().over(Window.partitionBy("focus_id", "direction").orderBy("other_id"))).where(F.col("n") <= limit)
    callers = first.where("direction = 'in'").select("focus_id", F.col("other_id").alias("caller_id"))
    callees = first.where("direction = 'out'").select("focus_id", F.col("other_id").alias("callee_id"))
    paths = callers.join(callees, "focus_id")
    order = Window.partitionBy("focus_id").orderBy("caller_id", "callee_id")
    return paths.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def impact(relations: DataFrame, focuses: DataFrame, depth: int = 2, types: Sequence[str] = ("CALLS", "ASYNC_CALLS", "CONSTRUCTS")) -> DataFrame:
    """Who calls a focus, directly or through others: focus_id, caller_id, depth (the least), via (the least id it goes through).

    Breadth first, ``depth`` rounds (unrolled joins); a focus doesn't call itself.
    """
    calls = relations.where(F.col("relation").isin(*types) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select("from_id", "to_id").distinct()
    start = focuses.select(F.col("endpoint_id").alias("focus_id")).distinct()
    seen = start.select("focus_id", F.col("focus_id").alias("caller_id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    frontier = seen
    for step in range(1, depth + 1):
        reached = (
            small(frontier.select("focus_id", F.col("caller_id").alias("to_id")))
            .join(calls, "to_id")
            .groupBy("focus_id", F.col("from_id").alias("caller_id"))
            .agg(F.min("to_id").alias("via"))
            .join(seen.select("focus_id", "caller_id"), ["focus_id", "caller_id"], "left_anti")
        )
        frontier = cut(reached.select("focus_id", "caller_id", F.lit(step).alias("depth"), "via"))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def impact_totals(callers: DataFrame) -> DataFrame:
    """Direct, transitive and all callers of each focus."""
    return callers.groupBy("focus_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))


def inbound_degree(relations: DataFrame) -> DataFrame:
    """Edges into each endpoint over the calling and inheriting relations, and the bonus for search: min(6, 1.6 ln(1 + degree))."""
    counted = relations.where(F.col("relation").isin(*CENTRAL_RELATIONS) & F.col("to_id").isNotNull()).groupBy("to_id").agg(F.count(F.lit(1)).alias("degree"))
    return counted.withColumn("bonus", F.round(F.least(F.lit(6.0), 1.6 * F.log1p("degree")), 4))


def confidence_report(relations: DataFrame) -> DataFrame:
    """Relations by type, resolution and band of confidence."""
    return relations.where("relation IS NOT NULL").groupBy("relation", "resolution", confidence_band(F.coalesce("confidence", F.lit(0.0))).alias("band")).agg(F.count(F.lit(1)).alias("n_relations"))


def language_rollup(endpoints: DataFrame) -> DataFrame:
    """Endpoints by kind and in all (kind null), files and symbols apart; externals don't count."""
    own = endpoints.where("NOT coalesce(is_external, false)")
    return own.rollup("endpoint_kind").agg(F.count(F.lit(1)).alias("n_endpoints"), F.count_distinct("file_path").alias("n_files")).where("endpoint_kind IS NOT NULL OR n_endpoints > 0")


def members(endpoints: DataFrame, focuses: DataFrame, container: str = "file_path") -> DataFrame:
    """Endpoints of the same ``container`` as each focus, by default the file: focus_id, member_id. A null container holds nothing."""
    keys = small(focuses.where(F.col(container).isNotNull()).select(F.col("endpoint_id").alias("focus_id"), container).distinct())
    return endpoints.join(keys, container).where(F.col("endpoint_id") != F.col("focus_id")).select("focus_id", F.col("endpoint_id").alias("member_id"))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For each point (point_id, space, at) the smallest span (span_id, space, low, high) that holds it; the later begin on a tie.

    Spans are laid on blocks of the size of their own length's power of two,
    so a point meets only spans that may hold it.
    """
    sized = spans.where("low <= high").withColumn("level", F.ceil(F.log2(F.col("high") - F.col("low") + 1)).cast("int"))
    step = F.pow(F.lit(2.0), F.col("level"))
    laid = sized.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor(F.col("high") / step))))
    levels = [r["level"] for r in sized.select("level").distinct().collect()]  # powers of two that occur: some dozens at most
    asked = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("block", F.floor(F.col("at") / F.pow(F.lit(2.0), F.col("level"))))
    hit = asked.join(laid, ["space", "level", "block"]).where(F.col("at").between(F.col("low"), F.col("high")))
    best = F.min_by("span_id", F.struct(F.col("high") - F.col("low"), -F.col("low"), "span_id"))
    return hit.groupBy("point_id").agg(best.alias("span_id"))


def adjacent(rows: DataFrame, container: Sequence[str], order: Sequence[str], item: str) -> DataFrame:
    """The sibling before and after each item in its container."""
    along = Window.partitionBy(*container).orderBy(*order)
    return rows.select(*container, item, F.lag(item).over(along).alias("before"), F.lead(item).over(along).alias("after"))


def islands(rows: DataFrame, key: Sequence[str], at: str, gap: int) -> DataFrame:
    """Runs of ``at`` with steps of at most ``gap``: key, low, high, n_rows."""
    along = Window.partitionBy(*key).orderBy(at)
    fresh = F.coalesce(F.col(at) - F.lag(at).over(along) > gap, F.lit(True)).cast("int")
    return (
        rows.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "island")
        .agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(F.lit(1)).alias("n_rows"))
        .drop("island")
    )
