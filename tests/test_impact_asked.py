from codeweft.plans import graph_queries
from pyspark.sql import functions as F


def test_impact_of_ordinary_symbols(spark):
    d = "/root/testdata/sf0.001"
    shared = {r.endpoint_id for r in spark.read.parquet(f"{d}/shared_endpoints.parquet").collect()}
    asked = {r.endpoint_id for r in spark.read.parquet(f"{d}/endpoints.parquet").where(F.pmod(F.xxhash64("endpoint_id"), F.lit(20)) == 0).select("endpoint_id").collect()}
    calls: dict[str, set[str]] = {}
    for r in spark.read.parquet(f"{d}/relations.parquet").where("relation IN ('CALLS', 'ASYNC_CALLS', 'CONSTRUCTS') AND from_id IS NOT NULL AND to_id IS NOT NULL").collect():
        calls.setdefault(r.to_id, set()).add(r.from_id)
    want = {}
    for focus in (shared | asked) - {None}:
        direct = calls.get(focus, set()) - {focus}
        further = {c for x in direct for c in calls.get(x, ())} - direct - {focus}
        want |= {(focus, c): 1 for c in direct} | {(focus, c): 2 for c in further}
    got = {(r.focus_id, r.caller_id): r.depth for r in graph_queries.impact_asked(spark, d).collect()}
    assert got == want and {f for f, _ in got} - shared
    assert sum(r.total for r in graph_queries.impact_asked_totals(spark, d).collect()) == len(got)
