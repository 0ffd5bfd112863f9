"""Problem 7: mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.tokenizer import DEFAULT_VOCABULARY, n_tokens

BUCKET_DOCS = 20_000


def source_key(source: Column) -> Column:
    """A source's name without letter case, surrounding blanks and the choice of ``-`` or ``_``."""
    return F.lower(F.regexp_replace(F.trim(source), "-", "_"))


def clean_targets(targets: DataFrame) -> DataFrame:
    """One row a named source: source, target_share, max_repeats. Rows with nulls or no positive share are left out; spellings of one source add up."""
    return (
        targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )


def balance(histogram: DataFrame, targets: list, total: float | None, rounds: int = 200, tolerance: float = 1e-9) -> tuple[dict[str, float], float]:
    """The dual of entropy balancing: a multiplier for each source, and the size of the mix.

    Rates w minimise sum w (ln w - 1) subject to sum over a source of w t =
    its token target and w <= max_repeats. The solution is exponentially
    tilted, w = min(max_repeats, exp(lambda t / mean)); lambda solves one convex
    problem a source. Each Newton round is one distributed aggregation over
    ``histogram`` (source, tokens, n); only sums a source reach the driver.
    A bracket keeps each round safe: a step that leaves it becomes a bisection.
    """
    have = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.sum("n").alias("docs")).collect()}
    goals = {r["source"]: r for r in targets if r["source"] in have and have[r["source"]]["tokens"] > 0}
    if not goals:
        return {}, 0.0
    share = sum(r["target_share"] for r in goals.values())
    most = min(r["max_repeats"] * have[s]["tokens"] * share / r["target_share"] for s, r in goals.items())
    total = most if total is None else min(float(total), most)
    wanted = {s: total * r["target_share"] / share for s, r in goals.items()}
    mean = {s: have[s]["tokens"] / have[s]["docs"] for s in goals}
    scaled = F.col("tokens") / F.col("mean")
    lam = {s: 0.0 for s in goals}
    low, high = {s: -700.0 for s in goals}, {s: 700.0 for s in goals}
    open_ = {s for s in goals if wanted[s] < goals[s]["max_repeats"] * have[s]["tokens"] * (1 - 1e-12)}
    for s in set(goals) - open_:
        lam[s] = 1e9  # every document at the cap
    spark = histogram.sparkSession
    for _ in range(rounds):
        if not open_:
            break
        now = spark.createDataFrame([(s, lam[s], float(goals[s]["max_repeats"]), mean[s]) for s in open_], "source string, lam double, cap double, mean double")
        raw = F.exp(F.least(F.col("lam") * scaled, F.lit(60.0)))
        sums = (
            histogram.join(F.broadcast(now), "source")
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("tokens") * F.least(raw, F.col("cap"))).alias("got"),
                F.sum(F.when(raw < F.col("cap"), F.col("n") * F.col("tokens") * scaled * raw).otherwise(0.0)).alias("slope"),
            )
            .collect()
        )
        for r in sums:
            s, gap = r["source"], wanted[r["source"]] - r["got"]
            if abs(gap) <= tolerance * max(wanted[s], 1.0):
                open_.discard(s)
                continue
            if gap > 0:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            step = lam[s] + gap / r["slope"] if r["slope"] > 0 else None
            lam[s] = step if step is not None and low[s] < step < high[s] else (low[s] + high[s]) / 2 if low[s] > -700 and high[s] < 700 else lam[s] + (1.0 if gap > 0 else -1.0)
    if open_:
        raise ArithmeticError(f"the rates of {sorted(open_)} don't settle in {rounds} rounds")
    return lam, total


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """How often each document enters the mix: doc_id, source, n_tokens, rate, copies (copies > 0 only).

    ``total`` is the size in tokens; by default the largest at which every
    source present reaches its share within max_repeats. A source without
    documents can't contribute: its share is spread over the others in
    proportion and shows as 0 in the report. Documents whose source has no
    target, or is null, stay out, as do texts without tokens. Copies of equal
    documents are documents of their own.

    Rates become whole copies by systematic rounding: along the order of size
    in each hashed bucket of a source, a document gets the whole steps that
    the running rate passes there, so a bucket's copies differ from its rates
    by less than one and small and large documents are hit evenly.
    Buckets hold about ``BUCKET_DOCS`` documents, whatever a source's size.
    """
    goals = clean_targets(targets)
    sized = (
        documents.select("doc_id", source_key(F.col("source")).alias("source"), "text")
        .join(F.broadcast(goals.select("source")), "source", "left_semi")
        .select("doc_id", "source", n_tokens(F.col("text"), vocabulary).alias("n_tokens"))
        .where("n_tokens > 0")
        .persist()
    )
    histogram = sized.groupBy("source", F.col("n_tokens").alias("tokens")).agg(F.count(F.lit(1)).alias("n")).persist()
    wanted = goals.limit(100_001).collect()  # one row a named source
    if len(wanted) > 100_000:
        raise ValueError("more than 100,000 sources with a target")
    lam, _ = balance(histogram, wanted, total)
    docs = {r["source"]: (r["n"], r["t"] / r["n"]) for r in histogram.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tokens")).alias("t")).collect()}
    caps = {r["source"]: float(r["max_repeats"]) for r in wanted}
    rows = [(s, x, caps[s], docs[s][1], 1 + docs[s][0] // BUCKET_DOCS) for s, x in lam.items()]
    tilt = sized.sparkSession.createDataFrame(rows, "source string, lam double, cap double, mean double, buckets bigint")
    rated = sized.join(F.broadcast(tilt), "source").select(
        "doc_id",
        "source",
        "n_tokens",
        F.least(F.col("cap"), F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("mean"), F.lit(60.0)))).alias("rate"),
        F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.col("buckets")).alias("bucket"),
        F.xxhash64("doc_id").alias("place"),
    )
    along = Window.partitionBy("source", "bucket").orderBy("n_tokens", "place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("rate").over(along)
    # 1e-9: sums of whole rates must not fall just short of a whole step
    return (
        rated.withColumn("upto", upto)
        .withColumn("copies", (F.floor(F.col("upto") + F.lit(0.5 + 1e-9)) - F.floor(F.col("upto") - F.col("rate") + F.lit(0.5 + 1e-9))).cast("int"))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), "copies")
    )


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached: source, target_share, max_repeats, n_docs, n_copies, n_tokens, actual_share; one row a target, present or not."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies")
    )
    whole = got.agg(F.sum("n_tokens").alias("all_tokens"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_docs", "n_copies", "n_tokens", "most_copies")]
    share = F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0))
    return clean_targets(targets).join(F.broadcast(got), "source", "left").join(F.broadcast(whole)).select("source", "target_share", "max_repeats", *zero, F.round(share, 6).alias("actual_share"))
