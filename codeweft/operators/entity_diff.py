"""What changed between two versions of a set of entities: pairing, classes, renames, moves, dependents."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import signature_jaccard
from codeweft.tables import collapse_blanks, cut, short_hash, small

RENAME, MOVE, MARGIN = 0.92, 0.92, 0.05
FACTS = ["signature", "body_hash", "fingerprint"]


def _pair(before: DataFrame, after: DataFrame, space: Sequence[str], by: Sequence[str], unique: bool, needs: Sequence[str]) -> DataFrame:
    """Pairs (before_id, after_id) of equal ``by``: in order of pos, or only where either side has one."""
    key = [*space, "kind", "name", *by]

    def side(rows: DataFrame, name: str) -> DataFrame:
        for column in needs:
            rows = rows.where(F.coalesce(F.col(column), F.lit("")) != "")
        alone = Window.partitionBy(*key)
        numbered = rows.withColumn("n", F.row_number().over(alone.orderBy("pos", "id"))).withColumn("of", F.count(F.lit(1)).over(alone))
        return (numbered.where("of = 1") if unique else numbered).select(*key, "n", F.col("id").alias(name))

    left, right = side(before, "before_id"), side(after, "after_id").toDF(*[f"r_{c}" for c in key], "r_n", "after_id")
    same = [left[c].eqNullSafe(right[f"r_{c}"]) for c in key] + [left["n"] == right["r_n"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return left.join(right, condition).select("before_id", "after_id")


def pair_entities(before: DataFrame, after: DataFrame, space: Sequence[str] = ("file_path",)) -> DataFrame:
    """One-to-one pairs (before_id, after_id) of entities of the same space, kind and name.

    Entities: id, pos, space columns, kind, name, signature, body_hash,
    fingerprint. Where either side has one of the name, the two are a pair.
    The rest goes through tiers: equal in all, in signature and one hash, in
    signature; then hashes that are unique on both sides; then in order. Each
    tier sees only what the ones before it left.
    """
    key = [*space, "kind", "name"]
    count = lambda rows, n: rows.groupBy(*key).agg(F.count(F.lit(1)).alias(n), F.min("id").alias(n + "_id"))
    left, right = count(before, "nb"), count(after, "na").toDF(*[f"r_{c}" for c in key], "na", "na_id")
    same = reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[f"r_{c}"]) for c in key])
    groups = cut(left.join(right, same))  # names of one side only have no partner
    pairs = groups.where("nb = 1 AND na = 1").select(F.col("nb_id").alias("before_id"), F.col("na_id").alias("after_id"))
    crowded = groups.where("nb > 1 OR na > 1").select(*key)
    if crowded.isEmpty():
        return pairs

    def held(rows: DataFrame) -> DataFrame:
        names = small(crowded).toDF(*[f"r_{c}" for c in key])
        return cut(rows.join(names, reduce(lambda x, y: x & y, [rows[c].eqNullSafe(names[f"r_{c}"]) for c in key]), "left_semi"))

    before, after = held(before), held(after)
    tiers = [(FACTS, False, FACTS[1:]), (["signature", "body_hash"], False, ["body_hash"]), (["signature", "fingerprint"], False, ["fingerprint"]), (["signature"], False, [])]
    tiers += [(["body_hash", "fingerprint"], True, FACTS[1:]), (["fingerprint"], True, ["fingerprint"]), (["body_hash"], True, ["body_hash"]), ([], False, [])]
    for by, unique, needs in tiers:
        found = cut(_pair(before, after, space, by, unique, needs))  # else each tier would make those before it anew
        pairs = pairs.unionByName(found)
        before = cut(before.join(found.select(F.col("before_id").alias("id")), "id", "left_anti"))
        after = cut(after.join(found.select(F.col("after_id").alias("id")), "id", "left_anti"))
    return pairs


def similarity(a: str, b: str) -> Column:
    """1 for equal fingerprints, 0.97 for equal bodies, else the overlap of the signatures; ``a`` and ``b`` are prefixes."""
    same = lambda c: (F.col(a + c) == F.col(b + c)) & (F.col(a + c) != "")
    return F.when(same("fingerprint"), 1.0).when(same("body_hash"), 0.97).otherwise(signature_jaccard(F.col(a + "signature"), F.col(b + "signature")))


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.toDF(*[prefix + c for c in rows.columns])


def _best(candidates: DataFrame, least: float) -> DataFrame:
    """Pairs (b_id, a_id, score, second) by score, then the later's position: each side is used once; second is the next score of the removed side.

    Each round takes the pairs that are best for both sides and leaves out
    what they used, until no pair is left: who loses its best is offered the
    next one.
    """
    order = [F.col("score").desc(), "a_pos", "a_name", "a_id"]
    by_old = Window.partitionBy("b_id").orderBy(*order)
    by_new = Window.partitionBy("a_id").orderBy(F.col("score").desc(), "b_pos", "b_name", "b_id")
    columns = ["b_id", "b_pos", "b_name", "a_id", "a_pos", "a_name", "score"]
    open_ = cut(candidates.where(F.col("score") >= least).select(*columns).withColumn("second", F.lead("score").over(by_old)))
    seconds = open_.groupBy("b_id").agg(F.max_by("second", F.struct("score", "second")).alias("second"))
    taken = None
    while not open_.isEmpty():
        ranked = open_.withColumn("n", F.row_number().over(by_old)).withColumn("m", F.row_number().over(by_new))
        round_ = cut(ranked.where("n = 1 AND m = 1").select("b_id", "a_id", "score"))
        taken = round_ if taken is None else taken.unionByName(round_)
        open_ = cut(open_.join(round_.select("b_id"), "b_id", "left_anti").join(round_.select("a_id"), "a_id", "left_anti"))
    return (open_.select("b_id", "a_id", "score") if taken is None else taken).join(seconds, "b_id", "left")


def _candidates(removed: DataFrame, added: DataFrame, elsewhere: bool, space: Sequence[str]) -> DataFrame:
    """Pairs that may reach the threshold, found by equal hash or equal word set, never by a product of all."""
    old, new = _prefixed(removed, "b_"), _prefixed(added, "a_")
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))))
    place = (F.col("b_file_path") != F.col("a_file_path")) if elsewhere else (F.col("b_file_path") == F.col("a_file_path"))
    kind = F.col("b_kind") == F.col("a_kind")
    for c in space:
        kind = kind & (F.col(f"b_{c}") == F.col(f"a_{c}"))
    parts = [old.join(new, kind & place & (F.col(f"b_{c}") == F.col(f"a_{c}")) & (F.col(f"b_{c}") != "")) for c in ("fingerprint", "body_hash")]
    # signatures of at most 11 words reach 0.92 only with the same words; longer ones share a word block of all but one in twelve
    sized = lambda rows, p: rows.withColumn("w", words(p + "signature")).withColumn("key", F.explode(_prefix_words("w")))
    left, right = sized(old, "b_"), sized(new, "a_").withColumnRenamed("w", "v")
    parts.append(left.join(right, kind & place & (left["key"] == right["key"])).drop("w", "v", "key"))
    columns = [*old.columns, *new.columns]
    both = parts[0].select(*columns)
    for p in parts[1:]:
        both = both.unionByName(p.select(*columns))
    return both.dropDuplicates(["b_id", "a_id"]).withColumn("score", similarity("b_", "a_"))


def _prefix_words(words: str) -> Column:
    """Prefix filter of set similarity 0.92 (less 0.005 for rounding): the first n - ceil(0.915 n) + 1 words, in one order on both sides."""
    n = F.size(words)
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.slice(words, F.lit(1), n - F.ceil(n * 0.915).cast("int") + 1))


def compare(before: DataFrame, after: DataFrame, space: Sequence[str] = ()) -> DataFrame:
    """Changes between two versions: change_kind, before_id, after_id, score, ambiguous.

    ``space`` names columns that must agree, so many comparisons run as one.
    Paired entities are signature_changed or body_changed where they differ
    and give no row where they don't. Of the rest, the best alike in the same
    file and kind are renamed, in another file moved; a move whose second
    choice is within 0.05 stays removed and added, marked ambiguous. Ties go
    to the earlier position, then the name.
    """
    pairs = cut(pair_entities(before, after, (*space, "file_path")))
    b, a = _prefixed(before, "b_"), _prefixed(after, "a_")
    both = pairs.join(b, F.col("before_id") == F.col("b_id")).join(a, F.col("after_id") == F.col("a_id"))
    sign, body = F.col("b_signature").eqNullSafe(F.col("a_signature")), F.col("b_body_hash").eqNullSafe(F.col("a_body_hash"))
    changed = both.where(~(sign & body)).select(F.when(~sign, "signature_changed").otherwise("body_changed").alias("change_kind"), "before_id", "after_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("ambiguous"))
    removed = before.join(pairs.select(F.col("before_id").alias("id")), "id", "left_anti")
    added = after.join(pairs.select(F.col("after_id").alias("id")), "id", "left_anti")
    ids = [F.col("b_id").alias("before_id"), F.col("a_id").alias("after_id"), "score"]
    renamed = cut(_best(_candidates(removed, added, False, space), RENAME).select(F.lit("renamed").alias("change_kind"), *ids, F.lit(False).alias("ambiguous")))
    gone = removed.join(renamed.select(F.col("before_id").alias("id")), "id", "left_anti")
    come = added.join(renamed.select(F.col("after_id").alias("id")), "id", "left_anti")
    best = _best(_candidates(gone, come, True, space), MOVE).withColumn("close", F.coalesce((F.col("second") >= MOVE) & (F.col("score") - F.col("second") < MARGIN), F.lit(False)))
    moved = best.where("NOT close").select(F.lit("moved").alias("change_kind"), *ids, F.lit(False).alias("ambiguous"))
    unsure = best.where("close").select(F.col("b_id").alias("id"), F.lit(True).alias("unsure"))
    null = F.lit(None).cast("double").alias("score")
    out = gone.join(moved.select(F.col("before_id").alias("id")), "id", "left_anti").join(unsure, "id", "left")
    out = out.select(F.lit("removed").alias("change_kind"), F.col("id").alias("before_id"), F.lit(None).cast(dict(after.dtypes)["id"]).alias("after_id"), null, F.coalesce("unsure", F.lit(False)).alias("ambiguous"))
    into = come.join(moved.select(F.col("after_id").alias("id")), "id", "left_anti")
    into = into.select(F.lit("added").alias("change_kind"), F.lit(None).cast(dict(before.dtypes)["id"]).alias("before_id"), F.col("id").alias("after_id"), null, F.lit(False).alias("ambiguous"))
    return changed.unionByName(renamed).unionByName(moved).unionByName(out).unionByName(into)


def dependents(names: DataFrame, blocks: DataFrame) -> DataFrame:
    """How many other blocks (block_id, own_name, body) use each name as an identifier: name, n_dependents.

    Identifiers are cut to the asked names within the scan's task before anything is shuffled.
    """
    asked = names.where("name IS NOT NULL").select("name").distinct()
    used = blocks.select("block_id", "own_name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)))).alias("name"))
    hits = used.join(small(asked), "name").where(~F.coalesce(F.col("name") == F.substring_index("own_name", ".", -1), F.lit(False)))
    return asked.join(hits.groupBy("name").agg(F.count_distinct("block_id").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_dependents"))


def entities(facts: DataFrame, version: str) -> DataFrame:
    """The symbols of a version's facts as entities to compare: id, pos, file_path, kind, name, signature, body_hash, fingerprint."""
    own = facts.where("fact = 'symbol'").groupBy("repo_key", "file_path", "kind", "qualified_name", "start_line", "signature", "body_hash").agg(F.first("body").alias("body"), F.first("name").alias("short"))
    shape = F.regexp_replace(F.coalesce("body", "signature"), F.concat(F.lit(r"\b\Q"), F.col("short"), F.lit(r"\E\b")), "<name>")
    return own.select(
        F.concat_ws(" ", F.lit(version), "repo_key", "file_path", "kind", "qualified_name", F.col("start_line").cast("string")).alias("id"), F.col("start_line").alias("pos"), "repo_key", "file_path", "kind",
        F.col("qualified_name").alias("name"), "signature", "body_hash", short_hash(collapse_blanks(shape)).alias("fingerprint"),
    )


def range_changes(before: DataFrame, after: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Changes and warnings between the files (repo_key, file_path, content) of two versions.

    Changes are those of ``compare`` with repo_key and file_path, and
    body_changed of kind module for a file whose text changed though no entity
    did. Warnings: file_path, code. A file that isn't supported on either side
    gives W_UNSUPPORTED_FILE and no change, one supported on one side only
    gives no change at all; one that can't be parsed on a side gives
    E_PARSE_ERROR and no change. Files that are equal on both sides are not
    parsed.
    """
    key = ["repo_key", "file_path"]
    sides = before.select(*key, F.col("content").alias("was")).join(after.select(*key, F.col("content").alias("now")), key, "full").where(~F.col("was").eqNullSafe(F.col("now")))
    changed = cut(sides)
    facts = [cut(parse(changed.where(f"{c} IS NOT NULL").select(*key, F.col(c).alias("content")))) for c in ("was", "now")]
    failed = [f.where("fact = 'failure'").select(*key, F.col("kind").alias("code")) for f in facts]
    broken = failed[0].where("code <> 'E_UNSUPPORTED_LANGUAGE'").unionByName(failed[1].where("code <> 'E_UNSUPPORTED_LANGUAGE'")).distinct()
    unsupported = [f.where("code = 'E_UNSUPPORTED_LANGUAGE'").select(*key) for f in failed]
    left_out = cut(broken.select(*key).unionByName(unsupported[0]).unionByName(unsupported[1]).distinct())
    present = changed.select(*key, F.col("was").isNotNull().alias("had"), F.col("now").isNotNull().alias("has"))
    both = present.join(unsupported[0].withColumn("u0", F.lit(True)), key, "left").join(unsupported[1].withColumn("u1", F.lit(True)), key, "left")
    silent = both.where("(u0 OR NOT had) AND (u1 OR NOT has)").select(*key)
    warnings = broken.unionByName(silent.withColumn("code", F.lit("W_UNSUPPORTED_FILE")))
    old, new = (cut(entities(f.join(left_out, key, "left_anti"), v)) for f, v in zip(facts, ("before", "after")))
    found = cut(compare(old, new, ["repo_key"]))
    named = old.unionByName(new).select("id", *key, "kind", "name", "pos")
    at = lambda c, p: named.select(F.col("id").alias(c), *[F.col(x).alias(p + x) for x in (*key, "kind", "name", "pos")])
    placed = found.join(at("before_id", "b_"), "before_id", "left").join(at("after_id", "a_"), "after_id", "left")
    either = lambda c: F.coalesce("a_" + c, "b_" + c).alias(c)
    changes = placed.select(either("repo_key"), either("file_path"), F.when(F.col("change_kind") == "moved", F.col("b_file_path")).alias("old_path"), "change_kind", either("kind"), either("name"), F.col("b_name").alias("old_name"), F.col("b_pos").alias("before_line"), F.col("a_pos").alias("after_line"), "score", "ambiguous")
    quiet = changed.where("was IS NOT NULL AND now IS NOT NULL").select(*key).join(left_out, key, "left_anti").join(changes.select(*key).distinct(), key, "left_anti")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    module = quiet.select(*key, null("string", "old_path"), F.lit("body_changed").alias("change_kind"), F.lit("module").alias("kind"), F.col("file_path").alias("name"), null("string", "old_name"), F.lit(1).alias("before_line"), F.lit(1).alias("after_line"), null("double", "score"), F.lit(False).alias("ambiguous"))
    moves = changes.where("ambiguous").select(*key, F.lit("W_MOVE_AMBIGUOUS").alias("code")).distinct()
    return ordered(changes.unionByName(module)), warnings.unionByName(moves)


def ordered(changes: DataFrame) -> DataFrame:
    """Changes in a total order: repository, file, line (the later one first if there is one), kind, name and what else tells them apart."""
    line = F.coalesce(F.when(F.col("after_line") > 0, F.col("after_line")), "before_line")
    return changes.orderBy("repo_key", "file_path", line, "kind", "name", "change_kind", "old_name", "old_path", "before_line", "after_line", "score")


def within_budget(before: DataFrame, after: DataFrame, parse: Callable[[DataFrame], DataFrame], seconds: float, batches: int = 16, clock: Callable[[], float] = time.monotonic) -> tuple[DataFrame, DataFrame]:
    """``range_changes`` batch by batch of repositories until ``seconds`` have passed; the files of batches that weren't begun get W_ANALYSIS_BUDGET_EXCEEDED."""
    key = ["repo_key", "file_path"]
    began = clock()
    changes = warnings = None
    for n in range(batches):
        mine = F.pmod(F.xxhash64("repo_key"), F.lit(batches)) == n
        old, new = before.where(mine), after.where(mine)
        if clock() - began > seconds and changes is not None:
            skipped = old.select(*key).unionByName(new.select(*key)).distinct().withColumn("code", F.lit("W_ANALYSIS_BUDGET_EXCEEDED"))
            warnings = warnings.unionByName(skipped)
            continue
        found = [cut(x) for x in range_changes(old, new, parse)]
        changes = found[0] if changes is None else changes.unionByName(found[0])
        warnings = found[1] if warnings is None else warnings.unionByName(found[1])
    return ordered(changes), warnings
