"""Problem 5: items that appear together, by merged stripes and the log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.tables import cut, small

#: Memberships that one task turns into stripes at once.
CHUNK = 300_000
#: An item of this share of all rows or more is heavy: its stripe is merged in SALTS parts.
HEAVY_SHARE, SALTS = 1 / 10_000, 64
#: Baskets that a task remembers as too large.
REMEMBERED = 1_000_000

IDS = ["b1", "b2", "i1", "i2"]


def clean_path(path: Column) -> Column:
    """``path`` with single slashes and without leading ``./`` and ``/``; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"^(\./|/)+", "")
    return F.when(bare != "", bare)


def _sorted_distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct rows (of the columns IDS) in their order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where the baskets of ordered rows begin."""
    return np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else np.zeros(0, dtype=np.int64)


def _fitting(max_items: int):
    """Distinct rows of a batch; of a basket with more than ``max_items``, that many and one, once a task: enough to know it as such."""

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: set[tuple[int, int]] = set()
        for batch in batches:
            rows = _sorted_distinct(np.stack([batch.column(c).to_numpy() for c in IDS], axis=1))
            starts = _starts(rows)
            sizes = np.diff(np.append(starts, len(rows)))
            place = np.arange(len(rows)) - np.repeat(starts, sizes)
            keep = place <= max_items
            if over:
                known = np.array([tuple(b) in over for b in rows[starts, :2].tolist()])
                keep &= ~np.repeat(known, sizes)
            if len(over) > REMEMBERED:
                over.clear()
            over.update(map(tuple, rows[starts[sizes > max_items], :2].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in rows[keep].T], names=IDS)

    return fitting


def _stripes(max_items: int, heavy: np.ndarray):
    """Rows in order of basket to stripes: (l1, l2, salt, owned, r1, r2, n); an item is its own neighbour as often as it occurs, and owns the baskets it comes first in."""

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in IDS], axis=1))
            size += len(held[-1])
            if size < CHUNK:
                continue
            rows = _sorted_distinct(np.concatenate(held))
            last = _starts(rows)[-1]  # the basket that may go on in the next batch
            yield _striped(rows[:last], max_items, heavy)
            held = [rows[last : last + max_items + 1]]
            size = len(held[0])
        if size:
            yield _striped(_sorted_distinct(np.concatenate(held)), max_items, heavy)

    return stripes


def _striped(rows: np.ndarray, max_items: int, heavy: np.ndarray) -> pa.RecordBatch:
    starts = _starts(rows)
    sizes = np.diff(np.append(starts, len(rows)))
    fits = sizes <= max_items
    starts, sizes, rows = starts[fits], sizes[fits], rows[:, 2:]
    items, local = np.unique(rows, axis=0, return_inverse=True)
    local = local.reshape(-1)
    left, right = [], []
    for k in np.unique(sizes):
        table = local[starts[sizes == k][:, None] + np.arange(k)[None, :]]
        i, j = np.triu_indices(k)
        left.append(table[:, i].reshape(-1))
        right.append(table[:, j].reshape(-1))
    left, right = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
    pairs, counts = np.unique(np.stack([left, right], axis=1), axis=0, return_counts=True) if len(left) else (np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64))
    left, right = pairs.T
    owned = np.bincount(local[starts], minlength=len(items))
    is_heavy = np.isin(items[:, 0], heavy)
    salt = np.where(is_heavy[left], np.remainder(items[right, 1], SALTS), 0)
    order = np.lexsort((right, salt, left))
    left, right, salt, counts = left[order], right[order], salt[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (salt[1:] != salt[:-1])])) if len(left) else np.zeros(0, dtype=np.int64)
    at = pa.array(np.append(begins, len(left)), pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(c.copy())) for c in (items[right, 0], items[right, 1], counts.astype(np.int64))]
    columns = [items[left[begins], 0], items[left[begins], 1], salt[begins], owned[left[begins]].astype(np.int64)]
    return pa.RecordBatch.from_arrays([*(pa.array(c.copy()) for c in columns), *lists], names=["l1", "l2", "salt", "owned", "r1", "r2", "n"])


def _log_term(k: Column, expected: Column) -> Column:
    return F.when(k > 0, k * F.ln(k / expected)).otherwise(F.lit(0.0))


def cooccurrence(memberships: DataFrame, max_items: int = 50) -> DataFrame:
    """How often two items share a basket, and how far that exceeds chance.

    ``memberships``: (space, basket, item), repeats allowed; rows with a null
    are ignored. A basket counts with its distinct items and is left out if it
    has more than ``max_items`` of them. Result, one row a pair with left_item
    < right_item in code-point order: n_both, n_left, n_right, n_baskets (of
    the space), lift, and llr, Dunning's G2, negative if the pair is rarer
    than chance.

    Items and baskets travel as 128-bit hashes. Rows meet by basket; of a
    basket that is too large a task passes on ``max_items`` + 1 rows, so none
    is ever collected. Ordered by basket, rows become stripes: an item with
    its neighbours and how often each. Stripes are merged by item, those of
    heavy items (at most 1 / HEAVY_SHARE) in parts.
    """
    rows = memberships.where("space IS NOT NULL AND basket IS NOT NULL AND item IS NOT NULL").select("space", "basket", "item")
    key = lambda a, b, *of: [F.xxhash64(*of).alias(a), F.xxhash64(F.lit(1), *of).alias(b)]
    hashed = rows.select(*key("b1", "b2", "space", "basket"), *key("i1", "i2", "space", "item"))
    names = rows.select(*key("i1", "i2", "space", "item"), "space", "item").groupBy("i1", "i2").agg(F.first("space").alias("space"), F.first("item").alias("item"), F.count(F.lit(1)).alias("rows"))
    named = cut(names)
    total = named.agg(F.sum("rows")).first()[0] or 0
    heavy = np.array([r[0] for r in named.where(F.col("rows") >= HEAVY_SHARE * total).select("i1").collect()], dtype=np.int64)
    ids = "b1 bigint, b2 bigint, i1 bigint, i2 bigint"
    met = hashed.mapInArrow(_fitting(max_items), ids).repartition("b1", "b2").sortWithinPartitions(*IDS)
    stripes = met.mapInArrow(_stripes(max_items, heavy), "l1 bigint, l2 bigint, salt bigint, owned bigint, r1 array<bigint>, r2 array<bigint>, n array<bigint>").repartition("l1", "l2", "salt")
    merged = (
        stripes.select("l1", "l2", "salt", "owned", F.inline(F.arrays_zip("r1", "r2", "n")))
        .groupBy("l1", "l2", "salt", "r1", "r2")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.expr("l1 = r1 AND l2 = r2"), F.col("owned"))).alias("owned"))
        .persist()
    )
    alone = merged.where("l1 = r1 AND l2 = r2").select(F.col("l1").alias("i1"), F.col("l2").alias("i2"), "n", "owned")
    items = cut(alone.join(named.drop("rows"), ["i1", "i2"]))
    spaces = items.groupBy("space").agg(F.sum("owned").alias("n_baskets"))
    sized = items.drop("owned").join(small(spaces), "space")
    side = lambda a: sized.select(F.col("i1").alias(a + "1"), F.col("i2").alias(a + "2"), F.col("item").alias(a + "_item"), F.col("n").alias(a + "_n"), "space", "n_baskets")
    pairs = merged.where("l1 <> r1 OR l2 <> r2").select("l1", "l2", "r1", "r2", F.col("n").alias("n_both"))
    joined = pairs.join(side("l"), ["l1", "l2"]).join(side("r").drop("space", "n_baskets"), ["r1", "r2"])
    first = F.col("l_item") < F.col("r_item")
    choose = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    joined = joined.select("space", choose("l_item", "r_item").alias("left_item"), choose("r_item", "l_item").alias("right_item"), "n_both", choose("l_n", "r_n").alias("n_left"), choose("r_n", "l_n").alias("n_right"), "n_baskets")
    a, b, c, n = (F.col(x).cast("double") for x in ("n_left", "n_right", "n_both", "n_baskets"))
    g2 = 2 * (
        _log_term(c, a * b / n) + _log_term(a - c, a * (n - b) / n) + _log_term(b - c, (n - a) * b / n) + _log_term(n - a - b + c, (n - a) * (n - b) / n)
    )
    sign = F.when(c * n < a * b, -1.0).otherwise(1.0)
    return joined.select(
        "space", "left_item", "right_item", "n_both", "n_left", "n_right", "n_baskets", (c * n / (a * b)).alias("lift"), (sign * F.greatest(g2, F.lit(0.0))).alias("llr")
    )


def cochange(commit_files: DataFrame, max_files: int = 50) -> DataFrame:
    """Co-occurrence of files in commits: space is repo_key, basket is commit_id, item the cleaned path."""
    return cooccurrence(commit_files.select(F.col("repo_key").alias("space"), F.col("commit_id").alias("basket"), clean_path(F.col("file_path")).alias("item")), max_files)


def strong_pairs(pairs: DataFrame, min_both: int = 5, min_lift: int = 4) -> DataFrame:
    """Pairs with at least ``min_both`` common baskets and ``min_lift`` times those expected by chance (exact, in whole numbers)."""
    wide = [F.col(x).cast("decimal(38,0)") for x in ("n_both", "n_baskets", "n_left", "n_right")]
    return pairs.where((F.col("n_both") >= min_both) & (wide[0] * wide[1] >= F.lit(min_lift) * wide[2] * wide[3]))
