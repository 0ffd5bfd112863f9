"""Near-duplicate texts: partitioned SimHash tables, prefixes of rare shingles for what lies beyond their radius, one verification."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.buckets import CELL, celled
from codeweft.tables import cut, small

SHINGLE_WORDS = 5
SIMILARITY = 0.8
HAMMING = 3
#: Tables are keyed by every choice of KEYED of BLOCKS blocks; BLOCKS - KEYED >= HAMMING loses no pair of that distance.
BLOCKS, KEYED = 5, 2
#: Frequent shingles that are told apart when shingles are ordered; the others count as rare, which costs time but no pair.
FREQUENT = 100_000

WORD = re.compile(r"\w+")


def shingles(text: str, n: int = SHINGLE_WORDS) -> set[str]:
    """The distinct runs of ``n`` words of the lower-cased text; a shorter text is one shingle."""
    words = WORD.findall(text.lower())
    if len(words) <= n:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def shingle_hashes(text: str):
    """The sorted hashes of the text's shingles, as signed integers."""
    import numpy as np
    import xxhash

    grams = shingles(text)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), dtype=np.uint64, count=len(grams)).view(np.int64))


def simhash_of(hashes) -> int:
    """The 64-bit SimHash of shingle hashes, as a signed integer; 0 for none."""
    import numpy as np

    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int(np.packbits(bits * 2 > len(hashes)).view(">i8")[0])


def simhash(text: str) -> int:
    return simhash_of(shingle_hashes(text))


def jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def block_masks(blocks: int = BLOCKS, keyed: int = KEYED) -> list[int]:
    """One mask a table: the bits of a choice of ``keyed`` blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    single = [((1 << cuts[i + 1]) - 1) & ~((1 << cuts[i]) - 1) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(chosen)) for chosen in itertools.combinations(single, keyed)]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        sets = [shingle_hashes(t) for t in batch.column("text").to_pylist()]
        keys = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
        columns = [batch.column("node"), pa.array(keys, pa.binary()), pa.array([simhash_of(h) for h in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "key", "simhash", "shingles"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        values, counts = np.unique(batch.column("shingles").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values[counts > 2], pa.int64()), pa.array(counts[counts > 2], pa.int64())], names=["h", "n"])


def least_shared(size: int, threshold: float) -> int:
    """How many of ``size`` shingles a text shares at least with any that reaches the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def _prefixes(threshold: float, frequent: list[tuple[int, int]]):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = np.array([h for h, _ in frequent], dtype=np.int64)
        weights = np.array([n for _, n in frequent], dtype=np.int64)
        for batch in batches:
            firsts, sizes = [], []
            for hashes in batch.column("shingles"):
                h = hashes.values.to_numpy()
                weight = np.zeros(len(h), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    weight = np.where(known[at] == h, weights[at], 0)
                firsts.append(h[np.lexsort((h, weight))][: len(h) - least_shared(len(h), threshold) + 1])
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], names=["id", "size", "prefix"])

    return prefixes


class NearTexts:
    """Distinct ``texts`` (node, text) laid out so that near-duplicates of some or all can be found.

    Two texts are near-duplicates if their shingle sets have a Jaccard
    similarity of ``threshold``. Candidates come from partitioned SimHash
    tables, verified by their Hamming distance; pairs that differ in more bits
    come from prefixes (``beyond``): with shingles in one order for all, rare
    ones first, two such sets share one among the first of each, as many as the
    threshold lets differ and one more. So none is lost. (Only the order depends
    on how shingles are counted, so counts within batches will do.) All are
    verified by the similarity itself. Texts of equal sets are one class, and
    its least node stands for it, so a page with a million copies doesn't pair
    with itself. Crowded buckets are cut into cells.
    """

    def __init__(self, texts: DataFrame, threshold: float = SIMILARITY, hamming: int = HAMMING, beyond: bool = True) -> None:
        self.threshold, self.hamming = threshold, hamming
        kind = dict(texts.dtypes)["node"]
        hashed = texts.select("node", "text").mapInArrow(_hashed, f"node {kind}, key binary, simhash bigint, shingles array<bigint>").persist()
        classes = hashed.groupBy("key").agg(F.min("node").alias("rep"))
        self.members = cut(hashed.select("node", "key").join(classes, "key").where("node <> rep").select("rep", "node"))
        reps = hashed.join(classes.select(F.col("rep").alias("node")), "node", "left_semi").where(F.size("shingles") > 0)
        self.sets = cut(reps.select(F.monotonically_increasing_id().alias("id"), "node", "simhash", "shingles"))
        hashed.unpersist()
        tables = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).cast("bigint").bitwiseAND(F.col("simhash")).alias("bits")) for i, m in enumerate(block_masks())]))
        self.tables = cut(celled(self.sets.select("id", "simhash", tables.alias("t")).select("id", "simhash", "t.no", "t.bits"), ["no", "bits"], "id", CELL))
        self.prefixes = None
        if beyond:
            frequent = self.sets.select("shingles").mapInArrow(_repeated, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
            prefix = self.sets.select("id", "shingles").mapInArrow(_prefixes(threshold, sorted((r["h"], r["n"]) for r in frequent)), "id bigint, size int, prefix array<bigint>")
            self.prefixes = cut(celled(prefix.select("id", "size", F.posexplode("prefix").alias("pos", "h")), ["h"], "id", CELL))

    def _met(self, placed: DataFrame, keys: list[str], carried: list[str], ids: DataFrame | None) -> DataFrame:
        """Every two rows of a bucket as one row, id and ``carried`` of both with a_ and b_; with ``ids``, those whose a_id is one of them."""
        columns = ["id", *carried]
        asked = placed if ids is None else placed.join(small(ids), "id", "left_semi")
        # a row of cell c meets all cells, or without ids those from c on
        first = F.col("cell") if ids is None else F.lit(0)
        left = asked.select(*keys, F.col("cell").alias("own"), F.explode(F.sequence(first, F.col("cells") - 1)).alias("cell"), *[F.col(c).alias(f"a_{c}") for c in columns])
        right = placed.select(*keys, "cell", *[F.col(c).alias(f"b_{c}") for c in columns])
        met = left.join(right, [*keys, "cell"]).where("a_id <> b_id")
        return met.where("own <> cell OR a_id < b_id") if ids is None else met

    def of(self, nodes: DataFrame | None = None) -> DataFrame:
        """Links (node, other) of the given ``nodes`` with their near-duplicates; of all, each link once and node < other, if none are given."""
        rep = F.coalesce("rep", "node")
        asked = None
        if nodes is not None:
            asked = cut(small(nodes).join(self.members, "node", "left").select("node", rep.alias("rep")))
            ids = cut(self.sets.join(small(asked.select(F.col("rep").alias("node"))), "node", "left_semi").select("id"))
            if ids.isEmpty():
                return self._to_members(asked, asked.select("rep", F.col("rep").alias("other")).distinct())
        else:
            ids = None
        near = self._met(self.tables, ["no", "bits"], ["simhash"], ids).where(F.bit_count(F.col("a_simhash").bitwiseXOR(F.col("b_simhash"))) <= self.hamming).select("a_id", "b_id")
        if self.prefixes is not None:
            met = self._met(self.prefixes, ["h"], ["size", "pos"], ids)
            # after the first shared shingle, what is left of the shorter side must still reach the overlap the threshold asks for
            needed = self.threshold / (1 + self.threshold) * (F.col("a_size") + F.col("b_size")) - 1e-6
            near = near.unionByName(met.where(F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos")) >= needed).select("a_id", "b_id"))
        near = near.distinct() if ids is not None else near.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
        shared = F.size(F.array_intersect("sa", "sb"))
        side = lambda a: self.sets.select(F.col("id").alias(f"{a}_id"), F.col("node").alias(a), F.col("shingles").alias(f"s{a}"))
        pairs = near.join(side("a"), "a_id").join(side("b"), "b_id").where(shared / (F.size("sa") + F.size("sb") - shared) >= self.threshold)
        if asked is None:
            links = pairs.select("a", "b").unionByName(self.members.toDF("a", "b"))
            return links.select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("other"))
        # to each near class and to the own one
        return self._to_members(asked, pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(asked.select("rep", F.col("rep").alias("other"))).distinct())

    def _to_members(self, asked: DataFrame, classes: DataFrame) -> DataFrame:
        """Links of asked nodes (node, rep) to the near classes (rep, other) and to their members."""
        whole = classes.unionByName(classes.join(self.members.select(F.col("rep").alias("other"), F.col("node").alias("member")), "other").select("rep", F.col("member").alias("other")))
        return asked.join(whole, "rep").where("node <> other").select("node", "other")


def similar_links(texts: DataFrame, threshold: float = SIMILARITY, beyond: bool = True) -> DataFrame:
    """All links (left_node < right_node) of ``NearTexts``: between class representatives, and from each to its members."""
    return NearTexts(texts, threshold, beyond=beyond).of().toDF("left_node", "right_node")
