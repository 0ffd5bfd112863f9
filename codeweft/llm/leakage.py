"""Problem 6: evaluation passages in training text, by the q-gram lemma in diagonal bands."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.tables import small

RUN_WORDS = 12
BAND_WORDS = 8
EDITS = 0
#: Gram lengths to choose from, and how many certain grams a length should leave.
GRAM_LENGTHS = (36, 28, 20, 14, 10, 7, 5, 3, 1)
WANTED = 3


def plain_words(text: Column) -> Column:
    """The maximal runs of a-z and 0-9 in the lower-cased text, joined by one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def word_grams(words: Column, q: int) -> Column:
    """The ``q`` characters from each word's start on, in order; fewer than ``q`` characters left give none."""
    return F.regexp_extract_all(words, F.lit(r"(?:^|(?<= ))(?=(.{%d}))" % q), F.lit(1))


def fitting_gram(words: list[str], run_words: int, edits: int) -> tuple[int, int]:
    """The gram length for an item, and the grams that any run of ``run_words`` of its words surely shares.

    The lemma, counted on the item itself: of a run's words, those from whose
    start the gram ends within the run; each of ``edits`` changed words spoils
    at most the grams that cover it. The longest length that leaves at least
    ``WANTED`` certain grams is taken, else the one that leaves most. (0, 0)
    means that no length leaves one; such an item is compared in full.
    """
    best = (0, 0)
    ends, at = [], 0
    for w in words:
        ends.append((at, at + len(w)))
        at += len(w) + 1
    for q in GRAM_LENGTHS:
        least = None
        for i in range(len(words) - run_words + 1):
            run = ends[i : i + run_words]
            grams = [(s, s + q) for s, _ in run if s + q <= run[-1][1]]
            worst = max((sum(s < e2 and e > s2 for s, e in grams) for s2, e2 in run), default=0) if edits else 0
            sure = len(grams) - edits * worst
            least = sure if least is None else min(least, sure)
        if least and least >= WANTED:
            return q, least
        if least and least > best[1]:
            best = (q, least)
    return best


def _with_grams(run_words: int, edits: int):
    """Items to (item_id, item_words, q, need)."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fitting_gram(w.split(" "), run_words, edits) for w in batch.column("item_words").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), batch.column("item_words"), pa.array([q for q, _ in got], pa.int32()), pa.array([n for _, n in got], pa.int32())],
                names=["item_id", "item_words", "q", "need"],
            )

    return choose


def longest_run(a: list[str], b: list[str], lo: int, hi: int, edits: int) -> int:
    """Most words matched along a diagonal lo..hi (index in a minus index in b) with at most ``edits`` differing words in the span.

    The banded alignment: substitutions stay on a diagonal, an inserted or
    missing word changes it by one, each at the cost of one edit.
    """
    best = 0
    # reach[e][d]: words matched so far by an alignment ending at the current b word on diagonal d with e edits
    width = hi - lo + 1
    reach = [[0] * width for _ in range(edits + 1)]
    for j, word in enumerate(b):
        fresh = [[0] * width for _ in range(edits + 1)]
        for d in range(width):
            i = j + lo + d
            same = 0 <= i < len(a) and a[i] == word
            for e in range(edits + 1):
                if same:
                    got = reach[e][d] + 1
                else:
                    got = reach[e - 1][d] if e and reach[e - 1][d] else 0  # substituted
                if e and d + 1 < width and reach[e - 1][d + 1] > got:
                    got = reach[e - 1][d + 1]  # word of b missing in a
                if e and d and fresh[e - 1][d - 1] > got:
                    got = fresh[e - 1][d - 1]  # extra word in a
                fresh[e][d] = got
                if got > best:
                    best = got
        reach = fresh
    return best


def _verify(run_words: int, edits: int, band: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, runs = [], []
            columns = (batch.column(c).to_pylist() for c in ("doc_words", "item_words", "bands"))
            for n, (doc, item, bands) in enumerate(zip(*columns)):
                a, b = doc.split(" "), item.split(" ")
                run = max(longest_run(a, b, (x - 1) * band - edits, (x + 1) * band - 1 + edits, edits) for x in bands)
                if run >= run_words - edits:
                    keep.append(n)
                    runs.append(run)
            if keep:
                kept = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("item_id"), pa.array(runs, pa.int32())], names=["doc_id", "item_id", "run_words"])

    return verify


def leaked_items(documents: DataFrame, items: DataFrame, run_words: int = RUN_WORDS, band: int = BAND_WORDS, edits: int = EDITS) -> DataFrame:
    """Documents whose text holds ``run_words`` consecutive words of an item's passage: doc_id, item_id, run_words.

    ``edits`` allows as many words of the run to be changed, added or missing
    (0: an exact run); a number at which no gram is sure to be shared is refused. Rows with a null id or text, and passages or texts with
    fewer words than the run, give nothing; repeated rows give one; an empty
    table on either side gives no rows.

    Grams are anchored at word starts on both sides, and each item's gram
    length and least number of shared grams follow from its own words, so no
    run is lost (see ``fitting_gram``). Items are the stated query set: their
    grams are broadcast only while they number at most ``BROADCAST_ROWS``
    (counted, see ``small``); beyond that the join shuffles. Of the corpus only hits leave a
    task, as counts by (document, item, band).
    """
    words = items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", plain_words(F.col("passage")).alias("item_words")).distinct()
    asked = (
        words.where(F.size(F.split("item_words", " ")) >= run_words - edits)
        .mapInArrow(_with_grams(run_words, edits), "item_id bigint, item_words string, q int, need int")
        .persist()
    )
    corpus = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", plain_words(F.col("text")).alias("doc_words"))
    lengths = sorted(r["q"] for r in asked.select("q").distinct().collect())  # at most one a gram length
    near = None
    for q in lengths:
        own = asked.where(F.col("q") == q)
        if not q:
            raise ValueError(f"{edits} edits leave no gram that a run of {run_words} words must share; allow fewer")
        grams = own.select("item_id", "need", F.posexplode(word_grams(F.col("item_words"), q)).alias("item_at", "gram"))
        found = _regions(corpus, small(grams.select("item_id", "need", "item_at", F.xxhash64("gram").alias("gram"))), q, band)
        near = found if near is None else near.unionByName(found)
    if near is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, run_words int")
    return (
        near.join(corpus, "doc_id")
        .join(small(asked.select("item_id", "item_words")), "item_id")
        .select("doc_id", "item_id", "doc_words", "item_words", "bands")
        .mapInArrow(_verify(run_words, edits, band), "doc_id bigint, item_id bigint, run_words int")
        .groupBy("doc_id", "item_id")
        .agg(F.max("run_words").alias("run_words"))
    )


def _regions(corpus: DataFrame, grams: DataFrame, q: int, band: int) -> DataFrame:
    """(doc_id, item_id, bands): diagonal bands that share enough grams."""
    hits = (
        corpus.select("doc_id", F.posexplode(word_grams(F.col("doc_words"), q)).alias("doc_at", "gram"))
        .select("doc_id", "doc_at", F.xxhash64("gram").alias("gram"))
        .join(grams, "gram")
    )
    # bands of 2 * band diagonals, each diagonal in two of them: a run that drifts by up to `band` lies in one
    lane = F.floor((F.col("doc_at") - F.col("item_at")) / F.lit(band)).cast("int")
    return (
        hits.select("doc_id", "item_id", "item_at", "need", F.explode(F.array(lane, lane + 1)).alias("lane"))
        .groupBy("doc_id", "item_id", "lane")
        .agg(F.count_distinct("item_at").alias("shared"), F.min("need").alias("need"))
        .where(F.col("shared") >= F.col("need"))
        .groupBy("doc_id", "item_id")
        .agg(F.collect_set("lane").alias("bands"))
    )


def leak_report(leaks: DataFrame) -> DataFrame:
    """Items found in the corpus: item_id, n_docs, longest run."""
    return leaks.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("run_words").alias("run_words"))
