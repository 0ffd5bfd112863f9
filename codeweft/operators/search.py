"""Ranked search: term statistics, BM25, priors, chunks, fusion and diverse choice."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions.text import TYPE_KINDS, basename, sparse_tokens, term_tokens
from codeweft.operators import blocks
from codeweft.tables import cut

K1, B = 1.2, 0.75
CHUNK_LINES, CHUNK_STRIDE = 80, 60
RRF_K, RRF_FILE_WEIGHT = 60, 2
TERM_CAP, SPARSE_TERM_CAP = 48, 64
#: Parts in which the results of one query are ranked first.
RANK_PARTS = 16
# ---- fixed values: words that don't count in a query
STOP_WORDS = frozenset(
    "a an and are as at be but by can change code did does for from how i in into is it make not of on or our should support that the this to use uses using "
    "we what when where which while with without".split()
)
SPARSE_STOP_WORDS = frozenset(
    "a an and are as at be been but by can could do does for from had has have how i if in into is it its may not of on or our should that the their then this "
    "to was we were what when where which why will with would you your".split()
)


@dataclass
class Query:
    """A weighted bag of terms, the heaviest first."""

    raw: str
    weights: dict[str, float] = field(default_factory=dict)

    @property
    def terms(self) -> list[str]:
        return sorted(self.weights, key=lambda t: (-self.weights[t], -len(t.encode()), t))[:TERM_CAP]

    def supplies(self, *terms: str) -> bool:
        return any(self.weights.get(t, 0) >= 1 for t in terms)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, float(self.weights[t])) for t in self.terms], "term string, weight double")


def _parts(word: str) -> list[str]:
    return [p.lower() for p in re.split(r"[\W_]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", word) if p]


def code_like(word: str) -> bool:
    """Whether a query word looks like code: inner punctuation, an option, or letter case within the word."""
    bare = word.strip("./:-")
    return bool(re.search(r"[_./:$+#]", bare)) or word.startswith("--") or any(c.isupper() for c in bare[1:])


def morphology(term: str) -> list[str]:
    """Other forms of a term, by its ending."""
    out = []
    for ending, instead, least in (("ization", ["ize"], 10), ("ification", ["ify"], 12), ("ing", ["", "e"], 6), ("ed", ["", "e"], 5)):
        if term.endswith(ending):
            if len(term) >= least:
                out += [term[: -len(ending)] + x for x in instead]
            break
    if term.endswith("s") and not term.endswith("ss") and len(term) > 4:
        out.append(term[:-1])
    return list(dict.fromkeys(out))


def build_query(text: str) -> Query:
    """Terms of a query text with weights: code words 2.5 (short acronyms 1.4), their parts 1.1, plain words 1, other forms 0.55."""
    query = Query(text.lower())

    def give(term: str, weight: float) -> None:
        if len(term.encode()) >= 2 and term not in STOP_WORDS:
            query.weights[term] = max(query.weights.get(term, 0.0), weight)

    for word in re.findall(r"[A-Za-z0-9_./:+#-]+", text):
        whole = word.strip("./:-").lower()
        if not whole:
            continue
        code = code_like(word)
        give(whole, (1.4 if len(whole) <= 3 else 2.5) if code else 1.0)
        for part in _parts(word.strip("./:-")):
            give(part, 1.1 if code else 1.0)
        for other in morphology(whole):
            give(other, 0.55)
    if not query.weights:
        raise ValueError("query contains no meaningful terms")
    return query


def _held(terms: DataFrame) -> list[tuple[str, float]]:
    """The terms of one query with their weights; more than a query has are refused."""
    held = [(r["term"], r["weight"]) for r in terms.limit(SPARSE_TERM_CAP + 1).collect()]
    if len(held) > SPARSE_TERM_CAP:
        raise ValueError(f"a query has at most {SPARSE_TERM_CAP} terms; use the batch form for more")
    return held


def document_frequency(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many documents (doc_id, path, body) each term occurs, in body or path, as a substring: term, weight, df, n_docs, idf.

    ``terms`` is a query's, at most some dozens: the scan tests them all and
    only counts leave a task.
    """
    held = _held(terms)
    text = F.lower(F.concat_ws("\n", "path", "body"))
    counts = documents.agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(text.contains(t)).alias(f"t{i}") for i, (t, _) in enumerate(held)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight"), F.col(f"t{i}").alias("df")) for i, (t, w) in enumerate(held)]))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counts.select("n_docs", rows.alias("r")).select("r.*", "n_docs").withColumn("idf", idf)


def term_counts(regions: DataFrame, terms: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(region_id, length, term, tf) of regions (region_id, body): token variants counted, length of all of them; a region without any term gives one row with a null term."""
    wanted = [t for t, _ in _held(terms)]
    counted = regions.select("region_id", (term_tokens(F.col("body")) if tokens is None else tokens).alias("tokens")).select(
        "region_id", F.size("tokens").alias("length"), F.filter("tokens", lambda t: t.isin(*wanted)).alias("own")
    )
    return counted.select("region_id", "length", F.explode_outer("own").alias("term")).groupBy("region_id", "length", "term").agg(F.count("term").alias("tf"))


def bm25(regions: DataFrame, documents: DataFrame, terms: DataFrame, sparse: bool = False) -> DataFrame:
    """Scores of regions that hold a term: region_id, bm25, coverage, score = bm25 + 7 coverage + code bonus (+ 2 if all terms occur).

    Frequencies are those of the regions, document frequencies those of the
    documents, the average length that of all regions.
    """
    counts = cut(term_counts(regions, terms, sparse_tokens(F.col("body")) if sparse else None))  # else the average would find the tokens again
    average = counts.groupBy("region_id").agg(F.max("length").alias("length")).agg(F.avg(F.greatest("length", F.lit(1))).alias("average"))
    idf = document_frequency(documents, terms).select("term", "weight", (F.col("idf") * F.col("weight")).alias("w"))
    whole = idf.agg(F.sum("w").alias("all_w"))
    size = 0.25 + B * F.greatest("length", F.lit(1)) / F.col("average")
    part = F.col("w") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * size))
    scored = (
        counts.where("tf > 0")
        .join(F.broadcast(idf), "term")
        .join(F.broadcast(average))
        .groupBy("region_id")
        .agg(F.sum(part).alias("bm25"), F.sum("w").alias("covered"), F.sum(F.when(F.col("weight") >= 2, 6 * F.col("weight")).otherwise(0.0)).alias("code"))
        .join(F.broadcast(whole))
    )
    coverage = F.when(F.col("all_w") > 0, F.col("covered") / F.col("all_w")).otherwise(0.0)
    total = F.col("bm25") + 7 * F.col("coverage") + F.least(F.lit(24.0), F.col("code")) + F.when(F.col("coverage") >= 1 - 1e-12, 2.0).otherwise(0.0)
    return scored.withColumn("coverage", coverage).select("region_id", F.round("bm25", 4).alias("bm25"), F.round("coverage", 4).alias("coverage"), F.round(total, 4).alias("score"))


def path_score(path: Column, query: Query) -> Column:
    """2.5 a term in the base name, else 1.25 in the path, times its weight; weights under 1.25 other than 1 don't count."""
    lower, base = F.lower(path), F.lower(basename(path))
    score = F.lit(0.0)
    for term in query.terms:
        weight = query.weights[term]
        if weight == 1 or weight >= 1.25:
            score = score + F.when(base.contains(term), 2.5 * weight).when(lower.contains(term), 1.25 * weight).otherwise(0.0)
    return score


# ---- fixed values: path patterns, what they add, and the query words that waive it
TEST_ARTIFACT = r"/tests?/|/testdata/|/fixtures/|/__tests__/|/spec/|\.test\.|\.spec\.|_test\.|_spec\.|\.test$"
DOC_ARTIFACT = r"/docs?/|/man/|/manual/|/(readme|changelog)[^/]*$|\.(md|markdown|rst|adoc|txt|prebuilt|roff|man|[1-9])$"
GENERATED_ARTIFACT = r"/single[_-]include/|amalgamat|/onefile/|/generated/|/dist/|/build/|/gen/|[._]generated\.[^/]*$|/generated_[^/]*$|\.min\.js$"
PRIORS = [
    (r"/(src|include|lib|packages)/", 0.5, ""),
    (r"/\.github/workflows/", -6.0, "workflow pipeline ci action"),
    (r"/\.github/(?!workflows/)", -12.0, ""),
    (r"/dependencies/|/third[_-]party/", -5.0, ""),
    (TEST_ARTIFACT, -12.0, "test tests testing spec specs regression regressions fixture fixtures"),
    (DOC_ARTIFACT, -6.0, "doc docs documentation readme readmes guide guides example examples"),
    (GENERATED_ARTIFACT, -6.0, "generated generator generators codegen codegens build builds dist bundle bundles amalgamation amalgamated single onefile"),
]


def path_prior(path: Column, query: Query | None = None) -> Column:
    """What a path alone says: source folders up; tests, docs, generated files and metadata down, unless the query asks for them."""
    lower = F.concat(F.lit("/"), F.lower(path))
    score = F.lit(0.0)
    for pattern, value, waived_by in PRIORS:
        if not (query and waived_by and query.supplies(*waived_by.split())):
            score = score + F.when(lower.rlike(pattern), value).otherwise(0.0)
    return score


def symbol_score(name: Column, qualified: Column, signature: Column, kind: Column, query: Query) -> Column:
    """Prior of the kind, 14 if the symbol is the whole query, and per term 6, 3 or 1.5 by where it occurs."""
    lower, full, sign = F.lower(name), F.coalesce(F.lower(qualified), F.lit("")), F.coalesce(F.lower(signature), F.lit(""))
    score = F.when(kind.isin("function", "method"), 2.0).when(kind.isin(*TYPE_KINDS), 0.75).when(kind.isin("block", "workflow", "document"), -1.5).when(kind == "section", -0.5).otherwise(0.0)
    compact = re.sub(r"[\W_]+", "", query.raw)
    if compact:
        score = score + F.when(F.regexp_replace(lower, r"[^\p{L}\p{Nd}]+", "") == compact, 14.0).otherwise(0.0)
    for term in query.terms:
        weight = query.weights[term]
        score = score + F.when(lower == term, 6 * weight).when(lower.contains(term) | full.contains(term), 3 * weight).when(sign.contains(term), 1.5 * weight).otherwise(0.0)
    return score


def focus_line(body: Column, query: Query) -> Column:
    """Number of the line (from 1) whose terms weigh most; the first on a tie, 1 if none occurs."""

    def weight(line: Column) -> Column:
        lower = F.lower(line)
        total = F.lit(0.0)
        for term in query.terms:
            total = total + F.when(lower.contains(term), query.weights[term]).otherwise(0.0)
        return F.round(total, 6)

    weights = F.transform(F.split(body, "\n"), weight)
    return F.array_position(weights, F.array_max(weights)).cast("int")


def chunks(documents: DataFrame, lines: int = CHUNK_LINES, stride: int = CHUNK_STRIDE) -> DataFrame:
    """Overlapping runs of lines of documents (doc_id, body): region_id, doc_id, start_line, end_line, body. The last run ends with the document."""
    split = documents.select("doc_id", F.split("body", "\n").alias("all")).withColumn("n", F.size("all"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - lines) / stride)).cast("int")
    starts = split.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    begin = F.col("k") * stride + 1
    return starts.select(
        F.concat_ws(":", "doc_id", begin.cast("string")).alias("region_id"), "doc_id", begin.alias("start_line"), F.least(begin + lines - 1, F.col("n")).alias("end_line"),
        F.array_join(F.slice("all", begin, F.lit(lines)), "\n").alias("body"),
    )


def ranked(scores: DataFrame, score: str, ties: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows by score and then ``ties``, with their rank (a bounded top-k, then a window over its rows)."""
    top = scores.orderBy(F.col(score).desc(), *ties).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), *ties)))


def fuse(sparse: DataFrame, semantic: DataFrame, k: int = RRF_K, file_weight: float = RRF_FILE_WEIGHT) -> DataFrame:
    """Reciprocal rank fusion of sparse regions (region_id, path, rank) with the best rank of their file in ``semantic`` (path, rank)."""
    files = semantic.groupBy("path").agg(F.min("rank").alias("file_rank"))
    score = 1 / (k + F.col("rank")) + F.coalesce(file_weight / (k + F.col("file_rank")), F.lit(0.0))
    return sparse.join(files, "path", "left").select("region_id", "path", F.round(score, 8).alias("score"))


@dataclass
class Region:
    """A found region, as the greedy choice needs it."""

    path: str
    start: int
    end: int
    score: float
    symbol: str = ""


def diverse(regions: Sequence[Region], top_k: int = 10, per_file: int = 3, ratio: float = 0.75) -> list[Region]:
    """Greedy choice among a bounded number of ranked regions.

    Until half of the picks are of distinct files, the best region of an
    unseen file goes first while it reaches ``ratio`` of the best score.
    Otherwise each earlier pick of the same file costs 0.8, of the same symbol
    4, of the same base name 2. Regions that overlap a pick by 60 % are left
    out. Ties go to path and line.
    """
    left = sorted(regions, key=lambda r: (-r.score, r.path, r.start, r.end))
    picks: list[Region] = []
    best = left[0].score if left else 0.0

    def overlaps(r: Region) -> bool:
        return any(p.path == r.path and min(p.end, r.end) - max(p.start, r.start) + 1 >= 0.6 * (min(p.end - p.start, r.end - r.start) + 1) for p in picks)

    def adjusted(r: Region) -> float:
        base = r.path.rsplit("/", 1)[-1]
        return (
            r.score
            - 0.8 * sum(p.path == r.path for p in picks)
            - 4 * (r.symbol != "" and any(p.symbol == r.symbol for p in picks))
            - 2 * any(p.path != r.path and p.path.rsplit("/", 1)[-1] == base for p in picks)
        )

    while len(picks) < top_k:
        open_ = [r for r in left if r not in picks and sum(p.path == r.path for p in picks) < per_file and not overlaps(r)]
        if not open_:
            break
        seen = {p.path for p in picks}
        fresh = next((r for r in open_ if r.path not in seen), None)
        if fresh and picks and len(seen) < math.ceil(top_k / 2) and fresh.score >= ratio * best:
            picks.append(fresh)
        else:
            picks.append(max(open_, key=lambda r: (adjusted(r), -open_.index(r))))
    return picks


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, terms, waived, compact = [], [], [], []
        for n, text in enumerate(batch.column("text").to_pylist()):
            try:
                query = build_query(text)
            except ValueError:  # no term: it finds nothing
                continue
            keep.append(n)
            terms.append([{"term": t, "weight": float(query.weights[t])} for t in query.terms])
            compact.append(re.sub(r"[\W_]+", "", query.raw))
            waived.append([i for i, (_, _, words) in enumerate(PRIORS) if words and query.supplies(*words.split())])
        kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))
        ids = batch.column("query_id").take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(terms, kind), pa.array(waived, pa.list_(pa.int32())), pa.array(compact, pa.string())], names=["query_id", "terms", "waived", "compact"])


def build_queries(queries: DataFrame) -> DataFrame:
    """(query_id, terms, waived, compact) of queries (query_id, text): the weighted terms of each, and the priors of paths that it waives, its letters and digits alone. Texts without a term give no row."""
    kind = dict(queries.dtypes)["query_id"]
    return queries.where("query_id IS NOT NULL AND text IS NOT NULL").select("query_id", "text").mapInArrow(_built, f"query_id {kind}, terms array<struct<term:string,weight:double>>, waived array<int>, compact string")


def substring_frequency(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """``document_frequency`` of any number of distinct ``terms`` (term) over documents (path, body): term, df, n_docs, idf."""
    asked, n_docs = terms.select("term").distinct().persist(), documents.count()
    held = blocks.held_by(documents.select(F.lower(F.concat_ws("\n", "path", "body")).alias("body")), asked, n_docs)
    counted = asked.join(held, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("n_docs", F.lit(n_docs).cast("bigint"))
    return counted.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def placed_texts(texts: DataFrame, path: str = "path") -> DataFrame:
    """``texts`` with lower_path and prior: the priors of paths that apply, as bits."""
    lower = F.concat(F.lit("/"), F.lower(path))
    bits = sum((F.when(lower.rlike(pattern), 1 << i).otherwise(0) for i, (pattern, _, _) in enumerate(PRIORS)), F.lit(0))
    return texts.withColumn("lower_path", F.lower(path)).withColumn("prior", bits)


def bm25_first(regions: DataFrame, documents: DataFrame, queries: DataFrame, limit: int | None, sparse: bool = False) -> DataFrame:
    """The first ``limit`` regions (region_id, body) of each of many queries by ``bm25``: query_id, region_id, bm25, coverage, score, rank; all, without ranks, if it is None.

    ``queries``: query_id and terms, structs of term and weight. If regions
    have a path, then those of ``build_queries``: the path's score and prior
    are added, and ties go to the path first. Pairs of a query and a region are
    scored and ranked within tasks.
    """
    by_path, mode = "path" in regions.columns, "sparse" if sparse else "bm25"
    terms = queries.select("query_id", F.inline("terms"))
    weighted = terms.join(substring_frequency(documents, terms.select("term")).select("term", "idf"), "term").select("query_id", F.struct((-F.col("weight")).alias("_o"), "term", "weight", (F.col("idf") * F.col("weight")).alias("w")).alias("t"))
    bags = weighted.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["term"].alias("term"), t["weight"].alias("weight"), t["w"].alias("w"))).alias("terms"))
    asked = cut(bags.join(queries.select("query_id", "waived"), "query_id") if by_path else bags)
    texts = regions.where("region_id IS NOT NULL").select(F.col("region_id").alias("id"), F.coalesce("body", F.lit("")).alias("body"), *(["path"] if by_path else []))
    n, average = blocks.text_lengths(regions.select(F.coalesce("body", F.lit("")).alias("body")), mode)
    ties = ("path", "id") if by_path else ("id",)
    kind = dict(texts.dtypes)["id"]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, {'path string, ' if by_path else ''}bm25 double, coverage double, score double"
    function = blocks.scorer(mode, ties, limit, tuple(v for _, v, _ in PRIORS) if by_path else (), K1, B, average)
    scores = blocks.met(placed_texts(texts) if by_path else texts, asked, function, schema, blocks.sizes(texts, n, asked))
    best = scores if limit is None else ranked_batch(scores, ties, limit)
    return best.withColumnRenamed("id", "region_id")


def bm25_batch(regions: DataFrame, documents: DataFrame, terms: DataFrame, sparse: bool = False) -> DataFrame:
    """``bm25`` of many queries, with ``terms`` (query_id, term, weight): query_id, region_id, bm25, coverage, score."""
    queries = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    return bm25_first(regions.select("region_id", "body"), documents, queries, None, sparse)


def path_term_scores(path: Column, terms: Column) -> Column:
    """``path_score`` of a row's own query, given by its terms."""
    lower, base = F.lower(path), F.lower(basename(path))

    def hit(t: Column) -> Column:
        weight = t["weight"]
        return F.when((weight != 1) & (weight < 1.25), 0.0).when(base.contains(t["term"]), 2.5 * weight).when(lower.contains(t["term"]), 1.25 * weight).otherwise(0.0)

    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + hit(t))


def path_priors(path: Column, waived: Column) -> Column:
    """``path_prior`` of a row's own query, given by the priors it waives."""
    lower, score = F.concat(F.lit("/"), F.lower(path)), F.lit(0.0)
    for i, (pattern, value, _) in enumerate(PRIORS):
        score = score + F.when(lower.rlike(pattern) & ~F.array_contains(waived, i), value).otherwise(0.0)
    return score


def path_scores(path: Column, terms: Column, waived: Column) -> Column:
    """``path_score`` and ``path_prior`` of a row's own query, given by its terms and the priors it waives."""
    return path_term_scores(path, terms) + path_priors(path, waived)


def symbol_scores(name: Column, qualified: Column, signature: Column, kind: Column, terms: Column, compact: Column) -> Column:
    """``symbol_score`` of a row's own query, given by its terms and its letters and digits alone."""
    lower, full, sign = F.lower(name), F.coalesce(F.lower(qualified), F.lit("")), F.coalesce(F.lower(signature), F.lit(""))
    prior = F.when(kind.isin("function", "method"), 2.0).when(kind.isin(*TYPE_KINDS), 0.75).when(kind.isin("block", "workflow", "document"), -1.5).when(kind == "section", -0.5).otherwise(0.0)
    exact = F.when((compact != "") & (F.regexp_replace(lower, r"[^\p{L}\p{Nd}]+", "") == compact), 14.0).otherwise(0.0)

    def hit(t: Column) -> Column:
        weight = t["weight"]
        return F.when(lower == t["term"], 6 * weight).when(lower.contains(t["term"]) | full.contains(t["term"]), 3 * weight).when(sign.contains(t["term"]), 1.5 * weight).otherwise(0.0)

    return F.coalesce(prior + exact + F.aggregate(terms, F.lit(0.0), lambda total, t: total + hit(t)), F.lit(0.0))


def ranked_batch(scores: DataFrame, ties: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each query_id by score and then ``ties``, with their rank; ranked in parts first."""
    order = [F.col("score").desc(), *ties]
    parts = scores.withColumn("part", F.pmod(F.xxhash64(*ties), F.lit(RANK_PARTS)))
    firsts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= limit)
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).drop("part")
