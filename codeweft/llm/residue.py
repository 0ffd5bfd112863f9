"""Problem 8: template residue, filler, empty forms, error pages and script notices.

A text is read as passages, the clauses of its lines without names and
numbers. A few generic phrases give trusted labels; labels spread from text to
text over passages that are equal, nearly so (SimHash tables), or open or close
with the same five words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.near_dup import SHINGLE_WORDS, NearTexts
from codeweft.tables import cut, small

# ---- places that were never filled in (fixed patterns, one a template syntax)
PLACES = [
    r"\{\{[-~]?\s*+(?:[#/>^&!]\s*+)?(?!\d+\s*,)[\w.$@\"'(|-](?:[^{}\n]|\{[^{}\n]*+\}(?!\}\}?\s*,))*+\s*+\}\}|\{\{[-~ ]+\}\}",  # {{ name }}, {{ .Name }}, {{#each items}}, {{ x|default("...") }}; no set of sets of numbers
    r"\{%[-+]?\s*+\w(?:(?!%\}|\{%)[^\n])*+%\}",  # {% block name %}
    r"<%(?:(?!%>|<%)[^\n])++%>",  # <%= name %>
    r"[$#]\{[A-Za-z_][\w.]*+(?:[\w.:-]*+|:[-=?+][^{}\n]*+)\}",  # ${name}, #{name}, ${name:-value}
    r"(?<![\w$#{])\{(?:[A-Za-z_]\w*+|\d{1,2})\}(?!\})",  # {name}, {0}
    r"%(?:\([A-Za-z_]\w*\)[sd]|[A-Z][A-Z0-9_]++%)",  # %(name)s, %NAME%
    r"@@[A-Z][A-Z0-9_]*@@",
    r"\$\$[A-Z][A-Z0-9_]*\$\$",
    r"(?<!\w)__(?!NAME__|MAIN__|INIT__|FILE__|DOC__|ALL__|DICT__|CLASS__)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    r"\bXX[A-Z]{2,}XX\b",
    r"\[\[\s*[a-z]\w*\s*\]\]",  # [[name]]
    r"\[\s*(?:insert|your|enter|add)\b[^\[\]\n]*+\]",  # [INSERT TITLE]
    r"\[[^\[\]\n]+\bgoes here\]",
    r"<\s*(?:your|insert|enter|add)\b[^<>\n]*+>",  # <your title here>
    r"<(?P<element>[a-z]+(?:-[a-z]+)+)>(?![\s\S]*?</(?P=element)\s*>)",  # <file-name>, but no element that is closed again
    r"\(\s*(?:fill in|insert|enter|to be filled)\b[^()\n]*+\)",  # (fill in link)
    r"«[a-z_]{2,}+»",  # «owner»: set off without blanks, so no quotation
    r"\[object Object\]",
]
#: These are told apart by letter case in a text that isn't all capitals.
EXACT_CASE = {5, 6, 7, 8, 9}
# `undefined` where a name or value belongs, not where the word is used
UNDEFINED = r"(?<!\bis )(?<!\bare )(?<!\bas )(?<!\ban )(?<!\bwas )(?<!\bbe )(?<!\bleft )(?<!['\"“])\bundefined\b(?! (?:behaviou?r|references?|variables?|symbols?|functions?|methods?|values?|or|if|when|in)\b)(?!['\"”])"

# ---- phrases that are residue wherever they are a whole clause (fixed patterns; 0 stands for a name or number)
REASON = "(?:page )?not found|forbidden|internal server error|bad gateway|service unavailable"
SEEDS = {
    "error_page": [rf"(?:(?:error|http|status|code|message|0) )*(?:{REASON})(?: 0)?", "could not connect to .*"],
    "script_notice": [
        r"(?:.* )?(?:enable|turn on) javascript\b.*", r"javascript is (?:disabled|required)\b.*", r"checking your browser\b.*",
        r"(?:(?:this|the|our|your) .* )(?:requires|needs) (?:javascript|scripts)(?: enabled)?",
    ],
    "filler": [r"(?:\w+ ){0,2}(?:tba|tbd)", r"your text goes here", r"this is (?:placeholder|dummy|sample) (?:text|copy)\b.*", r"(?:\w+ )?([^\W\d_]+)(?: \1){2,}"],
    "empty_form": [r"(?:write|describe|explain|list|add) (?:the|your|a|an) \w+", r"delete this line\b.*"],
}
KINDS = tuple(SEEDS)
SEED = [re.compile("|".join(f"(?:{p})" for p in patterns)) for patterns in SEEDS.values()]
#: Words of the well-known filler passage and its common continuations (fixed values).
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco "
    "laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est laborum nunc lacus erat vitae cursus augue porta mollis semper rutrum viverra pellentesque fermentum".split()
)
LOREM_SHARE, LOREM_WORDS = 0.6, 8

#: Share of a text's words in trusted phrases from which its label is trusted.
TRUSTED_SHARE = 0.1
#: Share of a passage's texts that are labelled from which it conducts.
CONDUCTING_SHARE = 0.02
#: Share of labelled words, among those of passages that other texts have too, from which a text is labelled.
LABELLED_SHARE = 1 / 3
#: Passages of a worker that are remembered.
REMEMBERED = 100_000

MASKED = re.compile(r"\b(?:\w*\d\w*|\w*_\w*|[a-z]++[A-Z]\w*)|[\w.-]*+/[\w/.-]*\w")
CLAUSE = re.compile(r"(?<=[.!?…;:,])\s+|\s+-\s+|\s*\|\s*")
SPOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|0")
HEADING = re.compile(r"#{1,6}\s.*")
FIELD = re.compile(r"[\w /]{1,40}:")


def _places() -> tuple[re.Pattern, re.Pattern]:
    exact = "|".join(f"(?:{p})" for i, p in enumerate(PLACES) if i in EXACT_CASE)
    loose = "|".join(f"(?:{p})" for i, p in enumerate(PLACES) if i not in EXACT_CASE) + "|" + UNDEFINED
    return re.compile(exact), re.compile(loose, re.I)


EXACT, LOOSE = _places()
CODE = re.compile(r"(?:^|(?<=\n))[ \t]*(```|~~~).*?(?:\n[ \t]*\1|\Z)|```.*?(?:```|\Z)|``.*?``|`[^`\n]*`", re.S)
TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s+[a-z-]+=\"[^\"]*\")*\s*/?>", re.I)
#: What a place begins with: tried first, as most texts hold none.
BEGINS, BEGINS_EXACT = re.compile(r"[{<$#%\[(«]"), ("@@", "$$", "__", "XX", "%")


def without_code(text: str, instead: str = " ") -> str:
    """The text with ``instead`` for what is in backticks or a code fence."""
    return CODE.sub(instead, text) if "`" in text or "~~~" in text else text


def open_place(text: str) -> bool:
    """Whether a value was never filled in, outside backticks and code fences."""
    bare = without_code(text)
    if any(LOOSE.match(bare, m.start()) for m in BEGINS.finditer(bare)) or any(x in bare for x in BEGINS_EXACT) and EXACT.search(bare):
        return True
    return "undefined" in bare.lower() and bool(LOOSE.search(bare))


class Passage(tuple):
    """(words, hash, hash of the opening five words, hash of the closing five, kind of seed or -1, the words as text)."""


def passage(clause: str) -> Passage | None:
    """The passage of a lower-cased clause whose names and numbers are 0; None without any word."""
    import xxhash

    words = SPOKEN.findall(clause)
    spoken = sum(w != "0" for w in words)
    if not spoken:
        return None
    text = " ".join(words)
    kind = next((k for k, pattern in enumerate(SEED) if pattern.fullmatch(text)), -1)
    if kind < 0 and len(words) >= LOREM_WORDS and sum(w in LOREM for w in words) >= LOREM_SHARE * len(words):
        kind = KINDS.index("filler")
    of = lambda t: xxhash.xxh3_64_intdigest(t) - 2**63
    whole = of(text)
    ends = (of(" ".join(words[:SHINGLE_WORDS]) + " >"), of("< " + " ".join(words[-SHINGLE_WORDS:]))) if len(words) > SHINGLE_WORDS else (whole, whole)
    return Passage((spoken, whole, *ends, kind, text))


class _Passages(dict):
    """Passages of clauses, found once for each."""

    def __missing__(self, clause: str) -> Passage | None:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[clause] = passage(clause)
        return found


def comments_out(text: str) -> tuple[str, list[str]]:
    """The text without HTML comments, and what they hold."""
    kept, held, at = [], [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        kept.append(text[at:begin])
        held.append(text[begin + 4 : end])
        at = end + 3
    return "\n".join([*kept, text[at:]]), held


def clauses(text: str) -> Iterator[tuple[str, bool, bool]]:
    """(clause, in a heading, a hint to the one who fills in a form) of a text, in lower case, names and numbers as 0.

    Code in backticks and fences is a name. A title (a first line that ends
    without a mark and has a blank line after it) is a heading. Hints are
    comments, lines in parentheses, and names of fields that stand below one
    another with nothing to them.
    """
    bare, comments = comments_out(without_code(text, " 0 "))
    lines = [line.strip() for line in MASKED.sub(" 0 ", TAG.sub(" ", bare) if "<" in bare else bare).lower().split("\n")]
    titled = len(lines) > 1 and not lines[1] and not re.search(r"[.!?:;,]$", lines[0]) and len(lines[0].split()) <= 12
    blank = [bool(FIELD.fullmatch(line)) for line in lines]
    for n, line in enumerate(lines):
        if not line:
            continue
        heading = n == 0 and titled or line[0] == "#" and bool(HEADING.fullmatch(line))
        hint = line[0] == "(" and line[-1] == ")" or blank[n] and (n > 0 and blank[n - 1] or n + 1 < len(lines) and blank[n + 1])
        for clause in CLAUSE.split(line):
            yield clause, heading, hint
    for comment in comments:
        for clause in CLAUSE.split(MASKED.sub(" 0 ", comment).lower()):
            yield clause, False, True


def trusted(text: str, known: dict[str, Passage | None]) -> tuple[int, dict[str, tuple[Passage, int]]]:
    """(kind of the trusted label or -1, passages outside headings with the kind that each shows or -1) of a text."""
    held: dict[str, tuple[Passage, int]] = {}
    total, shown = 0, [0] * len(KINDS)
    headed: dict[str, Passage] = {}
    for clause, heading, hint in clauses(text):
        found = known[clause]
        if found is None:
            continue
        if heading:
            if found[4] >= 0:
                headed[found[5]] = found
        elif found[5] not in held:
            held[found[5]] = (found, KINDS.index("empty_form") if hint else found[4])
    for found, kind in [*held.values(), *((p, p[4]) for p in headed.values())]:
        total += found[0]
        if kind >= 0:
            shown[kind] += found[0]
    share = sum(shown)
    return (shown.index(max(shown)) if share and share >= TRUSTED_SHARE * total else -1), held


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    known, seen = _Passages(), set()
    for batch in batches:
        places, labels, counts, flat, fresh, told, features = [], [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            place = open_place(text)
            kind, held = (-1, {}) if place else trusted(text, known)
            places.append(place)
            labels.append(kind)
            counts.append(len(held))
            flat += [(*p[:4], k) for p, k in held.values()]
            features.append(list({f for p, _ in held.values() for f in p[1:4]}))
            if len(seen) > REMEMBERED:
                seen.clear()
            new = [p for p, _ in held.values() if p[2] != p[1] and p[1] not in seen]
            seen.update(p[1] for p in new)
            fresh.append([p[5] for p in new])
            told.append([p[1] for p in new])
        at = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        columns = np.array(flat, dtype=np.int64).reshape(-1, 5).T
        lists = [pa.ListArray.from_arrays(at, pa.array(c.copy())) for c in columns]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(places), pa.array(labels, pa.int32()), *lists, pa.array(fresh, pa.list_(pa.string())), pa.array(told, pa.list_(pa.int64())), pa.array(features, pa.list_(pa.int64()))],
            names=["node", "place", "label", "words", "h", "opening", "closing", "kinds", "fresh", "told", "features"],
        )


READ = "node binary, place boolean, label int, words array<bigint>, h array<bigint>, opening array<bigint>, closing array<bigint>, kinds array<bigint>, fresh array<string>, told array<bigint>, features array<bigint>"


def _most(names: list[str]) -> Column:
    """The number of the greatest of the columns; the first of equal ones."""
    best = F.greatest(*names)
    return reduce(lambda rest, k: F.when(F.col(names[k]) == best, k).otherwise(rest), range(len(names) - 2, -1, -1), F.lit(len(names) - 1))


def spread_labels(texts: DataFrame, near: NearTexts | None = None) -> DataFrame:
    """(node, label) of the texts that trusted labels reach through connected components of texts and passages.

    ``texts``: node, label (-1 for none), words, h, opening, closing, kinds (a
    passage in each place of the arrays), features (the distinct hashes of all three). A text is linked with its passages
    and with their openings and closings; passages are linked with their
    near-duplicates (``near``, whose nodes are the passages' hashes). A passage
    conducts if enough of its texts are
    labelled, a text takes a label if enough of its words are in conducting
    passages, counted among those that other texts have too: so a page frame
    or a quoted notice around content of its own labels nothing. Each round
    starts from what the last one labelled and ends when that is nothing;
    rounds are cut by checkpoints.
    """
    counted = [f"c{k}" for k in range(len(KINDS))]
    total = reduce(add, map(F.col, counted))
    per_kind = lambda amount: [F.sum(F.when(F.col("label") == k, amount).otherwise(0)).alias(c) for k, c in enumerate(counted)]
    places = texts.select("node", F.explode("features").alias("f"))
    common = cut(places.groupBy("f").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1"))
    held = cut(texts.where("label >= 0").select("node", "label", "kinds", "h"))
    labelled = frontier = held.select("node", "label")
    seeds = held.select(F.explode(F.arrays_zip("h", "kinds")).alias("p")).where("p.kinds >= 0").select(F.col("p.h").alias("f"), F.col("p.kinds").cast("int").alias("label"))
    known = cut(seeds.groupBy("f").agg(F.min("label").alias("label")))
    tally, begun = None, False
    while not frontier.isEmpty():
        told = texts.select("node", "features").join(small(frontier), "node").select("label", F.explode("features").alias("f")).groupBy("f").agg(*per_kind(1))
        tally = cut(told if tally is None else tally.unionByName(told).groupBy("f").agg(*[F.sum(c).alias(c) for c in counted]))
        enough = tally.join(common, "f", "left").where(total >= CONDUCTING_SHARE * F.coalesce("n_texts", F.lit(1))).select("f", _most(counted).alias("label")).join(known.select("f"), "f", "left_anti")
        fresh = cut(enough if begun else known.unionByName(enough))
        begun = True
        if near is not None:
            links = near.of(fresh.select(F.col("f").alias("node")))
            alike = fresh.join(links.toDF("f", "g"), "f").select(F.col("g").alias("f"), "label").join(known.select("f"), "f", "left_anti")
            fresh = cut(fresh.unionByName(alike).groupBy("f").agg(F.min("label").alias("label")))
        known = cut(known.unionByName(fresh.join(known.select("f"), "f", "left_anti")))
        asked = places.join(small(fresh.select("f")), "f", "left_semi").select("node").distinct().join(labelled.select("node"), "node", "left_anti")
        passages = texts.join(small(cut(asked)), "node", "left_semi").select("node", F.posexplode(F.arrays_zip("words", "h", "opening", "closing")).alias("at", "p"))
        parts = passages.select("node", "at", "p.words", F.explode(F.array_distinct(F.array("p.h", "p.opening", "p.closing"))).alias("f"))
        seen = parts.join(common.select("f", F.lit(True).alias("shared")), "f", "left").join(known, "f", "left").groupBy("node", "at").agg(F.first("words").alias("words"), F.min("label").alias("label"), F.max("shared").alias("shared"))
        sums = seen.groupBy("node").agg(*per_kind(F.col("words")), F.sum(F.when(F.col("label").isNull() & F.col("shared"), F.col("words")).otherwise(0)).alias("other"))
        frontier = cut(sums.where((total > 0) & (total >= LABELLED_SHARE * (total + F.col("other")))).select("node", _most(counted).alias("label")))
        labelled = cut(labelled.unionByName(frontier))
    return labelled


def residue_documents(documents: DataFrame) -> DataFrame:
    """Documents that hold residue in place of content: doc_id, label, seeded.

    label is placeholder, error_page, script_notice, filler or empty_form. A
    place that was never filled in shows itself by its syntax. The other kinds
    begin with trusted labels: texts of whose words a tenth or more is in
    generic phrases (SEEDS). These spread (``spread_labels``) over passages
    that texts share, exactly, by SimHash tables and shingle similarity, or in
    their opening or closing five words. A text with an open place takes no
    part in that, as that place may have been filled elsewhere. seeded tells
    whether the text was labelled by a phrase or place itself.

    Equal texts are one node, so any number of copies costs one. Rows with a
    null doc_id or text, and empty texts, give nothing; repeated rows give one
    row; an empty table gives none.
    """
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.unhex(F.md5("text")).alias("node"))
    read = rows.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(_read, READ).persist()
    passages = read.select(F.explode(F.arrays_zip("told", "fresh")).alias("p")).groupBy(F.col("p.told").alias("node")).agg(F.first("p.fresh").alias("text"))
    spread = spread_labels(read.where("NOT place").select("node", "label", "words", "h", "opening", "closing", "kinds", "features"), NearTexts(passages))
    own = read.where("place OR label >= 0").select("node", F.lit(True).alias("seeded"))
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("label") + 1)
    held = read.where("place").select("node", F.lit("placeholder").alias("label")).unionByName(spread.select("node", names.alias("label"))).join(own, "node", "left")
    return rows.select("doc_id", "node").distinct().join(held, "node").select("doc_id", "label", F.coalesce("seeded", F.lit(False)).alias("seeded"))
