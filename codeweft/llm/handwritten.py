"""Problem 3: generated, minified, vendored and data files among source files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.tables import cut

#: Formats that are never a case, as they hold no code.
NO_CODE = ("json", "toml", "md")
#: Of several rules that hold, the first names the file.
RULES = ("shared_tree", "shared_code", "vendored_header", "vendored_folder", "generated_header", "generated_name", "minified", "data", "generated_layout")
#: Shared content of fewer characters, in a file or in a whole folder, tells nothing: an empty package file is in every project.
LEAST_SHARED = 200

# ---- what tools and importers write at the head or the end of a file (fixed patterns)
GENERATED = re.compile(
    r"code generated by\b|@generated\b|<auto-?generated>|\bauto-?generated (?:file|code|by|from)\b|\bautomatically generated\b|\bmachine[- ](?:written|generated)\b"
    r"|\bgenerated (?:from|by) .{0,80}(?:do not|don't) (?:edit|modify)|\bthis (?:file )?is a generated\b|\b(?:changes|edits) (?:will be|get|are) (?:lost|overwritten)\b"
    r"|\bproduced by \S+ on every (?:release|build)\b|\bedit \S+\.(?:tmpl|template|idl|proto|schema|in) instead\b|\bgenerated file\b.{0,40}(?:do not|don't) (?:edit|modify)",
    re.I | re.S,
)
IMPORTED = re.compile(
    r"\bvendored (?:copy of|from) \S+|\bcopied from \S+ v?\d[\w.]*|\bupstream: ?\S+@\S+|\bimported as is from\b|\bimported (?:unchanged|unmodified) from\b"
    r"|\bdo not (?:edit|patch) here\b.{0,40}\bupstream\b|\bfix bugs upstream\b",
    re.I | re.S,
)
LICENCE = re.compile(r"(?:\(c\)|copyright|©)\s+(?:\d{4}(?:-\d{4})?\s+)?(?:by\s+)?(?:the\s+)?([\w.-]+)\s+(?:authors|contributors|project)\b", re.I)
# ---- file names that only tools give (fixed patterns)
GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.(?:generated|gen|g)\.\w+|[.-]min\.m?js|\.bundle\.m?js|_Gen\.java)$")
# ---- folders that hold other projects' packages, each a folder below
IMPORT_DIRS = re.compile(r"(?:^|/)(?:vendor|_vendor|third[_-]?party|deps|extern|external|node_modules|bower_components)/(?:@[^/]+/)?[^/]+/", re.I)

BLOCK = re.compile(r"\s*(?:(?://|#(?!include|define|if|!\[|!/|pragma|undef|error|else|end|line))[^\n]*|/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?''')[ \t]*(?:\n|\Z)", re.S)
SHEBANG = re.compile(r"﻿?(?:#![^\n]*\n)?")
LINE_NOTE = re.compile(r"[ \t]*(?://|#(?!include|define|if|pragma|undef|error|else|end|line))")
OPENING = {"*/": re.compile(r"^[ \t]*/\*", re.M), '"""': re.compile(r'^[ \t]*"""', re.M), "'''": re.compile(r"^[ \t]*'''", re.M)}

LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\b0[xX][0-9a-fA-F]+\b|\b\d[\d.]*(?:[eE][+-]?\d+)?[a-zA-Z]?\b")
NAME = re.compile(r"[A-Za-z_$][\w$]*")
COMMENT = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/", re.S)
COUNTED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z_]*?[A-Za-z](\d{1,4})_?(?![A-Za-z0-9])")
WORDS = re.compile(r"[A-Za-z]+(?:[ '-][A-Za-z]+)*")


def head(text: str) -> tuple[str, int]:
    """The comments before the first code, and where the code begins."""
    at = SHEBANG.match(text).end()
    begun = at
    while (m := BLOCK.match(text, at)) and m.end() > at:
        at = m.end()
    return text[begun:at], at


def tail(text: str) -> list[str]:
    """The comments that close the text, however long: the run of line comments, or the block that begins a line."""
    text = text.rstrip()
    notes, at = [], len(text)
    while at > 0 and LINE_NOTE.match(text, begin := text.rfind("\n", 0, at) + 1):
        at = begin - 1
    if at < len(text):
        notes.append(text[at + 1 :])
    closing = next((c for c in OPENING if text.endswith(c)), None)
    if closing == "*/":
        before = text.rfind(closing, 0, -2)
        opening = OPENING[closing].search(text, before + 2 if before >= 0 else 0)
    elif closing:
        before = text.rfind(closing, 0, -3)
        opening = OPENING[closing].match(text, text.rfind("\n", 0, before) + 1) if before >= 0 else None
    else:
        opening = None
    if opening and opening.end() <= len(text) - len(closing):
        notes.append(text[opening.start() :])
    return notes


def code_of(text: str) -> str:
    """The code without the comments at the head, blanks collapsed: what an importer's header doesn't change."""
    return " ".join(text[head(text)[1] :].split())


def minified(text: str) -> bool:
    """Squeezed code: hardly a blank, long lines, most names one or two letters."""
    body = text[head(text)[1] :].strip()
    if not body:
        return False
    lines = body.count("\n") + 1
    blank = sum(map(body.count, " \t\n")) / len(body)
    if blank > 0.12 or len(body) / lines < 150:
        return False
    names = NAME.findall(LITERAL.sub("0", body))
    short = sum(len(n) <= 2 for n in names)
    return len(names) >= 20 and short >= 0.4 * len(names)


def data_blob(text: str) -> bool:
    """Nothing but literals: a handful of names around many numbers, or around long strings that aren't prose."""
    body = text[head(text)[1] :]
    literals = LITERAL.findall(body)
    size = sum(map(len, literals))
    if not body or size < 0.3 * len(body):
        return False
    names = NAME.findall(LITERAL.sub(" ", body))
    strings = [s for s in literals if s[0] in "\"'`"]
    opaque = sum(len(s) for s in strings if len(s) >= 30 and " " not in s)
    numbers = sum(len(s) for s in literals if s[0] not in "\"'`")
    return len(names) <= 14 and (opaque >= 300 and opaque >= 0.6 * len(body) or len(literals) - len(strings) >= 60 and numbers >= 0.3 * len(body))


def stamped(text: str) -> bool:
    """Stamped out by a tool: names counted 0, 1, 2, ... over a file whose statements have very few forms."""
    body = text[head(text)[1] :]
    counted = [int(n) for n in COUNTED.findall(LITERAL.sub(lambda m: m[0] if m[0][0] in "\"'" else " ", body))]
    if len(counted) < 6:
        return False
    firsts = list(dict.fromkeys(counted))
    small = sum(n <= 1.25 * len(firsts) for n in firsts)
    rising = sum(a < b for a, b in zip(firsts, firsts[1:]))
    if len(firsts) < 5 or small < 0.8 * len(firsts) or rising < 0.8 * (len(firsts) - 1):
        return False
    forms: dict[str, int] = {}
    lines = [line.strip() for line in body.split("\n") if line.strip()]
    for line in lines:
        form = NAME.sub("i", LITERAL.sub("0", line))
        forms[form] = forms.get(form, 0) + 1
    frequent = sum(n for n in forms.values() if n >= 0.6 * len(firsts))
    return frequent >= 0.6 * len(lines)


def squeezed_or_written(path: str, text: str, repo: str) -> str | None:
    """The rule by which a file alone shows that nobody of the project wrote it, or None."""
    if path.rsplit(".", 1)[-1].lower() in NO_CODE or not text.strip():
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    top = head(text)[0]
    for note in (top, *tail(text)):
        note = re.sub(r"\s*\n\s*(?://+|#+|\*)?\s*", " ", note)
        if GENERATED.search(note):
            return "generated_header"
        if IMPORTED.search(note):
            return "vendored_header"
        for owner in LICENCE.findall(note):
            if owner.lower() != repo.rsplit("/", 1)[-1].lower() and re.search(rf"\b{re.escape(owner)}[ -](?:v?\d|licen[cs]e)", note, re.I):
                return "vendored_header"
    if IMPORT_DIRS.search(path):
        return "vendored_folder"
    if GENERATED_NAME.search(path):
        return "generated_name"
    if minified(text):
        return "minified"
    if data_blob(text):
        return "data"
    if stamped(text):
        return "generated_layout"
    return None


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        rules, whole, sizes, coded = [], [], [], []
        for path, text, repo in zip(*(batch.column(c).to_pylist() for c in ("file_path", "content", "repo_key"))):
            rules.append(squeezed_or_written(path, text, repo or ""))
            code = code_of(text.replace("\r\n", "\n"))
            whole.append(xxhash.xxh3_64_intdigest(code) - 2**63 if code else None)
            sizes.append(len(code))
            coded.append(bool(code) and path.rsplit(".", 1)[-1].lower() not in NO_CODE)
        kept = [batch.column(c) for c in ("file_id", "repo_key", "file_path", "ingested_at")]
        columns = [pa.array(rules, pa.string()), pa.array(whole, pa.int64()), pa.array(sizes, pa.int64()), pa.array(coded)]
        yield pa.RecordBatch.from_arrays([*kept, *columns], names=["file_id", "repo_key", "file_path", "ingested_at", "rule", "whole_hash", "whole_size", "coded"])


def merkle_levels(files: DataFrame, depth: int) -> DataFrame:
    """Hashes of all folders: repo_key, folder, level, n_files and, over all files and over those with code alone, tree_hash, tree_size, code_hash, code_size.

    ``files``: repo_key, file_path, whole_hash, whole_size, and code_hash,
    code_size (null for data files); those below ``depth``
    folders count for the folder at that depth. The root is the folder '' at
    level 0. Bottom-up, a folder's hash is
    that of the multiset of its children's hashes; names don't enter, since
    importers rename. Multisets are hashed by sums and xor, which combine
    before the shuffle, so a folder with a third of all files is no hot group.
    """
    parts = F.split("file_path", "/")
    kept = [F.col("whole_hash").alias("t"), "whole_size", F.col("code_hash").alias("c"), "code_size"]
    nodes = files.select("repo_key", F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth))).alias("dirs"), F.lit(1).cast("bigint").alias("n_files"), *kept)

    def multiset(h: str) -> list[Column]:
        return [F.bit_xor(h).alias(f"{h}x"), F.sum(F.shiftright(h, 32)).alias(f"{h}u"), F.sum(F.col(h).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{h}l"), F.count(h).alias(f"{h}n")]

    def hashed(h: str) -> Column:
        return F.when(F.col(f"{h}n") > 0, F.xxhash64(*[f"{h}{part}" for part in "xuln"])).alias(h)

    levels = below = None
    for level in range(depth, -1, -1):
        at = nodes.where(F.size("dirs") == level)
        if below is not None:
            at = at.unionByName(below.withColumn("dirs", F.slice("dirs", 1, level)))
        sums = [F.sum(c).alias(c) for c in ("n_files", "whole_size", "code_size")]
        below = cut(  # a row a folder: each level is made once
            at.groupBy("repo_key", "dirs").agg(*multiset("t"), *multiset("c"), *sums).select("repo_key", "dirs", "n_files", hashed("t"), "whole_size", hashed("c"), "code_size")
        )
        own = below.select("repo_key", F.array_join("dirs", "/").alias("folder"), F.lit(level).alias("level"), "n_files", F.col("t").alias("tree_hash"), F.col("whole_size").alias("tree_size"), F.col("c").alias("code_hash"), "code_size")
        levels = own if levels is None else levels.unionByName(own)
    return levels


def shared_hashes(hashed: DataFrame) -> DataFrame:
    """Hashes (h) held by unrelated repositories: other owner and other name, so neither a fork nor a sibling.

    ``hashed``: repo_key, h. Least and greatest owner and name are enough to
    tell, and combine before the shuffle.
    """
    owner, name = F.element_at(F.split("repo_key", "/"), -2), F.element_at(F.split("repo_key", "/"), -1)
    return (
        hashed.where(F.size(F.split("repo_key", "/")) >= 2)
        .groupBy("h")
        .agg(F.min(owner).alias("o1"), F.max(owner).alias("o2"), F.min(name).alias("n1"), F.max(name).alias("n2"))
        .where("o1 <> o2 AND n1 <> n2")
        .select("h")
    )


def not_handwritten(source_files: DataFrame, depth: int | None = None) -> DataFrame:
    """Files nobody of the project wrote by hand: file_id, rule.

    rule, the first of RULES that holds: shared_tree if the file lies, however
    short, in a folder whose whole tree an unrelated repository holds (Merkle
    hashes, over all files or over those with code, to ``depth`` folders, by
    default those of the deepest file); shared_code if an unrelated repository
    holds the same code; then what the file shows alone: vendored_header,
    vendored_folder, generated_header, generated_name, minified, data,
    generated_layout. Less shared content than LEAST_SHARED characters, in the
    file or the whole tree, tells nothing. `.json`, `.toml` and `.md` are part
    of trees but never a case, nor is a file without content. Rows with a null
    file_id, file_path or content are ignored; of several rows of a file_id
    that of the last ingested_at holds; a null repo_key belongs to no
    repository; an empty table gives no rows.
    """
    rows = source_files.where("file_id IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL").select("file_id", "repo_key", "file_path", "content", "ingested_at")
    schema = f"file_id bigint, repo_key string, file_path string, ingested_at {dict(rows.dtypes)['ingested_at']}, rule string, whole_hash bigint, whole_size bigint, coded boolean"
    facts = ["repo_key", "file_path", "rule", "whole_hash", "whole_size", "coded"]
    files = (
        rows.mapInArrow(_examine, schema)
        .groupBy("file_id")
        .agg(F.max(F.struct("ingested_at", *facts)).alias("last"))
        .select("file_id", *[F.col(f"last.{c}").alias(c) for c in facts])
        .persist()
    )
    hashed = files.where("whole_hash IS NOT NULL AND repo_key IS NOT NULL")
    parts = F.split("file_path", "/")
    if depth is None:
        depth = (hashed.agg(F.max(F.size(parts))).first()[0] or 1) - 1
    of_code = lambda c: F.when(F.col("coded"), F.col(c))
    levels = merkle_levels(hashed.select("repo_key", "file_path", "whole_hash", "whole_size", of_code("whole_hash").alias("code_hash"), of_code("whole_size").alias("code_size")), depth)
    folders = [levels.where(F.col(f"{k}_size") >= LEAST_SHARED).select("repo_key", "folder", F.col(f"{k}_hash").alias("h")) for k in ("tree", "code")]
    same_tree = folders[0].join(shared_hashes(folders[0]), "h", "left_semi").unionByName(folders[1].join(shared_hashes(folders[1]), "h", "left_semi")).select("repo_key", "folder").distinct()
    coded = hashed.where("coded")
    above = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    by_tree = coded.select("file_id", "repo_key", F.explode(above).alias("folder")).join(same_tree, ["repo_key", "folder"], "left_semi").select("file_id", F.lit("shared_tree").alias("rule"))
    alone = coded.where(F.col("whole_size") >= LEAST_SHARED).select("file_id", "repo_key", F.col("whole_hash").alias("h"))
    by_code = alone.join(shared_hashes(alone), "h", "left_semi").select("file_id", F.lit("shared_code").alias("rule"))
    by_rule = files.where("rule IS NOT NULL").select("file_id", "rule")
    place = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    return by_tree.unionByName(by_code).unionByName(by_rule).groupBy("file_id").agg(F.min(place).alias("place")).select("file_id", F.element_at(F.array(*map(F.lit, RULES)), F.col("place").cast("int")).alias("rule"))
