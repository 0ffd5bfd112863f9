"""Problem 2: source files that do not parse.

Files are lexed into rows, one a line; what a line holds is a text of one
character a token. Windows over a file's lines check the nesting and cut the
file into its top-level units; equal units of all files are judged once, first
by an anti-join of their adjacent token pairs with those the grammar permits,
then by the grammar's productions.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm.grammar import AFTER_BREAK, UNKNOWN
from codeweft.llm.languages import EXTENSIONS, LANGUAGES, Language
from codeweft.tables import latest_content

#: Tokens of a worker whose characters are remembered.
REMEMBERED = 200_000
LINE_FIELDS = "file_id bigint, language tinyint, line int, tokens string, net int, low int, ends boolean, joins boolean"
NAMES = tuple(LANGUAGES)


def language_of(path: Column) -> Column:
    """The language that the extension names; null for one that isn't checked."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


class _Memory(dict):
    """Characters of tokens, found once for each text."""

    def __init__(self, language: Language) -> None:
        super().__init__()
        self.language = language

    def __missing__(self, token: str) -> str:
        if len(self) > REMEMBERED:
            self.clear()
        char = self[token] = self.language.char(token)
        return char


class _Facts(dict):
    """(net depth, lowest depth, may end a unit, goes on with the unit before) of lines, found once for each."""

    def __init__(self, lexer: Lexer) -> None:
        super().__init__()
        self.lexer = lexer

    def __missing__(self, line: str) -> tuple[int, int, int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        lexer = self.lexer
        edges = (int(_plain(line[-1]) in lexer.ends and line[0] not in lexer.leads), int(_plain(line[0]) in lexer.joins)) if line else (0, 0)
        facts = self[line] = (*lexer.nesting(line), *edges)
        return facts


class Lexer:
    """Cuts the text of one language into lines of token characters."""

    def __init__(self, language: Language) -> None:
        self.language, self.memory, self.match = language, _Memory(language), re.compile(language.lexer)
        code = language.grammar.code
        self.ends = frozenset(code[t] for t in language.ends if t in code)
        self.joins = frozenset(code[t] for t in language.joins if t in code)
        self.leads = frozenset(code[t] for t in language.leads if t in code)
        opening, closing = [code[t] for t in ("(", "[", "{", "<indent>") if t in code], [code[t] for t in (")", "]", "}", "<dedent>") if t in code]
        self.step = dict.fromkeys(opening, 1) | dict.fromkeys(closing, -1)
        self.facts = _Facts(self)
        self.bracket = re.compile("[" + re.escape("".join(self.step)) + "]")
        self.finishes = frozenset(code[t] for t in ("<id>", "<num>", "<str>", ")", "]", "}", "return", "break", "continue", "fallthrough", "++", "--") if t in code)

    def lines(self, text: str) -> list[str]:
        """The lines that hold a token; line breaks are resolved as the language does."""
        name, code = self.language.name, self.language.grammar.code
        if name == "Python":
            return self._indented(text)
        plain = [x for x in "".join(map(self.memory.__getitem__, self.match.findall(text))).split("\n") if x]
        if name == "Go":
            return [x + code[";"] if x[-1] in self.finishes else x for x in plain]
        if name == "TOML":
            doubled = {UNKNOWN} if _defined_twice(text) else set()
            return [x + code["<nl>"] for x in plain] + [*doubled]
        if self.language.breaks:
            return plain[:1] + [chr(ord(x[0]) + AFTER_BREAK) + x[1:] for x in plain[1:]]
        return plain

    def _indented(self, text: str) -> list[str]:
        code = self.language.grammar.code
        nl, deeper, back = code["<nl>"], code["<indent>"], code["<dedent>"]
        widths, lines, line, depth, width, fresh = [0], [], "", 0, 0, True
        for token in self.match.findall(text):
            if token == "\n":
                if line and depth <= 0:
                    lines.append(line + nl)
                    line = ""
                if depth <= 0:
                    fresh, width = True, 0
                continue
            char = self.memory[token]
            if not char:
                if fresh and not line and token[0] in " \t\f":
                    width = len(token.expandtabs(8))
                continue
            if fresh:
                fresh = False
                if width > widths[-1]:
                    widths.append(width)
                    line = deeper
                elif width < widths[-1]:
                    while width < widths[-1]:
                        widths.pop()
                        lines[-1] += back
                    if width != widths[-1]:
                        line = UNKNOWN
            line += char
            depth += self.step.get(char, 0)
        if line:
            lines.append(line + nl)
        if lines:
            lines[-1] += back * (len(widths) - 1)
        return lines

    def nesting(self, line: str) -> tuple[int, int]:
        """How a line changes the depth, and the lowest depth within it."""
        net = low = 0
        if ord(line[:1] or " ") > AFTER_BREAK:
            line = _plain(line[0]) + line[1:]
        for bracket in self.bracket.findall(line):
            net += self.step[bracket]
            if net < low:
                low = net
        return net, low


TOML_LINE = re.compile(r"[ \t]*(?:\[\[([^\]\n]+)\]\]|\[([^\]\n]+)\]|([\w-]+(?:[ \t]*\.[ \t]*[\w-]+)*)[ \t]*=)[^\n]*")


def _defined_twice(text: str) -> bool:
    """Whether a TOML text defines a table or a plain key of one table twice, which its syntax forbids."""
    table, seen = "", set()
    for line in text.split("\n"):
        m = TOML_LINE.match(line)
        if not m:
            continue
        if m[1]:
            table = f"{m[1].strip()}#{len(seen)}"
            continue
        name = ("table", table := m[2].strip()) if m[2] else (table, re.sub(r"\s", "", m[3]))
        if name in seen:
            return True
        seen.add(name)
    return False


def _plain(char: str) -> str:
    return chr(ord(char) - AFTER_BREAK) if ord(char) > AFTER_BREAK else char


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    lexers: dict[str, Lexer] = {}
    names = [f.split()[0] for f in LINE_FIELDS.split(", ")]
    for batch in batches:
        ids, languages, counts, lines, facts = [], [], [], [], []
        for file_id, language, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "language", "content"))):
            lexer = lexers.get(language)
            if lexer is None:
                lexer = lexers[language] = Lexer(LANGUAGES[language])
            own = lexer.lines(content.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")) or [""]
            ids.append(file_id)
            languages.append(NAMES.index(language))
            counts.append(len(own))
            lines += own
            facts += map(lexer.facts.__getitem__, own)
        if not ids:
            continue
        counts = np.array(counts)
        net, low, ends, joins = np.array(facts, dtype=np.int32).T
        at = np.arange(len(lines)) - np.repeat(np.cumsum(counts) - counts, counts)
        columns = (np.repeat(ids, counts), np.repeat(np.array(languages, dtype=np.int8), counts), at.astype(np.int32), lines, net.copy(), low.copy(), ends == 1, joins == 1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def token_lines(files: DataFrame) -> DataFrame:
    """Lines of tokens of ``files`` (file_id, language, content); a file without tokens gives one empty line."""
    return files.select("file_id", "language", "content").mapInArrow(_lex, LINE_FIELDS)


def top_units(lines: DataFrame) -> DataFrame:
    """Top-level units by windows over each file's lines: file_id, language, unit, tokens, unnested.

    The running depth may not fall below 0 and must end at 0: else
    ``unnested`` is set. A unit ends where the depth is 0 after a token that
    can end one, unless the next line goes on with it.
    """
    along = Window.partitionBy("file_id").orderBy("line")
    deep = lines.withColumn("depth", F.sum("net").over(along)).withColumn("next_joins", F.lead("joins").over(along))
    cut = F.col("ends") & (F.col("depth") == 0) & ~F.coalesce("next_joins", F.lit(False))
    numbered = deep.withColumn("unit", F.sum(cut.cast("int")).over(along) - cut.cast("int"))
    broken = (F.col("depth") - F.col("net") + F.col("low") < 0) | (F.col("next_joins").isNull() & (F.col("depth") != 0))
    parts = F.array_sort(F.collect_list(F.struct("line", "tokens")))
    return (
        numbered.withColumn("broken", broken)
        .groupBy("file_id", F.element_at(F.array(*map(F.lit, NAMES)), F.col("language") + 1).alias("language"), "unit")
        .agg(F.array_join(F.transform(parts, lambda p: p["tokens"]), "").alias("tokens"), F.max("broken").alias("unnested"))
    )


def permissible_pairs(spark: SparkSession) -> DataFrame:
    """(language, pair) as the grammars derive them; bounded by the grammars, not by data."""
    rows = [(name, a + b) for name, language in LANGUAGES.items() for a, b in language.grammar.pairs]
    return spark.createDataFrame(rows, "language string, pair string")


def misplaced(units: DataFrame) -> DataFrame:
    """Files whose order of units is wrong: file_id, language. Go has one package clause, first, then imports; Java at most one, first."""
    kind = F.lit(2)
    for language in ("Go", "Java"):
        code = LANGUAGES[language].grammar.code
        begin = F.substring("tokens", 1, 1)
        kind = F.when((F.col("language") == language) & (begin == code["package"]), 0).when((F.col("language") == language) & (begin == code["import"]), 1).otherwise(kind)
    by_file = units.where("language IN ('Go', 'Java') AND tokens <> ''").withColumn("kind", kind)
    at = lambda k, how: how(F.when(F.col("kind") == k, F.col("unit")))
    facts = by_file.groupBy("file_id", "language").agg(at(0, F.min).alias("p1"), at(0, F.max).alias("p2"), at(1, F.min).alias("i1"), at(1, F.max).alias("i2"), at(2, F.min).alias("d1"))
    wrong = (F.col("p2") > 0) | (F.col("i2") > F.col("d1")) | ((F.col("language") == "Go") & F.col("p1").isNull())
    return facts.where(F.coalesce(wrong, F.lit(False))).select("file_id", "language")


def _produced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the units that no production of their grammar gives."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    known: dict[str, Callable[[str], bool]] = {}
    for batch in batches:
        keep = []
        for n, (language, tokens) in enumerate(zip(batch.column("language").to_pylist(), batch.column("tokens").to_pylist())):
            if language not in known:
                known[language] = LANGUAGES[language].grammar.recogniser()
            if not (known[language](tokens) if tokens else not LANGUAGES[language].filled):
                keep.append(n)
        if keep:
            yield batch.select(["h1", "h2"]).take(pa.array(keep))


def parse_status(source_files: DataFrame) -> DataFrame:
    """Files that aren't valid syntax for the language of their extension: file_id, language, code.

    code: E_NESTING (brackets or blocks), E_ORDER (clauses in a wrong place),
    E_TOKEN_PAIR (neighbours the grammar doesn't permit) or E_PRODUCTION (no
    production gives a unit); of several, the first of these. Markdown is always
    valid, other extensions aren't judged. Rows with a null file_id, file_path
    or content are ignored; of several rows of a file_id that of the last
    ingested_at holds; an empty table gives no rows.
    """
    judged = source_files.withColumn("language", language_of(F.col("file_path"))).where("language IS NOT NULL AND language <> 'Markdown'")
    files = latest_content(judged, ["language", "content"])
    hashed = [F.xxhash64("language", "tokens").alias("h1"), F.hash("tokens", "language").alias("h2")]
    units = top_units(token_lines(files)).select("*", *hashed).persist()
    kinds = units.groupBy("h1", "h2").agg(F.min("language").alias("language"), F.min("tokens").alias("tokens"))
    plain = F.translate("tokens", *_without_breaks())
    pairs = kinds.where(F.length("tokens") > 1).select("h1", "h2", "language", plain.alias("tokens")).select("h1", "h2", "language", F.explode(F.array_distinct(F.regexp_extract_all("tokens", F.lit("(?s)(?=(..))"), F.lit(1)))).alias("pair"))
    unpaired = pairs.join(F.broadcast(permissible_pairs(source_files.sparkSession)), ["language", "pair"], "left_anti").select("h1", "h2").distinct()
    paired = kinds.join(unpaired, ["h1", "h2"], "left_anti")
    unproduced = paired.select("h1", "h2", "language", "tokens").mapInArrow(_produced, "h1 bigint, h2 int")
    wrong = unpaired.select("h1", "h2", F.lit(3).alias("code")).unionByName(unproduced.select("h1", "h2", F.lit(4).alias("code")))
    found = (
        units.where("unnested").select("file_id", "language", F.lit(1).alias("code"))
        .unionByName(misplaced(units).select("file_id", "language", F.lit(2).alias("code")))
        .unionByName(units.select("file_id", "language", "h1", "h2").join(wrong, ["h1", "h2"]).select("file_id", "language", "code"))
        .groupBy("file_id")
        .agg(F.min("code").alias("code"), F.min("language").alias("language"))
    )
    names = F.element_at(F.array(*map(F.lit, ("E_NESTING", "E_ORDER", "E_TOKEN_PAIR", "E_PRODUCTION"))), F.col("code"))
    return found.select("file_id", "language", names.alias("code"))


def _without_breaks() -> tuple[str, str]:
    """What ``translate`` needs to drop the mark of a line break from token characters."""
    chars = sorted({c for x in LANGUAGES.values() if x.breaks for c in x.grammar.code.values()})
    return "".join(chr(ord(c) + AFTER_BREAK) for c in chars), "".join(chars)


def broken_rates(source_files: DataFrame, status: DataFrame) -> DataFrame:
    """Files and broken files by repo_key and language, with the rate; a file counts once."""
    judged = source_files.where("file_id IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL").withColumn("language", language_of(F.col("file_path"))).where("language IS NOT NULL")
    files = judged.groupBy("file_id").agg(F.max(F.struct("ingested_at", "repo_key", "language")).alias("r")).select("file_id", "r.repo_key", "r.language")
    marked = files.join(status.select("file_id", F.lit(1).alias("bad")), "file_id", "left")
    return marked.groupBy("repo_key", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_broken"), F.round(F.count("bad") / F.count(F.lit(1)), 6).alias("broken_rate"))
