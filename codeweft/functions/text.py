"""Scalar functions over names, paths and texts, as columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: folder and file names that mark tests
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "testdata")
CALL_RELATIONS = ("CALLS", "CONSTRUCTS")
CENTRAL_RELATIONS = ("CALLS", "ASYNC_CALLS", "IMPLEMENTS", "OVERRIDES")
TYPE_KINDS = ("class", "interface", "struct", "trait", "type", "enum", "record", "object", "protocol")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_path(path: Column) -> Column:
    """Whether a path is that of a test by convention; false for null. The stem rule minds letter case."""
    clean = F.trim(F.regexp_replace(path, r"/+", "/"))
    lower = F.lower(basename(clean))
    folders = rf"(?i)(^|/)({'|'.join(TEST_DIRS)})/"
    names = r"\.(test|spec)\.|_test\.(go|py)$|^test_.*\.py$|_spec\.rb$|^tests?\.rs$"
    stem = F.regexp_replace(basename(clean), r"\.[^.]*$", "")
    return F.coalesce(clean.rlike(folders) | lower.rlike(names) | stem.rlike(r"(Test|Tests|TestCase)$"), F.lit(False))


def endpoint_tier(is_external: Column, path: Column) -> Column:
    """0 production code, 1 tests, 2 what lies outside."""
    return F.when(is_external, 2).when(is_test_path(path), 1).otherwise(0)


def resolution_tier(resolution: Column) -> Column:
    return F.when(resolution == "exact", 0).when(resolution == "import_resolved", 1).otherwise(2)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "exact").when(confidence >= 0.7, "strong").when(confidence >= 0.4, "heuristic").otherwise("weak")


def short_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def external_short_name(value: Column) -> Column:
    """What follows the last of ``.:/#``, or all if nothing does."""
    tail = F.regexp_extract(value, r"[.:/#]([^.:/#]+)$", 1)
    return F.when(tail != "", tail).otherwise(value)


def search_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./:+#-]+"), F.lit(0))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_$]+"), F.lit(0))


def camel_parts(word: Column) -> Column:
    """Lower-cased parts at non-word characters, lower-to-upper and acronym borders; no empty parts."""
    parts = F.split(word, r"[^\p{L}\p{Nd}]+|(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
    return F.transform(F.filter(parts, lambda p: p != ""), F.lower)


def token_variants(word: Column) -> Column:
    """Distinct in order: the word without outer ``./:-``, its alphanumeric segments, its camel-case parts, in lower case."""
    bare = F.regexp_replace(word, r"^[./:-]+|[./:-]+$", "")
    segments = F.transform(F.filter(F.split(bare, r"[^\p{L}\p{Nd}]+"), lambda p: p != ""), F.lower)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(F.lower(bare)), segments, camel_parts(bare))))


def sparse_tokens(text: Column) -> Column:
    """Lower-cased parts of identifiers and numbers: cut at ``_``, camel-case and letter-digit borders."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_]*|[0-9]+"), F.lit(0))
    border = r"_+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
    return F.transform(F.filter(F.flatten(F.transform(words, lambda w: F.split(w, border))), lambda p: p != ""), F.lower)


def term_tokens(text: Column) -> Column:
    """All variants of all search words with at least two bytes, repeats kept."""
    return F.filter(F.flatten(F.transform(search_words(text), token_variants)), lambda t: F.octet_length(t) >= 2)


def signature_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the word sets of two signatures, to 2 places; 1 if neither has a word."""
    left, right = (F.array_distinct(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))) for x in (a, b))
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(half_up(F.size(F.array_intersect(left, right)) / union))


def half_up(value: Column) -> Column:
    """Rounds a value >= 0 half up at 2 places."""
    return F.floor(value * 100 + 0.5) / 100


def long_line_share(text: Column, limit: int = 5000) -> Column:
    """Share of the text's bytes on lines longer than ``limit`` bytes; 0 for an empty text."""
    long = F.aggregate(F.split(text, "\n"), F.lit(0), lambda n, line: n + F.when(F.octet_length(line) > limit, F.octet_length(line)).otherwise(0))
    return F.when(F.octet_length(text) > 0, long / F.octet_length(text)).otherwise(0.0)


def test_subject(name: Column) -> Column:
    """The subject a test's name tells: TestFoo, test_foo, FooTest, foo_test; null if it is no test's name."""
    return (
        F.when(name.rlike(r"^Test[A-Z0-9_]"), F.regexp_replace(name, r"^Test_?", ""))
        .when(name.rlike(r"^test_\w"), F.regexp_replace(name, r"^test_", ""))
        .when(name.rlike(r"^test[A-Z]"), F.concat(F.lower(F.substring(name, 5, 1)), F.substring(name, 6, 1000)))
        .when(name.rlike(r"\w(Tests?|TestCase)$"), F.regexp_replace(name, r"(Tests?|TestCase)$", ""))
        .when(name.rlike(r"\w_tests?$"), F.regexp_replace(name, r"_tests?$", ""))
    )


def route_parameters(path: Column) -> Column:
    """``[id]``, ``$id``, ``:id`` and ``<int:id>`` segments as ``{id}``."""
    brackets = F.regexp_replace(path, r"\[(?:\.\.\.)?([A-Za-z_]\w*)\]", "{$1}")
    typed = F.regexp_replace(brackets, r"<(?:[A-Za-z_]+:)?([A-Za-z_]\w*)>", "{$1}")
    return F.regexp_replace(typed, r"(?<=/)[$:]([A-Za-z_]\w*)", "{$1}")


def url_path(url: Column) -> Column:
    """The path of an absolute URL or path, without query and fragment; ``/`` if there is none."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(path == "", "/").otherwise(path)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
