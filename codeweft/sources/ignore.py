"""Ignore rules: ordered globs, the last match wins; a path's own match beats its folders'."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _expression(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


class IgnoreRules:
    """Rules in the notation of ignore files."""

    def __init__(self, lines: Iterable[str]) -> None:
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in lines:
            text = line.rstrip("\n").rstrip()
            if not text or text.startswith("#"):
                continue
            negated = text.startswith("!")
            text = text.removeprefix("!").removeprefix("\\")
            only_folders = text.endswith("/")
            text = text.rstrip("/")
            anchored = "/" in text
            text = text.lstrip("/")
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + _expression(text)), negated, only_folders))

    def _last(self, path: str, folder: bool) -> bool | None:
        for pattern, negated, only_folders in reversed(self.rules):
            if (folder or not only_folders) and pattern.fullmatch(path):
                return not negated
        return None

    def ignored(self, path: str, folder: bool = False) -> bool:
        own = self._last(path, folder)
        if own is not None:
            return own
        parts = path.split("/")
        return any(self._last("/".join(parts[:n]), True) for n in range(len(parts) - 1, 0, -1))


def is_ignored(path: Column, lines: list[str]) -> Column:
    """Whether a path is ignored by the rules; false for null."""

    @F.pandas_udf("boolean")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules = IgnoreRules(lines)
        for paths in batches:
            yield paths.map(lambda p: p is not None and rules.ignored(p)).astype(bool)

    return check(path)


VENDORED = r"(^|/)(node_modules|vendor|third_party|thirdparty)/|[^/]+/(libc|libcxx|libcxxabi|libunwind)/"


def is_vendored(path: Column) -> Column:
    """Folders that hold other projects, at any depth; some only below the top."""
    return F.coalesce(path.rlike(VENDORED), F.lit(False))


#: Folders that hold what a build makes or what others wrote, unless the repository tracks them (fixed values).
AMBIGUOUS = ("build", "dist", "deps", "external")


def without_vendored(files: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """Files (file_path, ...) outside of vendored folders; those in folders of an ambiguous name stay if one of ``tracked`` (file_path) lies in the folder.

    Without ``tracked`` every file counts as tracked.
    """
    own = files.where(~is_vendored(F.col("file_path")))
    if tracked is None:
        return own
    folder = F.regexp_extract("file_path", rf"^((?:.*?/)?(?:{'|'.join(AMBIGUOUS)}))/", 1)
    held = tracked.select(folder.alias("_folder")).where("_folder <> ''").distinct()
    marked = own.withColumn("_folder", folder)
    kept = marked.where("_folder <> ''").join(held, "_folder", "left_semi")
    return marked.where("_folder = ''").unionByName(kept.select(*marked.columns)).drop("_folder")
