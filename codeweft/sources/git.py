"""Git repositories as tables: trees, blobs, history and differences.

Listing runs on the driver (a listing is a few bytes a file); blobs are read
by tasks, one ``git cat-file --batch`` process a partition, so the repository
must be readable where the tasks run.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOB_FIELDS = "file_path string, revision string, content string, n_bytes bigint"


def run(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, env=os.environ | {"LC_ALL": "C"}).stdout


def rev_parse(repo: str, revision: str) -> str:
    return run(repo, "rev-parse", "--verify", revision + "^{commit}").decode().strip()


def first_parent(repo: str, revision: str) -> str:
    return rev_parse(repo, revision + "^1")


def remote_urls(repo: str) -> list[str]:
    return sorted({line.split()[1] for line in run(repo, "remote", "-v").decode().splitlines() if line})


def find_commit(repo: str, trailer: str, value: str) -> str:
    """The newest commit whose message holds ``trailer: value``."""
    found = run(repo, "log", "--all", "-n", "1", "--format=%H", "--fixed-strings", f"--grep={trailer}: {value}").decode().strip()
    if not found:
        raise ValueError(f"no commit with {trailer}: {value}")
    return found


def list_tree(spark: SparkSession, repo: str, revision: str = "HEAD") -> DataFrame:
    """(file_path, blob_id, n_bytes) of a revision."""
    rows = []
    for entry in run(repo, "ls-tree", "-r", "-l", "-z", revision).split(b"\0"):
        if entry:
            facts, path = entry.split(b"\t", 1)
            mode, kind, blob, size = facts.split()
            if kind == b"blob" and mode != b"120000":
                rows.append((path.decode("utf-8", "replace"), blob.decode(), int(size)))
    return spark.createDataFrame(rows, "file_path string, blob_id string, n_bytes bigint")


def list_index(spark: SparkSession, repo: str) -> DataFrame:
    """Tracked paths."""
    return spark.createDataFrame([(p.decode("utf-8", "replace"),) for p in run(repo, "ls-files", "-z").split(b"\0") if p], "file_path string")


def read_blobs(paths: DataFrame, repo: str, revision: str = "HEAD") -> DataFrame:
    """Contents of ``paths`` (file_path) at a revision; a path that isn't there, or isn't text, gives null content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        git = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for batch in batches:
                names, texts, sizes = batch.column("file_path").to_pylist(), [], []
                for name in names:
                    if name is None or "\n" in name:
                        texts.append(None)
                        sizes.append(None)
                        continue
                    git.stdin.write(f"{revision}:{name}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    if head[-1] == b"missing":
                        texts.append(None)
                        sizes.append(None)
                        continue
                    data = git.stdout.read(int(head[2]))
                    git.stdout.read(1)
                    texts.append(None if b"\0" in data else data.decode("utf-8", "replace"))
                    sizes.append(len(data))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([revision] * len(names), pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=[f.split()[0] for f in BLOB_FIELDS.split(", ")])
        finally:
            git.stdin.close()
            git.wait()

    return paths.select("file_path").mapInArrow(read, BLOB_FIELDS)


def changed_files(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    """(file_status, file_path, old_path) between two revisions, renames found."""
    parts = run(repo, "diff", "--name-status", "-M", "-C", "-z", base, head).split(b"\0")
    rows, i = [], 0
    while i < len(parts) - 1:
        status = parts[i].decode()
        moved = status[0] in "RC"
        names = [p.decode("utf-8", "replace") for p in parts[i + 1 : i + 2 + moved]]
        rows.append((status[0], names[-1], names[0] if moved else None))
        i += 2 + moved
    return spark.createDataFrame(rows, "file_status string, file_path string, old_path string")


def history(spark: SparkSession, repo: str, revision: str = "HEAD", limit: int = 256) -> DataFrame:
    """(commit_id, commit_seq, file_path) of the last ``limit`` commits without merges; the latest has the greatest seq."""
    rows, commit, seq = [], "", limit
    for part in run(repo, "log", "--no-merges", "-n", str(limit), "--format=%x01%H", "--name-only", "-z", revision).split(b"\0"):
        text = part.decode("utf-8", "replace").strip("\n")
        if text.startswith("\x01"):
            commit, _, text = text[1:].partition("\n")
            seq -= 1
        if text:
            rows.append((commit, seq, text))
    return spark.createDataFrame(rows, "commit_id string, commit_seq int, file_path string")


def worktree(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, content, n_bytes) of the files below a folder; binary files have null content."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = os.path.abspath(folder).rstrip("/") + "/"
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", "\\+", "%2B")), "^file:/+", "/")
    text = F.when(F.instr(F.col("content"), F.lit("\0")) == 0, F.decode("content", "UTF-8"))
    return files.select(F.substring(path, len(root) + 1, 100000).alias("file_path"), text.alias("content"), F.col("length").alias("n_bytes"))


def tracked(spark: SparkSession, folder: str) -> DataFrame | None:
    """The tracked files of a folder, or None if it is no repository."""
    try:
        return list_index(spark, folder)
    except (subprocess.CalledProcessError, FileNotFoundError):
        return None


def source_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, content) of the source files of a folder: no binary, ignored or vendored ones, and nothing of the tools' own."""
    from pyspark.sql import functions as F

    from codeweft.sources.ignore import is_ignored, without_vendored

    rules: list[str] = []
    if os.path.exists(os.path.join(folder, ".gitignore")):
        with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
            rules = f.read().split("\n")
    files = worktree(spark, folder).where("content IS NOT NULL").where(~F.col("file_path").rlike(r"(^|/)\.(git|codeweft)/"))
    if rules:
        files = files.where(~is_ignored(F.col("file_path"), rules))
    return without_vendored(files, tracked(spark, folder)).select("file_path", "content")
