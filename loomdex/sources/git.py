"""What a git repository on the driver's machine tells: branch, head, changes, blobs at a commit."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from loomdex.sources.changes import changed_files, name_status

TIMEOUT = 15
NO_BRANCH = "default"


def run(root: str, *args: str) -> str | None:
    """Output of a git command; None where it fails, takes over 15 seconds, or there is no git."""
    try:
        out = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True, text=True, timeout=TIMEOUT)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return out.stdout if out.returncode == 0 else None


def branch(root: str) -> str:
    """The branch; the short hash where none is checked out; 'default' without commits or git."""
    name = (run(root, "rev-parse", "--abbrev-ref", "HEAD") or "").strip()
    return (name if name != "HEAD" else (run(root, "rev-parse", "--short", "HEAD") or "").strip()) or NO_BRANCH


def head(root: str) -> str | None:
    return (run(root, "rev-parse", "HEAD") or "").strip() or None


def blob_hash(root: str, ref: str, path: str) -> str:
    """Hash of a file's content at ``ref``; empty where it is not there."""
    return (run(root, "rev-parse", f"{ref}:{path}") or "").strip()


def blobs(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """(path, git_hash) of all files at ``ref``; comparing with ``git_blob_hash`` of contents is an equi-join."""
    lines = (run(root, "ls-tree", "-r", "-z", ref) or "").split("\0")
    rows = [(path, meta.split(" ")[2]) for meta, _, path in (x.partition("\t") for x in lines) if path]
    return spark.createDataFrame(rows, "path string, git_hash string")


def changed(spark: SparkSession, root: str, since: str | None) -> DataFrame:
    """(path, needs_analysis, deleted) since commit ``since`` (None: the working tree's changes alone), untracked files included."""
    table = lambda text: spark.createDataFrame([(x,) for x in (text or "").split("\n") if x], "line string")
    committed = run(root, "diff", "--name-status", since, "HEAD") if since else None
    untracked = (run(root, "ls-files", "--others", "--exclude-standard") or "").split("\n")
    new = spark.createDataFrame([(x,) for x in untracked if x], "path string")
    return changed_files(name_status(table(committed)), name_status(table(run(root, "diff", "--name-status", "HEAD"))), new)


def probe(root: str):
    """What ``streaming.events.poll`` asks at each tick."""
    return lambda: (branch(root), head(root) or "")
