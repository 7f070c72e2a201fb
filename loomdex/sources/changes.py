"""Change tables: name-status lines, snapshots, and which files need work."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def name_status(lines: DataFrame) -> DataFrame:
    """(path, change) from lines such as 'M\\tsrc/a.ts'; a rename or copy is an addition, a rename also a deletion."""
    f = F.split("line", "\t")
    kind = F.substring(f[0], 1, 1)
    one = F.array(F.struct(F.element_at(f, 2).alias("path"), F.when(kind == "A", "added").when(kind == "D", "deleted").otherwise("modified").alias("change")))
    gone = F.struct(F.element_at(f, 2).alias("path"), F.lit("deleted").alias("change"))
    new = F.struct(F.try_element_at(f, F.lit(3)).alias("path"), F.lit("added").alias("change"))
    pair = F.when(kind == "R", F.array(gone, new)).when(kind == "C", F.array(new)).otherwise(one)
    return lines.where(F.size(f) >= 2).select(F.explode(pair).alias("c")).select("c.path", "c.change").where("path IS NOT NULL")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two tables (path, content_hash)."""
    j = old.select("path", F.col("content_hash").alias("was")).join(new.select("path", F.col("content_hash").alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return j.select("path", change.alias("change")).where("change IS NOT NULL")


def changed_files(committed: DataFrame, uncommitted: DataFrame, untracked: DataFrame) -> DataFrame:
    """(path, needs_analysis, deleted) from committed and uncommitted (path, change) and untracked (path).

    An uncommitted change takes a path off the deleted, an uncommitted deletion off the work; an
    untracked file is work and leaves an earlier deletion standing.
    """
    c = committed.select("path", F.lit(0).alias("rank"), "change")
    u = uncommitted.select("path", F.lit(1).alias("rank"), "change")
    x = untracked.select("path", F.lit(2).alias("rank"), F.lit("untracked").alias("change"))
    flag = lambda rank, *kinds: F.coalesce(F.max((F.col("rank") == rank) & F.col("change").isin(*kinds)), F.lit(False))
    g = c.union(u).union(x).groupBy("path").agg(
        flag(0, "added", "modified").alias("c"), flag(0, "deleted").alias("cd"), flag(1, "added", "modified").alias("m"),
        flag(1, "deleted").alias("d"), flag(2, "untracked").alias("u"),
    )
    return g.select("path", (F.expr("(c OR m OR u) AND NOT d")).alias("needs_analysis"), F.expr("d OR (cd AND NOT m)").alias("deleted"))


def relevant(changes: DataFrame, graph_files: DataFrame, index_files: DataFrame) -> DataFrame:
    """Work that is in the graph, deletions that are in the index."""
    work = changes.where("needs_analysis").join(graph_files.select("path"), "path", "left_semi").select("path", F.lit("analyze").alias("action"))
    gone = changes.where("deleted").join(index_files.select("path"), "path", "left_semi").select("path", F.lit("delete").alias("action"))
    return work.unionByName(gone)
