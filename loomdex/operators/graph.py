"""Import graph: specifiers resolved by equi-joins on candidate paths, reverse edges, statistics, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomdex.functions import text as T
from loomdex.operators.storage import kept

# What is tried behind a path, in this order, per language.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".go", "/index.ts", "/index.tsx", "/index.js")
PYTHON_SUFFIXES = (".py", "/__init__.py")
RUST_SUFFIXES = (".rs", "/mod.rs")


def _with(base: Column, suffixes) -> Column:
    return F.array(base, *(F.concat(base, F.lit(s)) for s in suffixes))


def candidates(src: Column, spec: Column) -> Column:
    """Paths that a relative specifier may mean, best first; null for others."""
    ext, here = T.extension(src), F.when(F.instr(src, "/") > 0, T.dirname(src)).otherwise(F.lit(""))
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    python = T.normal_path(F.concat_ws("/", here, F.repeat(F.lit("../"), dots - 1), F.replace(F.substr(spec, dots + 1), F.lit("."), F.lit("/"))))
    module = lambda head: F.replace(F.substr(spec, F.lit(len(head) + 1)), F.lit("::"), F.lit("/"))
    rust = (
        F.when(spec.startswith("super::"), _with(T.normal_path(F.concat_ws("/", here, F.lit(".."), module("super::"))), RUST_SUFFIXES))
        .when(spec.startswith("self::"), _with(T.normal_path(F.concat_ws("/", here, module("self::"))), RUST_SUFFIXES))
    )
    dotted = spec.startswith(".")
    return (
        F.when(ext == ".java", F.lit(None).cast("array<string>")).when(ext == ".rs", rust)
        .when((ext == ".py") & dotted, _with(python, PYTHON_SUFFIXES))
        .when((ext != ".py") & dotted, _with(T.normal_path(F.concat_ws("/", here, spec)), SCRIPT_SUFFIXES))
    )


def suffixes(src: Column, spec: Column) -> Column:
    """Path endings that a qualified name may mean anywhere in the tree; null for others."""
    ext = T.extension(src)
    java = F.array(F.concat(F.replace(spec, F.lit("."), F.lit("/")), F.lit(".java")))
    module = F.replace(F.substr(spec, F.lit(len("crate::") + 1)), F.lit("::"), F.lit("/"))
    return F.when((ext == ".java") & ~spec.endswith(".*"), java).when((ext == ".rs") & spec.startswith("crate::"), F.array(*(F.concat(module, F.lit(s)) for s in RUST_SUFFIXES)))


def import_edges(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, pos, dst): specifiers (src, pos, spec) resolved against files (path, seq); pos numbers a file's edges from 0.

    Each specifier takes the first of its candidates that exists and that the file does not import
    yet. Endings are looked up among the exploded endings of all paths, a hash join instead of a
    scan of the files per specifier. No more than a file's number of specifiers can be taken, so no
    more hits than that are kept for each.
    """
    s = specs.select("src", "pos", "spec")
    near = s.select("src", "pos", F.posexplode(candidates(F.col("src"), F.col("spec"))).alias("rank", "path"))
    near = near.join(files.select("path"), "path").select("src", "pos", F.col("rank").alias("r"), F.lit(None).cast(files.schema["seq"].dataType).alias("seq"), "path")
    parts = F.split("path", "/")
    ends = files.select("path", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("end"))
    far = s.select("src", "pos", F.explode(suffixes(F.col("src"), F.col("spec"))).alias("end")).join(ends, "end").groupBy("src", "pos", "path").agg(F.min("seq").alias("seq"))
    hits = near.unionByName(far.select("src", "pos", F.lit(0).alias("r"), "seq", "path"))
    many = s.groupBy("src").agg(F.count(F.lit(1)).alias("many"))
    first = hits.withColumn("rn", F.row_number().over(W.partitionBy("src", "pos").orderBy("r", "seq", "path"))).join(many, "src").where("rn <= many")
    per = first.groupBy("src", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "path"))), lambda x: x["path"]).alias("paths"))
    ordered = per.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paths"))), lambda x: x["paths"]).alias("hits"))

    def take(seen, paths):
        new = F.filter(paths, lambda p: ~F.array_contains(seen, p))
        return F.when(F.size(new) > 0, F.concat(seen, F.slice(new, 1, 1))).otherwise(seen)

    taken = F.aggregate("hits", F.array().cast("array<string>"), take)
    return ordered.select("src", F.posexplode(taken).alias("pos", "dst"))


def reverse_edges(edges: DataFrame, files: DataFrame, per_row: int | None = None) -> DataFrame:
    """(path, imported_by): importers in scan order. With ``per_row`` a hub has them in several rows, one a ``block`` of so many scan numbers."""
    e = edges.join(files.select(F.col("path").alias("src"), "seq"), "src")
    by = [F.col("dst").alias("path")] + ([] if per_row is None else [F.floor(F.col("seq") / per_row).alias("block")])
    return e.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "src"))), lambda x: x["src"]).alias("imported_by"))


def first_importers(edges: DataFrame, most: int = 10) -> DataFrame:
    """(path, used_by): a file's first ``most`` importers by scan order (src_seq, where edges have it), else by path. A hub's others never meet in one value."""
    order = ["src_seq", "src"] if "src_seq" in edges.columns else ["src"]
    e = edges.select(F.col("dst").alias("path"), *order).distinct()
    e = e.withColumn("rn", F.row_number().over(W.partitionBy("path").orderBy(*order))).where(F.col("rn") <= most)
    return e.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "src"))), lambda x: x["src"]).alias("used_by"))


def graph_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    f, s, e = count(files, "total_files"), count(symbols, "total_symbols"), count(edges, "total_edges")
    return f.select("total_files", s.scalar().alias("total_symbols"), e.scalar().alias("total_edges"))


def levels(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, level): length of the longest import walk from a file, however long; null on a cycle and for what imports from one.

    Each round takes away the edges to files that have a level; a file whose last edge went gets the round's number.
    Rounds are as many as the longest chain without cycles has files; each is checkpointed, so plans stay short.
    """
    nodes = kept(files.select("path").distinct())
    rest = kept(edges.select("src", "dst").join(nodes.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst").distinct())
    done = nodes.join(rest.select(F.col("src").alias("path")), "path", "left_anti")
    out, k = done.withColumn("level", F.lit(0)), 0
    while not rest.isEmpty():
        ended = done.select(F.col("path").alias("dst"))
        freed = rest.join(ended, "dst", "left_semi").select("src").distinct()
        rest = kept(rest.join(ended, "dst", "left_anti").select("src", "dst"))
        done = kept(freed.join(rest, "src", "left_anti").select(F.col("src").alias("path")))
        if done.isEmpty():
            break
        k += 1
        out = out.unionByName(done.withColumn("level", F.lit(k)))
    return out.unionByName(rest.select(F.col("src").alias("path")).distinct().withColumn("level", F.lit(None).cast("int")))


def dependency_order(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, position): depth-first post-order over files in scan order, imports first, cycles cut where met.

    The order is one walk, so it runs in one task and holds the paths and edges in memory; ``levels``
    is the distributed alternative.
    """
    rows = files.select("path", "seq").join(edges.groupBy(F.col("src").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("deps")), "path", "left")

    def walk(frame):
        import pandas as pd

        frame = frame.sort_values("seq")
        deps = {p: list(d) if d is not None else [] for p, d in zip(frame["path"], frame["deps"], strict=True)}
        out, seen = [], set()
        for root in deps:
            stack = [] if root in seen else [(root, iter(deps[root]))]
            seen.add(root)
            while stack:
                node, rest = stack[-1]
                child = next((c for c in rest if c in deps and c not in seen), None)
                if child is None:
                    out.append(node)
                    stack.pop()
                else:
                    seen.add(child)
                    stack.append((child, iter(deps[child])))
        return pd.DataFrame({"path": out, "position": range(len(out))})

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(walk, "path string, position long")
