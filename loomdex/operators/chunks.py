"""Symbol regions, per-symbol chunks, references, groups under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomdex.functions import text as T

SMALL_BYTES = 6000
BATCH_FILES = 6


def lines_of(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("idx", "line"))


def regions(symbols: DataFrame, files: DataFrame, attach_decorators: bool = False) -> DataFrame:
    """(path, n, name, kind, start_line, end_line), lines from 0, ends included.

    A region runs to the line before the next symbol and the last one to the end of the file. The
    first symbol keeps the decorators and comments above it; those of later ones fall to the region
    before, unless ``attach_decorators``. Symbols on one line leave the later region empty (start
    past end). Lines and windows are dealt by file; nothing is compared across files.
    """
    lines = lines_of(files)
    plain = F.when(~T.is_decorator(F.col("line")), F.col("idx"))
    above = F.coalesce(F.max(plain).over(W.partitionBy("path").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)) + 1
    starts = lines.select("path", "idx", above.alias("above"), (F.max("idx").over(W.partitionBy("path"))).alias("last"))
    s = symbols.select("path", "pos", "name", "kind", "line").join(starts.withColumn("line", F.col("idx") + 1), ["path", "line"])
    by_line = W.partitionBy("path").orderBy("line", "pos")
    upto = F.lead("above").over(by_line) - 1 if attach_decorators else F.lead("line").over(by_line) - 2
    r = s.select("path", "name", "kind", "line", "pos", "above", F.greatest("above", F.coalesce(upto, "last")).alias("end_line"))
    before = F.lag("end_line").over(by_line)
    start = F.when(F.col("above") <= before, before + 1).otherwise(F.col("above"))
    return r.select("path", (F.row_number().over(by_line) - 1).alias("n"), "name", "kind", start.alias("start_line"), "end_line")


def _between(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, F.greatest(end - start + 1, F.lit(0))), "\n")


def chunks(symbols: DataFrame, files: DataFrame, max_chars: int = 60_000, attach_decorators: bool = False) -> DataFrame:
    """(path, chunk_index, id, content, content_hash, symbol_names, start_line, end_line, preamble).

    One chunk a region, cut by lines where region and preamble pass ``max_chars``; a file without
    symbols is one chunk; trivial files have none. A file's text is split once and cut by its regions.
    """
    r = regions(symbols, files, attach_decorators)
    # the cuts of a file travel with it, so its text is joined once whatever the number of its symbols
    cuts = r.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "name", "start_line", "end_line"))).alias("regions"))
    f = files.select("path", "content").join(cuts, "path", "left").withColumn("ls", F.split("content", "\n", -1))
    first = F.get("regions", F.lit(0))["start_line"]
    f = f.withColumn("preamble", F.when(F.coalesce(first, F.lit(0)) > 0, F.array_join(F.slice("ls", F.lit(1), first), "\n")).otherwise(""))
    f = f.where(F.col("regions").isNotNull() | (F.length(T.js_trim(F.col("content"))) >= T.TRIVIAL_CHARS))
    whole = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("start_line"), (F.size("ls") - 1).alias("end_line")))
    e = f.select("path", "preamble", "ls", F.explode(F.coalesce("regions", whole)).alias("r")).select("path", "preamble", "r", _between(F.col("ls"), F.col("r.start_line"), F.col("r.end_line")).alias("text"))
    room = F.lit(max_chars) - T.utf16_length(F.col("preamble")) - 1
    pieces = F.when(F.col("r.name").isNotNull() & (T.utf16_length(F.col("text")) > room), T.chunk_lines(F.col("text"), room)).otherwise(F.array("text"))
    e = e.select("path", "preamble", "r", F.posexplode(pieces).alias("piece", "content"))
    n = (F.row_number().over(W.partitionBy("path").orderBy("r.n", "piece")) - 1).alias("chunk_index")
    names = F.when(F.col("r.name").isNull(), F.array().cast("array<string>")).otherwise(F.array("r.name")).alias("symbol_names")
    c = e.select("path", n, "content", names, F.col("r.start_line").alias("start_line"), F.col("r.end_line").alias("end_line"), "preamble")
    return c.select("path", "chunk_index", F.concat("path", F.lit("::chunk_"), F.col("chunk_index").cast("string")).alias("id"), "content", T.content_hash(F.col("content")).alias("content_hash"), "symbol_names", "start_line", "end_line", "preamble")


def references(chunk: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, chunk_index, name): imported names of three or more characters that a chunk mentions as whole words.

    Words of a chunk meet imported names by an equi-join. Names with other characters than a-z, A-Z,
    0-9 and _ are looked for by pattern among the chunks of their own file alone.
    """
    names = edges.select(F.col("src").alias("path"), F.col("dst")).join(symbols.select(F.col("path").alias("dst"), "name"), "dst").where(F.length("name") > 2).select("path", "name").distinct()
    plain = F.col("name").rlike("^[A-Za-z0-9_]+$")
    words = chunk.select("path", "chunk_index", F.explode(F.array_distinct(F.split("content", "[^A-Za-z0-9_]+"))).alias("name"))
    near = words.join(names.where(plain), ["path", "name"]).select("path", "chunk_index", "name")
    edge = lambda at, side: F.when(F.substring("name", at, 1).rlike("[A-Za-z0-9_]"), F.lit(side[0])).otherwise(F.lit(side[1]))
    pattern = F.concat(edge(1, ("(?<![A-Za-z0-9_])", "(?<=[A-Za-z0-9_])")), T.escape_regex(F.col("name")), edge(-1, ("(?![A-Za-z0-9_])", "(?=[A-Za-z0-9_])")))
    odd = chunk.select("path", "chunk_index", "content").join(names.where(~plain), "path").where(F.regexp(F.col("content"), pattern)).select("path", "chunk_index", "name")
    return near.unionByName(odd).distinct()


def dependency_context(refs: DataFrame, edges: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(path, *keys, dep_context): imports in order, each with its referenced symbols as `dep`: name(kind), ...; joined by '; '."""
    used = refs.select("path", *keys, "name").distinct().join(edges.select(F.col("src").alias("path"), F.col("pos").alias("edge"), "dst"), "path")
    named = used.join(symbols.select(F.col("path").alias("dst"), "name", "kind", "pos"), ["dst", "name"])
    group = ["path", *keys]
    dep = named.groupBy(*group, "edge", "dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "kind"))), lambda x: F.concat(x["name"], F.lit("("), x["kind"], F.lit(")"))), ", ").alias("names"))
    line = F.concat(F.lit("`"), F.col("dst"), F.lit("`: "), F.col("names"))
    return dep.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge", line.alias("line")))), lambda x: x["line"]), "; ").alias("dep_context"))


def export_context(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, dep_context) with all symbols of every import: `dep` exports: name(kind), ..."""
    dep = edges.join(symbols.select(F.col("path").alias("dst"), "name", "kind", F.col("pos").alias("at")), "dst").groupBy(F.col("src").alias("path"), "pos", "dst")
    d = dep.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "kind"))), lambda x: F.concat(x["name"], F.lit("("), x["kind"], F.lit(")"))), ", ").alias("names"))
    line = F.concat(F.lit("`"), F.col("dst"), F.lit("` exports: "), F.col("names"))
    return d.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "; ").alias("dep_context"))


def first_fit(sizes: list[int], budget: int) -> list[list[int]]:
    """Groups of chunk numbers: each starts at the first chunk left at or after the place behind the last group's start
    and takes what fits going on, then going back to the front; one separator between chunks; a chunk over the
    budget is a group of its own."""
    left, groups, at = list(range(len(sizes))), [], 0
    while left:
        start = next((i for i in left if i >= at), left[0])
        taken, used = [], 0
        for i in [*(i for i in left if i >= start), *(i for i in left if i < start)]:
            need = sizes[i] + (used > 0)
            if used + need <= budget:
                taken.append(i)
                used += need
        taken = taken or left[:1]
        gone = set(taken)
        left = [i for i in left if i not in gone]
        groups.append(taken)
        at = start + 1
    return groups


def groups(chunk: DataFrame, max_chars: int = 60_000) -> DataFrame:
    """(path, group_no, chunk_indexes, members, symbol_names, combined_content): each file's chunks packed first-fit under ``max_chars``.

    Each choice depends on the one before, so a file's sizes go through Python; its texts do not.
    """
    sizes = chunk.select("path", "chunk_index", T.utf16_length(F.col("content")).alias("size"), T.utf16_length(F.col("preamble")).alias("head"))

    def pack(frame):
        import pandas as pd

        frame = frame.sort_values("chunk_index")
        head = int(frame["head"].iloc[0])
        found = first_fit(frame["size"].tolist(), max_chars - (head + 1 if head else 0))
        rows = [(frame["path"].iloc[0], g, k, int(frame["chunk_index"].iloc[i])) for g, members in enumerate(found) for k, i in enumerate(members)]
        return pd.DataFrame(rows, columns=["path", "group_no", "place", "chunk_index"])

    placed = sizes.groupBy("path").applyInPandas(pack, "path string, group_no int, place int, chunk_index int")
    members = chunk.join(placed, ["path", "chunk_index"]).groupBy("path", "group_no")
    g = members.agg(F.first("preamble").alias("preamble"), F.array_sort(F.collect_list(F.struct("place", "chunk_index", "symbol_names", "content"))).alias("m"))
    body = F.array_join(F.transform("m", lambda x: x["content"]), "\n")
    return g.select("path", "group_no", F.transform("m", lambda x: x["chunk_index"]).alias("chunk_indexes"), F.transform("m", lambda x: F.struct(x["chunk_index"].alias("chunk_index"), x["symbol_names"].alias("symbol_names"))).alias("members"), F.flatten(F.transform("m", lambda x: x["symbol_names"])).alias("symbol_names"), F.when(F.col("preamble") == "", body).otherwise(F.concat("preamble", F.lit("\n"), body)).alias("combined_content"))


def assign(answers: DataFrame) -> DataFrame:
    """(path, chunk_index, overview, symbols) of groups (path, group_no, members, overview, symbols).

    A chunk gets the symbols whose names it declares; symbols that no chunk of the group declares, and the
    overview, go to the group's first chunk. All of it happens within a group's row.
    """
    declared = F.flatten(F.transform("members", lambda m: m["symbol_names"]))
    rest = F.filter("symbols", lambda s: ~F.array_contains(declared, s["name"]))
    d = answers.select("path", "overview", "symbols", rest.alias("rest"), F.posexplode("members").alias("place", "m"))
    own = F.filter("symbols", lambda s: F.array_contains(F.col("m.symbol_names"), s["name"]))
    first = F.col("place") == 0
    return d.select("path", F.col("m.chunk_index").alias("chunk_index"), F.when(first, F.coalesce("overview", F.lit(""))).otherwise("").alias("overview"), F.when(first, F.concat(own, "rest")).otherwise(own).alias("symbols"))


def batch_plan(files: DataFrame, small_bytes: int = SMALL_BYTES, per_batch: int = BATCH_FILES) -> DataFrame:
    """(path, seq, is_small, batch): small files numbered six to a batch in scan order; large ones alone (null).

    Numbers come from ranges of seq and one count a range, so no single task sorts all files.
    """
    from loomdex.operators.order import numbered

    small = numbered(files.where(F.col("size_bytes") <= small_bytes).select("path", "seq"), "seq").select("path", F.floor(F.col("row") / per_batch).cast("long").alias("batch"))
    return files.select("path", "seq", (F.col("size_bytes") <= small_bytes).alias("is_small")).join(small, "path", "left")
