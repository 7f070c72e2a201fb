"""Symbol, file and keyword indexes, the overview and the Markdown of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomdex.functions import text as T

# Kinds that the overview lists, and how many symbols at most.
KEY_KINDS = ("class", "interface", "function", "struct", "trait")
KEY_SYMBOLS = 50
# Lines of a file's Markdown.
LANGUAGE_LINE, ANALYZED_LINE = "**Language:** ", "**Analyzed:** "
OVERVIEW_HEAD, DEPENDENCIES_HEAD, SYMBOLS_HEAD = "## Overview", "## Dependencies", "## Symbols"
LINE_LABEL, PURPOSE_LABEL, BEHAVIOR_LABEL = "**Line:** ", "**Purpose:** ", "**Behavior:** "
TRIVIAL_NOTE = "> **Trivial file** — no significant logic to analyze."
FAILURE_NOTES = (
    "> **Analysis failed** — this file could not be processed by the LLM.",
    "> Common causes: file exceeds the model's context window, or the LLM returned unparseable output.",
    "> Re-run the workflow with a larger context window or a cloud provider to analyze this file.",
)
# Fixed value: the overview of a file that is not worth a model call.
TRIVIAL_OVERVIEW = "Trivial or empty file with no significant logic."


def keyword_refs(rows: DataFrame, text: str, ref: str) -> DataFrame:
    """(word, ref), distinct: words of ``text`` with the reference they lead to."""
    return T.exploded_words(rows, text, F.col(ref).alias("ref")).distinct()


def keyword_index(rows: DataFrame, text: str, ref: str, block: Column | None = None) -> DataFrame:
    """(word, block, n_refs, refs): the inverted index as stored, references sorted.

    A word that leads to very many references has them in several rows, one a ``block``, so that no
    task gathers them all; without one there is a single block. ``keyword_refs`` is the long form.
    """
    b = (F.lit(0) if block is None else block).alias("block")
    words = T.exploded_words(rows, text, F.col(ref).alias("ref"), b)
    return words.groupBy("word", "block").agg(F.array_sort(F.collect_set("ref")).alias("refs")).select("word", "block", F.size("refs").cast("long").alias("n_refs"), "refs")


def symbol_text() -> Column:
    """What a symbol's keywords are taken from."""
    return F.concat_ws(" ", "name", "purpose", "behavior", F.coalesce("limitations", F.lit("")))


def symbol_index(symbols: DataFrame, block: Column | None = None) -> DataFrame:
    """(name, entries): all symbols of a name in scan order; symbols (name, kind, file, line, purpose, behavior, limitations, seq, pos).

    A name with very many symbols has them in several rows, one a ``block`` (then a column), so that no task gathers them all.
    """
    entry = F.struct("seq", "pos", "kind", "file", "line", "purpose", "behavior", "limitations")
    by = ["name"] if block is None else ["name", block.alias("block")]
    return symbols.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def file_index(contexts: DataFrame, importers: DataFrame) -> DataFrame:
    c = contexts.join(importers, "path", "left")
    return c.withColumn("imported_by", F.coalesce("imported_by", F.array().cast("array<string>"))).withColumn("context_file", F.concat(F.lit("context/"), F.col("path"), F.lit(".md")))


def index_totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return files.agg(F.count_distinct("path").alias("total_files")).select("total_files", symbols.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_symbols"))


def files_by_directory(files: DataFrame, block: Column | None = None) -> DataFrame:
    """(dir, n_files, paths), paths sorted; a very large folder has several rows, one a ``block`` (then a column)."""
    by = [T.dirname(F.col("path")).alias("dir")] + ([] if block is None else [block.alias("block")])
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list("path")).alias("paths"))


def key_symbols(symbols: DataFrame, most: int = KEY_SYMBOLS) -> DataFrame:
    """The first ``most`` symbols of the listed kinds in scan order."""
    return symbols.where(F.col("kind").isin(*KEY_KINDS)).orderBy("seq", "pos").limit(most)


def search(index: DataFrame, terms: DataFrame, most: int | None = None) -> DataFrame:
    """(query, ref, score): references by how many of a query's words lead to them, all or the best ``most`` (then by ref). index: (word, ref); terms: (query, text)."""
    words = T.exploded_words(terms, "text", "query")
    found = words.join(index, "word").groupBy("query", "ref").agg(F.count(F.lit(1)).alias("score"))
    if most is None:
        return found
    best = W.partitionBy("query").orderBy(F.desc("score"), "ref")  # Spark keeps ``most`` rows a query in each task before it deals them
    return found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= most).drop("rn")


def markdown() -> Column:
    """A context as Markdown; columns path, language, overview, dependencies, symbols, analyzed_at, chunk_count."""
    c = F.col
    head = F.array(F.concat(F.lit("# "), c("path")), F.concat(F.lit(LANGUAGE_LINE), c("language"), F.lit("  ")), F.concat(F.lit(ANALYZED_LINE), c("analyzed_at"), F.lit("  ")), F.lit(""))
    none = F.array().cast("array<string>")
    bare = (c("chunk_count") == 0) & (c("overview") == TRIVIAL_OVERVIEW)
    failed = (F.coalesce(c("overview"), F.lit("")) == "") & (F.size("symbols") == 0) & (c("chunk_count") == 0)
    failure = F.array(*(F.lit(x) for x in FAILURE_NOTES))
    overview = F.when(F.coalesce(c("overview"), F.lit("")) != "", F.array(F.lit(OVERVIEW_HEAD), c("overview"), F.lit(""))).otherwise(none)
    ticked = lambda a, sep: F.array_join(F.transform(a, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), sep)
    deps = F.when(F.size("dependencies") > 0, F.concat(F.array(F.lit(DEPENDENCIES_HEAD)), F.transform("dependencies", lambda d: F.concat(F.lit("- `"), d, F.lit("`"))), F.array(F.lit("")))).otherwise(none)

    def one(s):
        opt = lambda title, v: F.when(F.coalesce(v, F.lit("")) != "", F.array(F.concat(F.lit(f"**{title}:** "), v, F.lit("  ")))).otherwise(none)
        return F.concat(
            F.array(F.concat(F.lit("### `"), s["name"], F.lit("` *("), s["kind"], F.lit(")*"))),
            F.when(s["line"] > 0, F.array(F.concat(F.lit(LINE_LABEL), s["line"].cast("string"), F.lit("  ")))).otherwise(none),
            F.array(F.concat(F.lit(PURPOSE_LABEL), s["purpose"], F.lit("  ")), F.lit(""), F.concat(F.lit(BEHAVIOR_LABEL), s["behavior"]), F.lit("")),
            opt("Parameters", s["parameters"]), opt("Returns", s["returns"]), opt("Limitations", s["limitations"]),
            opt("Used by", F.when(F.size(F.coalesce(s["used_by"], none)) > 0, ticked(s["used_by"], ", "))), F.array(F.lit("")),
        )

    symbols = F.when(F.size("symbols") > 0, F.concat(F.array(F.lit(SYMBOLS_HEAD), F.lit("")), F.flatten(F.transform("symbols", one)))).otherwise(none)
    body = F.when(bare, F.array(F.lit(TRIVIAL_NOTE))).when(failed, failure).otherwise(F.concat(overview, deps, symbols))
    return F.array_join(F.concat(head, body), "\n")


def overview_lines(files: DataFrame) -> DataFrame:
    """(dir, place, line): the list of files of the overview, by directory and path as people sort it (Unicode collation)."""
    w = W.partitionBy("dir").orderBy(F.collate("path", "UNICODE"), "path")
    d = files.select(T.dirname(F.col("path")).alias("dir"), "path", "overview")
    return d.select("dir", F.row_number().over(w).alias("place"), F.concat(F.lit("- **`"), F.col("path"), F.lit("`** — "), T.inline_overview(F.col("overview"))).alias("line"))


def overview(index_files: DataFrame, symbols: DataFrame, stats: DataFrame, generated_at: str) -> DataFrame:
    """(section, key, place, line): the overview as sorted rows, to be written in their order."""
    t = stats.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"- **{title}:** "), F.col(c).cast("string")).alias("line")) for i, (title, c) in enumerate((("Total files analyzed", "total_files"), ("Total symbols indexed", "total_symbols"), ("Dependency edges", "total_edges")))))).alias("x")).select("x.*")
    head = stats.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(x).alias("line")) for i, x in enumerate(("# Codebase Semantic Context", "", f"> Last updated: {generated_at}", "", "## Codebase Stats"))))).alias("x")).select("x.*")
    section = lambda d, n: d.select(F.lit(n).alias("section"), F.lit("").alias("key"), F.col("place").cast("long").alias("place"), "line")
    lines = overview_lines(index_files)
    dirs = lines.select("dir").distinct().select(F.lit(2).alias("section"), F.col("dir").alias("key"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("### `"), F.col("dir"), F.lit("/`")).alias("line"))
    listed = lines.select(F.lit(2).alias("section"), F.col("dir").alias("key"), F.col("place").cast("long"), "line")
    top = key_symbols(symbols).select(F.lit(3).alias("section"), F.lit("").alias("key"), F.col("pos").cast("long").alias("place"), F.concat(F.lit("- **`"), F.col("name"), F.lit("`** ("), F.col("kind"), F.lit(") in `"), F.col("file"), F.lit("` — "), F.col("purpose")).alias("line"))
    return section(head, 0).unionByName(section(t, 1)).unionByName(dirs).unionByName(listed).unionByName(top)
