"""Line dedup by a suffix array over line ids; DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomdex.llm.common import bit_of, cut, dense_ranks, prefix_counts

#: A repeated run counts if it has so many lines, or one line of so many characters.
MIN_LINES = 3
MIN_CHARS = 40
BITMAP = 32768


def _key() -> list[Column]:
    """Order of documents: doc_id, null first, then text. Rows equal in both are one document that came twice."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k"), F.xxhash64("text").alias("th")]


def _later(rows: DataFrame, *names: str) -> DataFrame:
    """(k, th, pos) of the rows whose ``names`` came before, at a lesser (k, th, pos)."""
    at = F.struct("k", "th", "pos")
    first = rows.groupBy(*names).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # written first, so that the join has an exchange on either side and Spark may split a hot class
    return rows.join(cut(first), list(names)).where(at > F.col("first")).select("k", "th", "pos")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k, th, pos) of the lines to delete: those in a later copy of a repeated run.

    Only lines that occur twice can lie in a repeated run, so the suffix array covers these alone.
    Level 0 ranks line ids; each doubling ranks pairs (rank here, rank 2^j lines on), so equal ranks
    are the suffix-array intervals whose longest common prefix is at least 2^j lines. Intervals
    of lcp >= min_lines come from two overlapping ranks; longer maximal runs are unions of those,
    so the array is not refined beyond the threshold. All but the first suffix of an interval are
    later copies.
    """
    lines = docs.select(*_key(), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    t = cut(lines.select("k", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.length("line").alias("n")))
    twice = t.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ids = dense_ranks(twice, "h1", "h2")
    r = cut(t.join(ids, ["h1", "h2"]).select("k", "th", "pos", "n", "rank").dropDuplicates(["k", "th", "pos"]))
    out = _later(r.where(F.col("n") >= min_chars), "rank")
    if min_lines == 1:
        return out.union(_later(r, "rank")).distinct()
    length = 1
    ahead = lambda d: F.max("rank").over(W.partitionBy("k", "th").orderBy("pos").rangeBetween(d, d))
    while 2 * length <= min_lines:
        pairs = r.select("k", "th", "pos", F.col("rank").alias("a"), ahead(length).alias("b")).where("b IS NOT NULL")
        pairs = cut(pairs)
        names = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        r = cut(pairs.join(dense_ranks(names, "a", "b"), ["a", "b"]).select("k", "th", "pos", "rank"))
        length *= 2
    if length < min_lines:
        blocks = r.select("k", "th", "pos", F.col("rank").alias("a"), ahead(min_lines - length).alias("b")).where("b IS NOT NULL")
        runs = _later(blocks, "a", "b")
    else:
        runs = _later(r, "rank")
    covered = runs.select("k", "th", F.explode(F.sequence(F.col("pos"), F.col("pos") + min_lines - 1)).alias("pos"))
    return out.union(covered).distinct()


def _lines(docs: DataFrame) -> DataFrame:
    """(k, th, pos, line) of lines that occur twice, line being the rank of the line's id."""
    lines = docs.select(*_key(), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).dropDuplicates(["k", "th", "pos"])
    t = cut(lines.select("k", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")))
    twice = t.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return t.join(dense_ranks(twice, "h1", "h2"), ["h1", "h2"]).select("k", "th", "pos", F.col("rank").alias("line"))


def suffix_array(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The suffix array over line ids: (k, th, pos, rank, rem) in its order, and the classes of each round.

    Suffixes begin at lines that occur twice and end before the first that does not, ``rem`` lines
    on. A round doubles the length by which suffixes are told apart: only classes of more than one
    take part, ranked within by the rank that many lines ahead, so ranks never change once they
    are alone; classes that end together are settled too. Rounds go on until nothing is open. Documents
    without an open suffix leave the rounds. Class j of a suffix, (k, th, pos, rank), tells which
    others begin with the same 2^j lines.
    """
    lines = _lines(docs)
    island = W.partitionBy("k", "th", F.col("pos") - F.col("nth"))
    r = lines.withColumn("nth", F.row_number().over(W.partitionBy("k", "th").orderBy("pos")))
    r = cut(r.withColumn("rem", (F.max("pos").over(island) - F.col("pos") + 1)).drop("nth"))
    first = prefix_counts(r.groupBy("line").agg(F.count(F.lit(1)).alias("n")), "line").select("line", F.col("before").alias("rank"))
    r = cut(r.join(first, "line").select("k", "th", "pos", "rem", "rank", F.lit(True).alias("open")))
    classes, done, step = [r.select("k", "th", "pos", "rank")], [], 1
    while not r.where("open").isEmpty():
        ahead = F.max("rank").over(W.partitionBy("k", "th").orderBy("pos").rangeBetween(step, step))
        a = cut(r.withColumn("ahead", F.when(F.col("open"), F.when(F.col("rem") > step, ahead).otherwise(-1))))
        counts = a.where("open").groupBy("rank", "ahead").agg(F.count(F.lit(1)).alias("n"))
        before = cut(prefix_counts(counts, "rank", "ahead"))
        base = before.groupBy("rank").agg(F.min("before").alias("base"))
        new = cut(before.join(base, "rank").select("rank", "ahead", "n", (F.col("rank") + F.col("before") - F.col("base")).alias("new")))
        opened = a.where("open").join(new, ["rank", "ahead"]).select("k", "th", "pos", "rem", F.col("new").alias("rank"), ((F.col("n") > 1) & (F.col("ahead") >= 0)).alias("open"), (F.col("n") > 1).alias("shared"))
        both = cut(opened.union(a.where("NOT open").select("k", "th", "pos", "rem", "rank", "open", F.lit(False))))
        classes.append(both.where("shared").select("k", "th", "pos", "rank"))
        live = both.where("open").select("k", "th").distinct()
        done.append(both.join(live, ["k", "th"], "left_anti").select("k", "th", "pos", "rank", "rem"))
        r = cut(both.join(live, ["k", "th"], "left_semi").drop("shared"))
        step *= 2
    done.append(r.select("k", "th", "pos", "rank", "rem"))
    return cut(functools.reduce(DataFrame.union, done)), classes


def maximal_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, start, length): the maximal runs of at least ``min_lines`` lines that occur twice or more, lines from 0.

    A run begins at a line, is as long as the longest common prefix with any other suffix, and is not
    part of the one that begins a line before. Prefixes of neighbours in the suffix array are measured
    by the classes of the rounds, longest first; a suffix's longest is that with a neighbour.
    Rows equal in doc_id and text are one document; null doc_id is kept; null text has no lines; an
    empty table gives no rows.
    """
    sa, classes = suffix_array(docs)
    order = ["rank", "k", "th", "pos"]
    rows = cut(prefix_counts(sa.select(*order, "rem", F.lit(1).alias("n")), *order).select(*order, "before").join(sa.select("k", "th", "pos", "rem"), ["k", "th", "pos"]))
    names = ("k", "th", "pos", "rem")
    one = rows.select("before", *(F.col(c).alias(f"{c}1") for c in names))
    two = rows.select((F.col("before") - 1).alias("before"), *(F.col(c).alias(f"{c}2") for c in names))
    pairs = one.join(two, "before").withColumn("same", F.lit(0))
    for j in reversed(range(len(classes))):
        side = lambda i: classes[j].select(F.col("k").alias(f"k{i}"), F.col("th").alias(f"th{i}"), F.col("pos").alias(f"at{i}"), F.col("rank").alias(f"r{i}"))  # noqa: B023, E731
        for i in (1, 2):
            pairs = pairs.withColumn(f"at{i}", F.col(f"pos{i}") + F.col("same")).join(side(i), [f"k{i}", f"th{i}", f"at{i}"], "left")
        pairs = cut(pairs.withColumn("same", F.col("same") + F.when(F.col("r1") == F.col("r2"), 1 << j).otherwise(0)).drop("at1", "at2", "r1", "r2"))
    same = F.least("same", "rem1", "rem2")
    ends = pairs.select(F.explode(F.array(*(F.struct(*(F.col(f"{c}{i}").alias(c) for c in ("k", "th", "pos"))) for i in (1, 2)))).alias("s"), same.alias("length"))
    longest = ends.groupBy("s").agg(F.max("length").alias("length")).select("s.*", "length").where(F.col("length") >= min_lines)
    above = F.max("length").over(W.partitionBy("k", "th").orderBy("pos").rangeBetween(-1, -1))
    runs = longest.withColumn("above", above).where(F.coalesce(F.col("above") != F.col("length") + 1, F.lit(True)))
    ids = docs.select("doc_id", *_key()).distinct()
    return runs.join(ids, ["k", "th"]).select("doc_id", F.col("pos").cast("long").alias("start"), F.col("length").cast("long").alias("length"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs``, text without later copies of repeated line runs, plus __n_lines and __n_removed.

    A line goes if it lies in min_lines consecutive lines that begin earlier anywhere (order: doc_id,
    text, line), or has min_chars characters and occurs earlier. Lines end at \\n alone. Null text
    stays null with 0 lines; empty text is one empty line; a document whose lines all go has empty
    text; rows equal in doc_id and text are treated alike and are no copies of each other; other
    columns pass through. Columns named __* are reserved.
    """
    gone = repeated_lines(docs, min_lines, min_chars)
    maps = gone.groupBy("k", "th", F.floor(F.col("pos") / BITMAP).alias("m")).agg(F.bitmap_construct_agg(F.bitmap_bit_position((F.col("pos") + 1).cast("long"))).alias("bits"), F.count(F.lit(1)).alias("n"))
    per = maps.groupBy(F.col("k").alias("__k"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("m", "bits")).alias("__maps"), F.sum("n").alias("__gone"))
    k, th = _key()
    d = docs.select("*", k.alias("__k"), th.alias("__th")).join(per, ["__k", "__th"], "left")

    def stays(_, i):
        mine = F.filter("__maps", lambda m: m["m"] == F.floor(i / BITMAP))
        return ~bit_of(F.get(mine, F.lit(0))["bits"], i % BITMAP)

    kept = F.when(F.col("__maps").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    rest = [kept.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return d.select(*rest, n_lines.alias("__n_lines"), F.coalesce("__gone", F.lit(0)).cast("long").alias("__n_removed"))


ORACLE = f"""
with s as (select doc_id, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from s),
b as (select *, lead(line, 1) over w as l1, lead(line, {MIN_LINES - 1}) over w as l2 from l window w as (partition by doc_id order by pos)),
f as (select *, row_number() over (partition by line order by doc_id, pos) > 1 and length(line) >= {MIN_CHARS} as long_copy,
 l2 is not null and row_number() over (partition by line, l1, l2 order by doc_id, pos) > 1 as run_copy from b),
g as (select *, long_copy or coalesce(max(run_copy::int) over (partition by doc_id order by pos rows between {MIN_LINES - 1} preceding and current row), 0) = 1 as gone from f)
select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_removed,
 sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from g group by doc_id
"""
