"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loomdex.llm.common import cut, n_words

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of one source and size are ranked in blocks of about so many.
BLOCK = 5_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at ``most`` times its
    source's size and the excess is shared anew: with caps sorted by cap over weight, the level of
    the first k that holds for all later sources is found from prefix sums, so no loop is needed.
    The windows run over one row a source. All sizes zero: targets and rates 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    whole = W.partitionBy()
    by_cap = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_cap.rowsBetween(0, W.unboundedFollowing)
    t = per.select("*", w.alias("w"), cap.alias("cap"), F.sum("source_size").over(whole).alias("total"))
    t = t.select("*", ((F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(from_here)).alias("level"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    t = t.select("*", F.min_by(fits, F.when(fits.isNotNull(), F.col("cap") / F.col("w"))).over(whole).alias("found"))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("found") * F.col("w"), F.col("cap").cast("double")))
    return t.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken, and the columns ``carry``.

    Documents of a source are ranked by size; the prefix sum of expected copies is rate times rank,
    one offset a source is drawn from ``seed``, and a document is emitted once for each integer its
    step crosses (at most ceil(rate) <= ``most`` times). Ranks come from counts by (source, size,
    block of doc_id), so neither a hot source nor many equal documents meet in one task. Empty or
    null texts have size 0 and take 0 words; rows with null doc_id are dealt to blocks by text;
    repeated rows are documents of their own; empty input gives no rows. doc_id is an integer.
    """
    size = n_words(F.col("text"))
    d = cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("__th"), *carry))
    n = d.count()
    # blocks keep the order of doc_id modulo their number, so SQL can say the same
    d = d.withColumn("block", F.pmod(F.coalesce(F.col("doc_id"), F.col("__th")), F.lit(1 + n // BLOCK)))
    counts = d.groupBy("source", "size", "block").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    per_size = sizes.select("source", "size", (F.sum("n").over(W.partitionBy("source").orderBy("size")) - F.col("n")).alias("before_size"))
    in_size = counts.select("source", "size", "block", (F.sum("n").over(W.partitionBy("source", "size").orderBy("block")) - F.col("n")).alias("before_block"))
    targets = source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    start = (
        in_size.alias("b").join(per_size.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.size") == F.col("s.size")))
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.source", "b.size", "b.block", (F.col("before_size") + F.col("before_block")).alias("before"), "source_size", "target", "rate")
    )
    ranked = d.select("*", F.row_number().over(W.partitionBy("source", "size", "block").orderBy("doc_id", "__th")).alias("rn"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("d.source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rank = F.col("before") + F.col("rn")
    copies = F.floor(F.col("rate") * rank + offset) - F.floor(F.col("rate") * (rank - 1) + offset)
    return (
        ranked.alias("d").join(start.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.size") == F.col("b.size")) & (F.col("d.block") == F.col("b.block")))
        .select("d.doc_id", "d.source", "d.size", "source_size", "target", copies.cast("long").alias("copies"), *(f"d.{c}" for c in carry))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def emit(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each document's row, all columns, as often as ``mix`` emits it (not at all: gone).

    Rows are numbered and copies are looked up by that number, so rows that share a doc_id, or
    have none, are emitted as often as each of them is to be. Columns named __* are reserved.
    """
    d = cut(docs.select("*", F.monotonically_increasing_id().alias("__row")))
    c = mix(d, seed, carry=("__row",)).where("copies > 0").select("__row", F.col("copies").cast("int").alias("__copies"))
    return d.join(c, "__row").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


ORACLE = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, source_size * 3 as cap, sum(source_size) over () as total from per),
l as (select *, (total - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from w),
f as (select *, arg_min(case when level * w <= cap then level end, cap / w) filter (level * w <= cap) over () as found from l),
t as (select source, source_size, least(cap::double, coalesce(found * w, cap::double)) as target from f),
r as (select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
 ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8))::bigint / 4294967296.0::double as u,
 row_number() over (partition by d.source order by d.size, d.doc_id % (1 + n // {BLOCK}), d.doc_id) as k
 from d join t on d.source is not distinct from t.source, (select count(*) as n from d))
select doc_id, size, source_size, target, ((floor(rate * k + u) - floor(rate * (k - 1) + u)) * size)::bigint as taken from r
"""
