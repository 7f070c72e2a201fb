"""Connected components over an edge table, distributed, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomdex.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node reachable, for every node of ``edges`` (a, b), ids of any ordered type.

    Large-star and small-star rounds (Kiveris et al. 2014), each one shuffle on the node; a hub's
    neighbours are kept as rows, never gathered into one value. Ends when the edges stop changing.
    No edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = cut(e)
    was = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(down, large.a == down.n)
        e = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        )
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
