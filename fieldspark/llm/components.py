"""Connected components of an edge table by alternating large-star and small-star steps.

Only group-by minima (combined map-side) and equi-joins are used.  The edges of a
vertex with very many neighbours are dealt over slots, never collected to a list.
Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import dealt_join, discard, share_of, written


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame, share: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")).select("a", F.least("a", "m").alias("m"), "rows")
    return dealt_join(both.where("b > a"), least, ["a"], F.xxhash64("b"), share).where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame, share: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
    linked = dealt_join(down, least, ["u"], F.xxhash64("v"), share).where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return linked.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``: every vertex of an edge with the least vertex of its component.

    Self-loops, null ends, repeated and mirrored edges are allowed (loops and nulls are ignored); vertices without an
    edge do not appear.  An empty table gives an empty result.
    """
    clean = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = written(clean.where("a is not null and b is not null and a <> b").distinct(), "cc")
    mark = _mark(now)
    if mark[0] == 0:
        return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(max_rounds):
        share = share_of(edges.sparkSession, mark[0])
        new = written(_small_star(_large_star(now, share), share), "cc")
        discard(now)
        now, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    member = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return member.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
