"""Connected components of an edge table by alternating star contractions.

Every step is a grouping with a partial minimum and a join, so no vertex's
neighbours are ever gathered in one task; the large star hangs each larger
neighbour on the smallest one, the small star the smaller ones, until nothing
changes. Steps are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm import common


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Edges (u, v), v < u. Large star (both): every neighbour of x larger than x
    hangs on the smallest of x and its neighbours. Small star: x and its smaller
    neighbours hang on the smallest."""
    if both:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = near.join(low, "u")
    if both:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` to (node, root) of all nodes on an edge; root: the smallest node."""
    e = common.written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()

    before = mark(e)
    while True:
        e = common.written(_star(_star(e, True), False), name)
        after = mark(e)
        if after == before:
            break
        before = after
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
