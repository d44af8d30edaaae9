"""Graph plans over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarto.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node id reachable; nodes without an edge to another are left out.

    Alternating large-star and small-star rounds; every round is a pair of
    aggregations with map-side combine, cut by a reliable checkpoint. Null ends
    and loops are ignored, repeated edges count once.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    x, y = F.greatest(a, b).alias("x"), F.least(a, b).alias("y")
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(x, y).distinct().checkpoint()
    mark = None
    for _ in range(max_rounds):
        both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).unionAll(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        e = small.unionAll(least.select("x", F.col("m").alias("y"))).distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("x").alias("node"), F.col("y").alias("component")).unionAll(e.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
