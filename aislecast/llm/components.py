"""Connected components of a graph of links, by alternating stars.

Each round hangs every node's larger neighbours below its smallest one, then
its smaller neighbours likewise. The number of links never grows, and after a
few rounds each node hangs directly below the smallest node it reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every linked node: the smallest node it reaches, itself included.

    ``links`` holds pairs of long ids in any order, repeated or not; pairs with
    a null and loops count for nothing. Every round is written to the shared
    folder. Hot nodes are met by aggregates with map-side combine and by joins
    that Spark splits when they are skewed.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    tree = written(links.where(F.col(a) != F.col(b)).select(high, low).distinct(), "links")
    state = _state(tree)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = hung.where("u > v").distinct()
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        again = down.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = written(again.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _state(tree)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = tree.select(F.col("v").alias("node")).distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )


def _state(tree: DataFrame) -> tuple[int, int]:
    """Number of links and a sum over them, which tell whether a round changed anything."""
    marks = F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))
    row = tree.agg(F.count(F.lit(1)).alias("n"), F.coalesce(marks, F.lit(0)).alias("s")).first()
    return row["n"], row["s"]
