"""Connected components of a table of links, by repeated contraction.

In each round every vertex joins the neighbour (or itself) with the smallest random rank,
and links are redrawn between those.  A round merges a fixed share of the vertices of any
graph, so the number of rounds grows with the logarithm of the longest component, and each
round's tables are written to the shared folder: no lineage grows, and nothing reaches the
driver.  A vertex with very many links is combined per task before it meets its rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex with a link; equal roots mean one component.

    ``a`` and ``b`` are longs; loops and repeated links are allowed, null ends are ignored.
    """
    e = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    e = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        seed = len(steps) + 1
        rank = lambda v: F.struct(F.xxhash64(F.lit(seed), v).alias("rank"), v.alias("to"))
        ends = e.select(F.col("a").alias("v"), rank(F.col("b")).alias("n")).unionAll(e.select(F.col("b"), rank(F.col("a"))))
        step = ends.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least(F.col("n"), rank(F.col("v")))["to"].alias("to"))
        step = written(step, "steps")
        steps.append(step)
        e = e.join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(
            step.select(F.col("v").alias("b"), F.col("to").alias("y")), "b"
        ).filter("x != y")
        e = written(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not steps:
        return e.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    found = steps[0].select(F.col("v").alias("vertex"), F.col("to").alias("root"))
    for step in steps[1:]:
        found = found.join(step, found["root"] == step["v"], "left").select("vertex", F.coalesce("to", "root").alias("root"))
    return written(found, "roots")
