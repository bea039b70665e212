"""Connected components as DataFrame steps: alternating large-star and small-star, after Kiveris et al. (2014).

Every step is a sum-up by node (map-side first) and a join, so a node with very many links is split by adaptive execution;
each round is written to the shared folder. Nothing is gathered on the driver but whether a round was the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(links.select(F.col("y").alias("u"), F.col("x").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("x"), F.col("m").alias("y"))
    return moved.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(x, y) of links between numbers, in any direction -> (x, y): y is the smallest number that x reaches, for x <> y.

    No links give no rows. Repeated links and links from a number to itself change nothing; null ends are left out.
    """
    now = common.stash(links.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    while True:
        roles = now.select(F.col("x").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(now.select(F.col("y").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if roles.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 AND down > 0").isEmpty():
            return now
        after = common.stash(_small_star(_large_star(now)), "links")
        common.drop_stash(now)
        now = after
