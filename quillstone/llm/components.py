"""Connected components of a link table, by alternating large-star and small-star rounds.

No task holds a component: every round is an aggregation (minimum neighbour) and a join, and their
tables are written to shared storage, so lost executors cost one round at most. The join meets the table of
minima as it was written: both sides are then plain exchanges, of which adaptive execution splits the one where a root has
many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, fresh, saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    c = F.col
    both = links.unionByName(links.select(c("v").alias("u"), c("u").alias("v")))
    near = both if large else both.where(c("v") < c("u"))
    least = saved(near.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "components-least")
    hung = near.join(least, "u")
    out = hung.where(c("v") > c("u")).select(c("v").alias("u"), c("m").alias("v")) if large else hung.select(c("v").alias("u"), c("m").alias("v")).union(fresh(least).select("u", c("m").alias("v")))
    done = saved(out.where(c("u") != c("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    discard(least)
    return done


def _print(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(r)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the component's smallest node.

    links: long columns u and v in any order and number; null ends and loops are ignored, an empty
    table gives an empty result.
    """
    c = F.col
    now = saved(links.where(c("u") != c("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = _print(now)
    while seen[0]:
        half = _star(now, True)
        discard(now)
        now = _star(half, False)
        discard(half)
        after = _print(now)
        if after == seen:
            break
        seen = after
    return now.select(c("u").alias("node"), c("v").alias("root")).unionByName(now.select(c("v").alias("node"), c("v").alias("root"))).distinct()
