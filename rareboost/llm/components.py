"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to smaller neighbours, so a component of n
nodes turns into one star around its smallest node in O(log(n) ** 2) rounds,
whatever its diameter. A round is a grouped minimum and a join; neither links
nor components ever reach the driver, and each round is staged in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rareboost.session import stage, unstage


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them; here a > b holds."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Of links (a, b): ``node`` and ``component``, its smallest reachable node, for each node but that one."""
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        small = stage(_small_star(_large_star(now)))
        unstage(now)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
