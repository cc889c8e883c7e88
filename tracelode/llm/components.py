"""Connected components by alternating large-star and small-star rounds, and blocks that split hot groups of candidates.

Each round is two joins or aggregations over the links that are left and is written before the next one begins. No node,
link or component comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """From links (a, b), both directions alike, to (node, component): the least node that is reachable.

    Only nodes with a link to another node are returned.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        # large star: neighbours above a node link to the least one around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, as are those below, so that the join deals both of its sides anew and may split a hot node
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node itself, link to the least of them
        large = staged(large, f"{name}-large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = staged(small, name)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        for old in (edges, least, large, low):
            discard(old.sparkSession, old)
        edges = after
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def blocked(entries: DataFrame, keys: Sequence[str], salt: str, block: int, need: Column | None = None, least: int = 2, weight: Column | None = None) -> DataFrame:
    """Deal candidates that share ``keys`` into pairs of blocks, and drop groups of one by default.

    A group of more than ``block`` rows is cut into parts by a hash of ``salt``; every pair of parts becomes a group of its
    own (``bi`` <= ``bj``), a row going to each pair that its part is in, with ``side`` 0 if it is of part ``bi``. A row of a group
    of n meets n / block groups and no group holds more than about two blocks, so nothing is left out and no task holds a
    hot group. Groups of at most ``block`` rows stay whole (bi = bj = 0). Groups for which the aggregate ``need`` is false have
    nothing to compare and are dropped too, as are groups of fewer than ``least`` rows. With a ``weight``, a block is of so much
    weight instead, one row at least.
    """
    parts = F.count("*") if weight is None else F.least(F.sum(weight), F.count("*") * block)
    sizes = entries.groupBy(*keys).agg(F.count("*").alias("__n"), parts.alias("__w"), (F.lit(True) if need is None else need).alias("__need")).where((F.col("__n") >= least) & F.col("__need")).drop("__n", "__need")
    sizes = staged(sizes, "group-sizes")  # so that the join deals both of its sides anew and may split a hot group
    dealt = entries.join(sizes, list(keys)).withColumn("__s", F.ceil(F.col("__w") / block).cast("int"))
    dealt = dealt.withColumn("__i", F.when(F.col("__s") > 1, F.pmod(F.xxhash64(salt, F.lit(7)), F.col("__s"))).otherwise(0).cast("int"))
    dealt = dealt.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)))
    return dealt.select(
        *entries.columns, F.least("__i", "__j").alias("bi"), F.greatest("__i", "__j").alias("bj"), (F.col("__i") > F.col("__j")).cast("int").alias("side"),
    )


def forest(n: int, neighbours) -> list[tuple[int, int]]:
    """Links that connect what is connected among n rows, n - 1 at most. ``neighbours(i, rest)`` says which of ``rest`` link to i."""
    rest = np.arange(n)
    out: list[tuple[int, int]] = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = neighbours(i, rest)
            if near.any():
                hit = rest[near]
                out += [(i, j) for j in hit.tolist()]
                queue += hit.tolist()
                rest = rest[~near]
    return out
