"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stage


def spanning_forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The links (a[i], b[i]) that join two parts when taken in turn: at most one for each
    node, with the same components as all links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    left, right = [], []
    for x, y in zip(a, b, strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def components(links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of the links (a, b).

    Large star: each node hands its larger neighbours to its smallest one; small star: each
    node hands its smaller neighbours to the smallest of them. Stars only remain after a
    number of rounds that grows with the logarithm of the longest path. Minima are combined
    before each shuffle, written out, and handed back by an equi-join with what is read back:
    both sides of the join are then plain scans, so that Spark splits a hot node (the centre
    of a great star) over tasks. Every round is written to the shared folder. Links of a node
    with itself don't count; an empty table gives an empty table."""
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        name,
    )
    digest = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name + "-least")
        large = handed(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, name + "-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), name + "-least")
        small = (
            handed(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
                least.select("u", F.col("m").alias("v"))
            )
        ).distinct()
        edges = stage(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == now:
            break
        digest = now
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    centres = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        centres.select("node", F.col("node").alias("component"))
    )


def handed(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with m, the least of u; both tables are read from files."""
    return edges.join(least, "u")
