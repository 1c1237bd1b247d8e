"""Connected components of a graph of links, distributed: large stars and small stars in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmol.llm.common import discard, stash

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's neighbours to the least of them and itself; large: only those above the node, small: only
    those below it, and the node too. The minimum is an aggregation with partial sums, so a hub's links are never gathered."""
    both = edges.select("u", "v")
    if large:
        both = both.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the least node that it reaches. The rounds are about
    the logarithm of the longest path, each written to the shared folder; only counts and checksums come to the driver."""
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    if before[0]:
        for _ in range(MAX_ROUNDS):
            new = stash(_star(_star(edges, True), False))
            discard(edges)
            edges, now = new, mark(new)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._stashed_at = edges._stashed_at
    return out
