"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours, or to the others."""
    if large:
        near = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of the links (a, b); the component is its smallest node.

    Edges never grow in number; every round is written to the shared folder, so that a lost executor
    costs one round. Nodes without a link to another node are not returned.
    """
    seen = None
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = now
        edges = stored(_stars(_stars(edges, True), False), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
