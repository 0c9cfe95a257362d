"""Connected components of an undirected graph, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitalstream.llm.common import materialise

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to one row (``vertex``, ``root``) per vertex; ``root`` is the least vertex of its component.

    Large-star and small-star rounds: each points vertices at the least
    neighbour, which keeps the components and the number of links, until every
    link leads to a root. A round is written to the shared folder, so lost
    executors cost one round. The hot vertex of a star only ever meets a
    minimum, combined before the shuffle, and a join that AQE can split.
    No vertex of the graph reaches the driver; without links the result is empty.
    """
    links = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    links = materialise(links, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        links = materialise(_small_star(_large_star(links)), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = links.select(F.col("lo").alias("vertex"), F.col("lo").alias("root")).distinct()
    return links.select(F.col("hi").alias("vertex"), F.col("lo").alias("root")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex is tied to the least of the vertex and its neighbours."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the least of these."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    return (
        links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
    )
