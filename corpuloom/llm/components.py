"""Connected components over a table of links, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuloom.session import cut


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    links: columns a, b (long). Rounds of minimum-label propagation and pointer
    jumping; each round is written to the shared folder. Nulls are dropped; an
    empty table gives an empty result. Both joins of a round have a unique side,
    so a hub with many links is an ordinary skewed join that AQE splits.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")).hint("merge"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("c").alias("c"))
        )
        own = labels.join(near.hint("merge"), "id").select("id", F.least("component", "c").alias("c"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        labels = cut(own.join(jump.hint("merge"), "c").select("id", F.least("c", "up").alias("component"), "was"), "labels")
        if labels.where("component <> was").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
    raise RuntimeError(f"no fixed point after {rounds} rounds")
