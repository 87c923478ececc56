"""Connected components of an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long), any order, repeats allowed. Returns (node, component): the smallest
    node reachable. Nodes without edges do not appear. Labels only fall, so their sum tells when a
    round changed nothing; each round is staged. Hot nodes are joined, never gathered."""
    links = common.stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = common.stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")

    def total(df: DataFrame):
        return df.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]

    now = total(labels)
    while now is not None:
        at = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
        to = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        seen = links.join(at, "a").join(to, "b").where("la <> lb").select(F.greatest("la", "lb").alias("high"), F.least("la", "lb").alias("component"), "a", "b")
        offers = seen.select(F.explode(F.array("high", "a", "b")).alias("node"), "component")
        low = offers.unionAll(labels).groupBy("node").agg(F.min("component").alias("component"))
        hooked = common.stage(low, "hooked")
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = common.stage(hooked.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        common.unstage(hooked)
        common.unstage(labels)
        labels, before, now = jumped, now, total(jumped)
        if now == before:
            break
    return labels
