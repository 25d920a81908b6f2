"""Connected components over DataFrames: smallest-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checkpointed, dropped, joined_small, tasks, written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between long node ids -> (node, root): root is the smallest node that links reach.

    Only nodes that have a link come back. Each round takes the smallest label among the neighbours and then replaces a
    label by its label's label, so the rounds grow with the logarithm of a chain's length. Hubs: the minimum is
    pre-aggregated, and links that point to a node of very many links (fewer than 4 x tasks such nodes) take its label from a
    broadcast. Pointer jumping joins with the labels that can move only. Labels are written each round; nothing reaches the
    driver but whether one changed. Null ends and links of a node with itself are ignored; no links: no rows.
    """
    spark = links.sparkSession
    links = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    both, both_at = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    label, label_at = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "label")
    most = max(both.count() / (4 * tasks(spark)), 1000)
    hubs = checkpointed(both.groupBy("b").count().where(F.col("count") > most).select("b"))
    some = hubs.limit(1).count() > 0
    far, rest = (both.join(F.broadcast(hubs), "b", kind) for kind in ("left_semi", "left_anti")) if some else (None, both)
    while True:
        named = label.select(F.col("node").alias("b"), "root")
        seen = rest.join(named, "b").select("a", "root")
        if some:
            seen = seen.union(far.join(F.broadcast(named.join(F.broadcast(hubs), "b", "left_semi")), "b").select("a", "root"))
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least, least_at = written(label.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "least")
        if not least.where("root <> was").limit(1).count():
            dropped(spark, both_at, least_at)
            return label
        moved = label.where("root <> node").select(F.col("node").alias("root"), F.col("root").alias("up"))
        after, after_at = written(joined_small(least, moved, ["root"]).select("node", F.coalesce("up", "root").alias("root")), "label")
        dropped(spark, label_at, least_at)
        label, label_at = after, after_at
