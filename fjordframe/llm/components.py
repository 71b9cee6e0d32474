"""Connected components of a link table by label propagation with pointer jumping, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordframe.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id reachable. Ids are of any type that has an order.

    Each round takes the least label among a node and its neighbours and then the label of that label, so chains
    shorten geometrically. A round is written to the shared folder; rounds end when no label changes. Labels are
    pre-aggregated before every shuffle, so a node with very many links does not meet in one task.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        hooked = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        jumped = written(hooked.join(up, "component", "left").select("id", "old", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        discard(labels)
        labels = jumped
        if jumped.where("old <> component").isEmpty():
            discard(both)
            return jumped.select("id", "component")
