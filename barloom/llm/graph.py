"""Connected components of links between ids, in rounds of joins; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in ``links`` (a, b).

    Every round takes the smallest label among an id and its neighbours and then the label's own label, so long
    chains halve from round to round.
    """
    edges = links.where("a <> b").select("a", "b")
    edges = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels.select("id", "component").withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        near = near.withColumnRenamed("a", "id")
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        step = written(step, "labels", labels)
        own = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = written(step.join(own, "component").select("id", "was", F.col("further").alias("component")), "labels", step)
        if not labels.where("was <> component").limit(1).count():
            return written(labels.drop("was"), "components", labels, edges)
