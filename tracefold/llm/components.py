"""Connected components of a large graph by label passing and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.sources.sinks import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> node, label: the smallest node it is linked to.

    Every round a node takes the smallest label among itself and its neighbours, then the
    label of that label; labels only ever fall and stay inside the component, so the loop
    ends with its smallest node. Each round is written once, so lost executors cost at most
    one round. Nodes without an edge do not appear.
    """
    both = stored(edges.where("a <> b").select("a", "b").unionByName(edges.where(
        "a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    # the first labels: the smallest neighbour
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(
        F.col("a").alias("node"), "label"), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(
            F.min("label").alias("heard"))
        passed = stored(labels.join(heard, F.col("node") == F.col("a")).select(
            "node", F.least("label", "heard").alias("label"),
            (F.col("heard") < F.col("label")).alias("fell")), "heard")
        if passed.where("fell").isEmpty():
            return labels
        # jump: both sides are plain tables, so that a label of many nodes can be split
        up = passed.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        labels = stored(passed.join(up, "label").select(
            "node", F.least("label", "higher").alias("label")), "labels")
