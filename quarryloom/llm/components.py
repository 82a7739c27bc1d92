"""Connected components of links between ids: smallest label with pointer jumping, a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a, b).

    Every round takes the smallest label among the neighbours, then the label's
    own label, so that rounds grow with the logarithm of a component's diameter.
    Only counts reach the driver.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "cc-labels")
    last = labels
    while True:
        of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("near"))
        nearest = both.join(of_b, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        new = labels.join(nearest, "id").select("id", F.least("component", "near").alias("new"), "component")
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("further"))
        new = new.join(jump, "new").select("id", F.least("new", "further").alias("new"), "component")
        new = written(new.select("id", F.col("new").alias("component"), (F.col("new") < F.col("component")).alias("moved")), "cc-labels")
        discard(last)
        labels, last = new.select("id", "component"), new
        if new.filter("moved").isEmpty():
            discard(both)
            return labels
