"""Change streams: incremental rebuilds, and windowed counts of late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rebuild import removed_by_file
from ..sources.extract import extracted, source_graph

NODES = "id string, label string, name string, file_path string, start_line long, end_line long, content string"
EDGES = "id string, source_id string, target_id string, type string"


def on_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``apply(batch, number)`` for what has come, then stops. A batch may be delivered again after a failure, under the same number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild_on_changes(manifests: DataFrame, read: Callable[[DataFrame], DataFrame], graph: Graph, checkpoint: str):
    """Keeps a graph at rest in step with a stream of manifests (path, hash): each batch's files are read by ``read`` (manifest -> path, content) and replace what the graph had of them.

    A manifest row with a null hash says that the file is gone. A batch that comes again changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        graph.replace(batch.select("path").distinct(), read(batch.filter("hash IS NOT NULL")), number)

    return on_changes(manifests, apply, checkpoint)


class Graph:
    """Nodes and edges of source files at ``path``, a folder a version; the version to read is the last whole one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self, before: int | None = None) -> int | None:
        try:
            known = self.spark.read.schema("version long").json(f"{self.path}/versions")
        except AnalysisException:
            return None
        return known.filter(F.lit(before is None) | (F.col("version") < F.lit(before))).agg(F.max("version")).first()[0]

    def tables(self, before: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the last version, or the last one before a number; empty before the first."""
        if (v := self.version(before)) is None:
            return self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES)
        return self.spark.read.parquet(f"{self.path}/nodes/{v}"), self.spark.read.parquet(f"{self.path}/edges/{v}")

    def replace(self, paths: DataFrame, sources: DataFrame, version: int) -> None:
        """The next version: without the files ``paths`` (path), with the graph of ``sources`` (path, content)."""
        nodes, edges = self.tables(before=version)
        nodes, edges, _ = removed_by_file(nodes, edges, paths)
        new_nodes, new_edges = source_graph(extracted(sources), sources)
        nodes.unionByName(new_nodes).write.mode("overwrite").parquet(f"{self.path}/nodes/{version}")
        edges.unionByName(new_edges).write.mode("overwrite").parquet(f"{self.path}/edges/{version}")
        self.spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("append").json(f"{self.path}/versions")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) by tumbling windows; on a stream, events later than ``late`` are dropped."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of runs of a user's events less than ``gap`` apart."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
