"""Incremental rebuild of a source graph: what changed is removed with its edges, read again and put back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.extract import extracted, source_graph
from .graph import without
from .lookups import delta


def removed_by_file(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, removed): without the nodes of the files ``paths`` (path) and the edges at them; ``removed`` has the ids taken out."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    return *without(nodes, edges, gone), gone


def rebuild(nodes: DataFrame, edges: DataFrame, sources: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, changes) for the current ``sources`` (path, content), given the graph and hashes (path, hash) of the last time.

    Only new and modified files are parsed. ``nodes`` and ``edges`` have the columns of :func:`source_graph`.
    """
    hashes = sources.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    changes = delta(hashes, cached)
    kept_nodes, kept_edges, _ = removed_by_file(nodes, edges, changes.filter("status IN ('modified', 'deleted')"))
    read = sources.join(changes.filter("status IN ('new', 'modified')").select("path"), "path", "left_semi")
    new_nodes, new_edges = source_graph(extracted(read), read)
    return kept_nodes.unionByName(new_nodes), kept_edges.unionByName(new_edges), changes
