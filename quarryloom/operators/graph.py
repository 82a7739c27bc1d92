"""Graph construction, mutation and summaries over a ``nodes`` and an ``edges`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_binary_content
from ..functions.tables import ALLOWED_PAIRS


def file_facts(files: DataFrame) -> DataFrame:
    """(id, line_count, binary) of File nodes, of scanned files (path, content): how many line ends a file has, 0 if it is binary or can't be read."""
    binary = is_binary_content(F.col("content"))
    hexed = F.hex("content")
    lines = F.size(F.filter(F.regexp_extract_all(hexed, F.lit("(..)"), 1), lambda x: x == "0A")).cast("long")
    return files.select(F.concat(F.lit("File:"), "path").alias("id"), F.when(binary | F.col("content").isNull(), 0).otherwise(lines).alias("line_count"), binary.alias("binary"))


def folder_hierarchy(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (path, ...): a File per path, a Folder per proper prefix, CONTAINS from each to the next. A root file has no parent."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    chain = files.select("path").distinct().select("path", prefixes.alias("prefixes"))
    steps = chain.select("path", F.posexplode("prefixes").alias("depth", "at"), "prefixes")
    label = F.when(F.col("at") == F.col("path"), "File").otherwise("Folder")
    nodes = steps.select(F.concat(label, F.lit(":"), "at").alias("id"), label.alias("label"), F.element_at(F.split("at", "/"), -1).alias("name"), F.col("at").alias("file_path")).distinct()
    parent = F.concat(F.lit("Folder:"), F.get("prefixes", F.col("depth") - 1))
    child = F.concat(label, F.lit(":"), "at")
    edges = steps.filter("depth > 0").select(F.concat(parent, F.lit("_contains_"), child).alias("id"), parent.alias("source_id"), child.alias("target_id"), F.lit("CONTAINS").alias("type")).distinct()
    return nodes, edges


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``. Combines before the shuffle, so a common key costs no more than a rare one."""
    others = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def label_of(node_id: Column) -> Column:
    """The label that an id begins with."""
    return F.substring_index(node_id, ":", 1)


def with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist, with their labels."""
    end = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"))
    return edges.join(end("source"), "source_id").join(end("target"), "target_id")


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node. The edges are read once, and meet the ids at each end once."""
    end = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"_{side}")).distinct()
    both = edges.join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    return both.filter("_source IS NULL OR _target IS NULL").select(*edges.columns)


def allowed(labelled: DataFrame, pairs=ALLOWED_PAIRS) -> DataFrame:
    """Edges whose label pair the schema allows. The pair table is fixed, so it is broadcast."""
    table = labelled.sparkSession.createDataFrame(pairs, "source_label string, target_label string")
    return labelled.join(F.broadcast(table), ["source_label", "target_label"], "left_semi")


def pair_counts(edges: DataFrame, marks: DataFrame, mark: str) -> DataFrame:
    """(source_<mark>, target_<mark>, n): how many edges go from one mark to another, of nodes (id, <mark>); edges without both ends don't count.

    Edges are counted by their source's mark and their target before they are
    dealt to their targets, so that fewer rows are shuffled a second time.
    """
    end = lambda side: marks.select(F.col("id").alias(f"{side}_id"), F.col(mark).alias(f"{side}_{mark}"))
    half = edges.join(end("source"), "source_id").groupBy(f"source_{mark}", "target_id").agg(F.count("*").alias("n"))
    return half.join(end("target"), "target_id").groupBy(f"source_{mark}", f"target_{mark}").agg(F.sum("n").alias("n"))


def rejected_by_pair(counted: DataFrame, most: int = 5, pairs=ALLOWED_PAIRS) -> DataFrame:
    """The commonest label pairs, of (source_label, target_label, n), that the schema doesn't allow."""
    table = counted.sparkSession.createDataFrame(pairs, "source_label string, target_label string")
    return counted.join(F.broadcast(table), ["source_label", "target_label"], "left_anti").orderBy(F.desc("n"), "source_label", "target_label").limit(most)


def without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of ``gone`` (id), and without the edges at them."""
    gone = gone.select(F.col("id").alias("_gone"))
    kept = edges.join(gone, edges["source_id"] == gone["_gone"], "left_anti").join(gone, F.col("target_id") == gone["_gone"], "left_anti")
    return nodes.join(gone, nodes["id"] == gone["_gone"], "left_anti"), kept


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label, edges by type."""
    a = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    b = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    return a.unionByName(b).select("kind", "name", "n")


def degree(edges: DataFrame, side: str = "target") -> DataFrame:
    """(id, n): fan-in by target, fan-out by source."""
    return edges.groupBy(F.col(f"{side}_id").alias("id")).agg(F.count("*").alias("n"))


def printed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(line): ``source -[TYPE]-> target`` by file path, or id."""
    end = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("file_path").alias(f"{side}_path"))
    both = edges.join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    return both.select(F.format_string("%s -[%s]-> %s", F.coalesce("source_path", "source_id"), "type", F.coalesce("target_path", "target_id")).alias("line"))


def carried_forward(rows: DataFrame, by: list[str], order: list[str], is_head: str, value: str, out: str) -> DataFrame:
    """Adds the last ``value`` of a head row, as seen walking each group in order."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(F.when(F.expr(is_head), F.col(value)), ignorenulls=True).over(w))


def next_only(rows: DataFrame, by: list[str], order: list[str], is_head: str, is_taker: str, value: str, out: str) -> DataFrame:
    """Taker rows with the ``value`` of the head before them; a head serves the first taker behind it alone."""
    walk = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_part", F.sum(F.expr(is_head).cast("long")).over(walk))
    rows = rows.withColumn(out, F.last(F.when(F.expr(is_head), F.col(value)), ignorenulls=True).over(walk))
    takers = rows.filter(F.expr(is_taker) & (F.col("_part") > 0))
    first = Window.partitionBy(*by, "_part").orderBy(*order)
    return takers.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth", "_part")


def runs(rows: DataFrame, by: list[str], order: str, gap: int, text: str | None = None, prefix: str | None = None) -> DataFrame:
    """(by..., run, first, last, n): rows whose ``order`` follows the row before by at most ``gap`` form a run; with ``prefix``, of the rows whose ``text`` begins so."""
    rows = rows.filter(F.ltrim(F.col(text)).startswith(prefix)) if prefix else rows
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_new", (F.col(order) - F.lag(order).over(w) > gap).cast("long"))
    rows = rows.withColumn("run", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
