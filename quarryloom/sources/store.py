"""Graph tables at rest: per-label CSV and Parquet sinks, load with rejects, embeddings, a parse cache and a registry.

Tables that change are logs: rows are appended, a later row of a key replaces the
earlier ones, a row marked ``gone`` takes its key out. Readers of a log never see half a change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import csv_field, storage_key
from ..functions.tables import EXPORTED_NAMES, NODE_COLUMNS, NODE_LABELS, RELATION_COLUMNS, SYMBOL_COLUMNS
from ..operators.graph import allowed, first_wins, missing_ends, with_labels


def columns_of(label: str) -> list[str]:
    """The exported columns of a label, in order."""
    return NODE_COLUMNS.get(label, SYMBOL_COLUMNS)


def flattened(nodes: DataFrame) -> DataFrame:
    """Nodes under their exported names, with every entry of ``extra`` (a map) that a layout names as a column of its own; a column's own value goes first."""
    names = {c: EXPORTED_NAMES.get(c, c) for c in nodes.columns}
    out = nodes.withColumnsRenamed(names)
    if "extra" in out.columns:
        known = dict.fromkeys([*SYMBOL_COLUMNS, *[c for columns in NODE_COLUMNS.values() for c in columns]])
        own = lambda c: F.coalesce(F.col(c).cast("string"), F.col("extra")[c]) if c in out.columns else F.col("extra")[c]
        out = out.withColumns({c: own(c) for c in known if c not in ("id", "name")}).drop("extra")
    return out


def cut_content(label: Column, content: Column) -> Column:
    """At most 10 000 characters of a file, 50 000 of anything else."""
    return F.when(label == "File", F.substring(content, 1, 10_000)).otherwise(F.substring(content, 1, 50_000))


def csv_lines(rows: DataFrame, columns: list[str]) -> Column:
    """A row as a CSV line of the given columns, in order; one that ``rows`` lacks is empty."""
    return F.concat_ws(",", *[csv_field(F.col(c).cast("string")) if c in rows.columns else F.lit("") for c in columns])


def write_csv(nodes: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One folder per label, columns as :func:`columns_of` has them (or as given), contents cut."""
    if "content" in nodes.columns:
        nodes = nodes.withColumn("content", cut_content(F.col("label"), F.col("content")))
    if columns:
        line = csv_lines(nodes, columns)
    else:
        line = csv_lines(nodes, SYMBOL_COLUMNS)
        for label, own in NODE_COLUMNS.items():
            line = F.when(F.col("label") == label, csv_lines(nodes, own)).otherwise(line)
    nodes.select("label", line.alias("value")).write.partitionBy("label").text(path)


def write_relations(edges: DataFrame, path: str) -> None:
    """All relations as one CSV table, columns in their order."""
    named = edges.withColumnsRenamed({"source_id": "from", "target_id": "to", **EXPORTED_NAMES})
    named.select(csv_lines(named, RELATION_COLUMNS).alias("value")).write.text(path)


def create_tables(spark: SparkSession, prefix: str) -> list[str]:
    """A table for every label, with its columns, and one for relations; those that exist stay. Returns their names."""
    names = []
    for label in NODE_LABELS:
        names.append(f"{prefix}{label}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {names[-1]} ({', '.join(f'`{c}` STRING' for c in columns_of(label))}) USING parquet")
    names.append(f"{prefix}CodeRelation")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {names[-1]} ({', '.join(f'`{c}` STRING' for c in RELATION_COLUMNS)}) USING parquet")
    return names


def load_graph(nodes: DataFrame, edges: DataFrame, path: str) -> dict:
    """Appends nodes by label and allowed edges by type to Parquet tables; edges without ends or with a pair that the schema lacks go to ``rejects``.

    Nodes of an unknown label, or without an id, are not loaded: ``failed`` has their number by label, ``lost`` its sum.
    """
    fit = F.col("id").isNotNull() & F.col("label").isin(NODE_LABELS)
    failed = {r["label"]: r["n"] for r in nodes.filter(~F.coalesce(fit, F.lit(False))).groupBy("label").agg(F.count("*").alias("n")).collect()}
    nodes = nodes.filter(fit)
    labelled = with_labels(edges, nodes)
    good = allowed(labelled).drop("source_label", "target_label")
    nodes.write.mode("append").partitionBy("label").parquet(f"{path}/nodes")
    good.write.mode("append").partitionBy("type").parquet(f"{path}/edges")
    bad = labelled.join(good.select("id"), "id", "left_anti").select(*edges.columns).unionByName(missing_ends(edges, nodes).select(*edges.columns))
    bad.write.mode("append").parquet(f"{path}/rejects")
    return {"nodes": nodes.count(), "edges": good.count(), "rejected": bad.count(), "failed": failed, "lost": sum(failed.values())}


def clear_graph(spark: SparkSession, path: str) -> None:
    """Leaves the graph's tables at ``path`` empty, with their columns."""
    for name in ("nodes", "edges", "rejects"):
        try:
            schema = spark.read.parquet(f"{path}/{name}").schema
        except AnalysisException:  # never loaded
            continue
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")


def open_graph(spark: SparkSession, path: str) -> None:
    """Views ``nodes`` and ``edges`` for SQL."""
    for name in ("nodes", "edges"):
        spark.read.parquet(f"{path}/{name}").createOrReplaceTempView(name)


def store_embeddings(rows: DataFrame, path: str) -> int:
    """Appends (id, embedding); how many the table then has."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def stored_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) stored before; none where nothing was."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "id string, embedding array<double>")


def to_embed(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Nodes whose embedding isn't stored."""
    return nodes.join(stored.select("id"), "id", "left_anti")


def cached(current: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache rows (path, hash, ...) that are still right for the current (path, hash)."""
    return cache.join(current.select("path", "hash"), ["path", "hash"], "left_semi")


class Log:
    """A keyed table at rest as a log of (columns..., at, gone)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def rows(self) -> DataFrame:
        """The latest row of each key that isn't gone."""
        try:
            log = self.spark.read.schema(f"{self.schema}, at long, gone boolean").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        return first_wins(log.withColumn("_last", -F.col("at")), self.key, ["_last"]).filter("NOT gone").drop("_last", "at", "gone")

    def _append(self, rows: DataFrame, at: int, gone: bool) -> None:
        rows.withColumns({"at": F.lit(at).cast("long"), "gone": F.lit(gone)}).write.mode("append").parquet(self.path)

    def put(self, rows: DataFrame, at: int) -> None:
        """Adds or replaces; ``at`` must grow from change to change."""
        self._append(rows, at, False)

    def drop(self, keys: DataFrame, at: int) -> None:
        """Takes the keys out."""
        columns = [F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema]
        self._append(keys.select(*columns), at, True)


class ParseCache(Log):
    """Extracted rows of files as JSON, by path and hash of the content they came from."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "path string, hash string, rows string", "path")

    def get(self, current: DataFrame) -> DataFrame:
        """(path, hash, rows) that are right for the current (path, hash)."""
        return cached(current, self.rows())


class Registry(Log):
    """Repositories by path: (path, name, key, indexed_at)."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "path string, name string, key string, indexed_at string", "path")

    def register(self, repos: DataFrame, at: int) -> None:
        """Upserts (path, name, indexed_at)."""
        self.put(repos.select("path", "name", storage_key(F.col("path")).alias("key"), "indexed_at"), at)

    def named(self, name: str) -> DataFrame:
        """The newest of that name, letter case aside."""
        return self.rows().filter(F.lower("name") == name.lower()).orderBy(F.desc("indexed_at"), "path").limit(1)


def publish(events: DataFrame, path: str) -> None:
    """Appends events to a log that streams can follow."""
    events.write.mode("append").parquet(path)


def subscribe(spark: SparkSession, path: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``apply`` for events published since it last ran with this checkpoint: each at least once, a batch under one number."""
    from ..streaming.changes import on_changes

    return on_changes(spark.readStream.schema(schema).parquet(path), apply, checkpoint)
