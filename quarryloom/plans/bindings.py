"""The library's inputs as made from the test tables: page paths, a commerce graph, snapshots, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = r"^https?://([^?#]+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path) of all pages, query, fragment and trailing slash dropped."""
    path = F.regexp_replace(F.regexp_extract("url", PATH, 1), "/+$", "")
    return table(spark, sf_dir, "pages").select(path.alias("path")).filter("path <> ''").distinct()


def commerce(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): regions contain nations, these customers and suppliers, customers orders; orders use parts."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda d, label, key, name: d.select(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"))
    nodes = node(t("region"), "Region", "r_regionkey", "r_name").unionByName(node(t("nation"), "Nation", "n_nationkey", "n_name")).unionByName(node(t("customer"), "Customer", "c_custkey", "c_name")).unionByName(node(t("supplier"), "Supplier", "s_suppkey", "s_name")).unionByName(node(t("part"), "Part", "p_partkey", "p_name")).unionByName(node(t("orders"), "Order", "o_orderkey", "o_orderstatus"))
    end = lambda label, key: F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))
    edge = lambda d, a, ak, b, bk, kind: d.select(end(a, ak).alias("source_id"), end(b, bk).alias("target_id"), F.lit(kind).alias("type"))
    edges = edge(t("nation"), "Region", "n_regionkey", "Nation", "n_nationkey", "CONTAINS")
    edges = edges.unionByName(edge(t("customer"), "Nation", "c_nationkey", "Customer", "c_custkey", "CONTAINS"))
    edges = edges.unionByName(edge(t("supplier"), "Nation", "s_nationkey", "Supplier", "s_suppkey", "CONTAINS"))
    edges = edges.unionByName(edge(t("orders"), "Customer", "o_custkey", "Order", "o_orderkey", "CONTAINS"))
    return nodes, edges.unionByName(edge(t("lineitem"), "Order", "l_orderkey", "Part", "l_partkey", "USES").distinct())


COMMERCE_SQL = """nodes AS (
  SELECT 'Region:' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region UNION ALL
  SELECT 'Nation:' || n_nationkey, 'Nation', n_name FROM nation UNION ALL
  SELECT 'Customer:' || c_custkey, 'Customer', c_name FROM customer UNION ALL
  SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL
  SELECT 'Part:' || p_partkey, 'Part', p_name FROM part UNION ALL
  SELECT 'Order:' || o_orderkey, 'Order', o_orderstatus FROM orders),
edges AS (
  SELECT 'Region:' || n_regionkey AS source_id, 'Nation:' || n_nationkey AS target_id, 'CONTAINS' AS type FROM nation UNION ALL
  SELECT 'Nation:' || c_nationkey, 'Customer:' || c_custkey, 'CONTAINS' FROM customer UNION ALL
  SELECT 'Nation:' || s_nationkey, 'Supplier:' || s_suppkey, 'CONTAINS' FROM supplier UNION ALL
  SELECT 'Customer:' || o_custkey, 'Order:' || o_orderkey, 'CONTAINS' FROM orders UNION ALL
  SELECT DISTINCT 'Order:' || l_orderkey, 'Part:' || l_partkey, 'USES' FROM lineitem)"""

PAGES_SQL = """files AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://([^?#]+)', 1), '/+$', '') AS path FROM pages WHERE regexp_replace(regexp_extract(url, '^https?://([^?#]+)', 1), '/+$', '') <> ''),
chain AS (SELECT path, string_split(path, '/') AS parts FROM files),
steps AS (SELECT path, i, array_to_string(parts[1:i], '/') AS here, array_to_string(parts[1:i-1], '/') AS above FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM chain)),
nodes AS (SELECT DISTINCT CASE WHEN here = path THEN 'File:' ELSE 'Folder:' END || here AS id, CASE WHEN here = path THEN 'File' ELSE 'Folder' END AS label, string_split(here, '/')[-1] AS name, here AS file_path FROM steps),
edges AS (SELECT DISTINCT 'Folder:' || above || '_contains_' || CASE WHEN here = path THEN 'File:' ELSE 'Folder:' END || here AS id, 'Folder:' || above AS source_id, CASE WHEN here = path THEN 'File:' ELSE 'Folder:' END || here AS target_id, 'CONTAINS' AS type FROM steps WHERE i > 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, cached) of (path, hash): all but every 11th document now, all but every 13th before, every 7th hash spoiled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"))
    spoiled = F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("hash"))
    return d.filter("doc_id % 11 <> 0").select("path", "hash"), d.filter("doc_id % 13 <> 0").select("path", spoiled.alias("hash"))


SNAPSHOTS_SQL = """d AS (SELECT doc_id, 'doc/' || doc_id AS path, sha256(text) AS hash FROM documents),
cur AS (SELECT path, hash FROM d WHERE doc_id % 11 <> 0),
old AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE hash END AS hash FROM d WHERE doc_id % 13 <> 0),
delta AS (SELECT coalesce(cur.path, old.path) AS path, CASE WHEN cur.path IS NULL THEN 'deleted' WHEN old.path IS NULL THEN 'new' WHEN cur.hash = old.hash THEN 'unchanged' ELSE 'modified' END AS status FROM cur FULL JOIN old ON cur.path = old.path)"""


def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: file = brand, name = part name, type and owner by key."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Function", "Method", "Class", "Property", "Constructor")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    owner = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("Class:"), F.col("p_type")))
    return p.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"), F.concat(F.lit("Symbol:"), F.col("p_partkey").cast("string")).alias("node_id"), kind.alias("type"), owner.alias("owner_id"))


SYMBOLS_SQL = "symbols AS (SELECT p_partkey AS seq, p_brand AS file_path, p_name AS name, 'Symbol:' || p_partkey AS node_id, ['Function', 'Method', 'Class', 'Property', 'Constructor'][p_partkey % 5 + 1] AS type, CASE WHEN p_partkey % 3 <> 0 THEN 'Class:' || p_type END AS owner_id FROM part)"
