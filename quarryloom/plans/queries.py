"""Registered queries over the test tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as T
from ..operators import graph as G
from ..operators import imports as I
from ..operators import lookups as L
from ..operators import rebuild as R
from ..operators import search as Q
from ..operators.lineage import cut
from ..sources import extract, files, store
from ..streaming import changes
from . import sources as P
from .bindings import COMMERCE_SQL, PAGES_SQL, SNAPSHOTS_SQL, SYMBOLS_SQL, commerce, page_files, snapshots, symbol_table, table

#: The part of PAGES_SQL that gives the paths alone.
FILES_SQL = PAGES_SQL.split(",\nchain")[0]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    """Rows as SQL VALUES."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


# Structure


@query(f"WITH {PAGES_SQL} SELECT * FROM nodes")
def structure_nodes(spark, sf_dir):
    return G.folder_hierarchy(page_files(spark, sf_dir))[0]


@query(f"WITH {PAGES_SQL} SELECT * FROM edges")
def structure_edges(spark, sf_dir):
    return G.folder_hierarchy(page_files(spark, sf_dir))[1]


@query(f"WITH {PAGES_SQL} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def structure_summary(spark, sf_dir):
    return G.counts(*G.folder_hierarchy(page_files(spark, sf_dir)))


@query(f"WITH {PAGES_SQL} SELECT a.file_path || ' -[' || type || ']-> ' || b.file_path AS line FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id")
def format_edges(spark, sf_dir):
    nodes, edges = G.folder_hierarchy(page_files(spark, sf_dir))
    return G.printed(edges, nodes)


@query(f"WITH {PAGES_SQL} SELECT source_id AS id, count(*) AS n FROM edges GROUP BY 1")
def folder_fan_out(spark, sf_dir):
    return G.degree(G.folder_hierarchy(page_files(spark, sf_dir))[1], "source")


@query(f"WITH {PAGES_SQL}, gone AS (SELECT id FROM nodes WHERE file_path IN (SELECT path FROM files WHERE length(path) % 5 = 0)) SELECT id, source_id, target_id FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def remove_by_file(spark, sf_dir):
    pages = page_files(spark, sf_dir)
    return R.removed_by_file(*G.folder_hierarchy(pages), pages.filter("length(path) % 5 = 0"))[1].select("id", "source_id", "target_id")


@query(f"WITH {PAGES_SQL} SELECT count(*) AS n FROM nodes WHERE file_path IN (SELECT path FROM files WHERE length(path) % 5 = 0)")
def removed_by_file_count(spark, sf_dir):
    pages = page_files(spark, sf_dir)
    return R.removed_by_file(*G.folder_hierarchy(pages), pages.filter("length(path) % 5 = 0"))[2].agg(F.count("*").alias("n"))


@query(f"WITH {PAGES_SQL} SELECT file_path FROM nodes WHERE label = 'File' ORDER BY file_path LIMIT 10")
def sample_paths(spark, sf_dir):
    return L.sample(*G.folder_hierarchy(page_files(spark, sf_dir)), 10)[0]


@query(f"WITH {PAGES_SQL} SELECT id, source_id, target_id FROM edges ORDER BY id LIMIT 10")
def sample_edges(spark, sf_dir):
    return L.sample(*G.folder_hierarchy(page_files(spark, sf_dir)), 10)[1].select("id", "source_id", "target_id")


# Commerce graph


@query(f"WITH {COMMERCE_SQL} SELECT * FROM nodes")
def commerce_nodes(spark, sf_dir):
    return commerce(spark, sf_dir)[0]


@query(f"WITH {COMMERCE_SQL} SELECT * FROM edges")
def commerce_edges(spark, sf_dir):
    return commerce(spark, sf_dir)[1]


@query(f"WITH {COMMERCE_SQL} SELECT type, count(*) AS n FROM edges GROUP BY 1")
def edge_type_counts(spark, sf_dir):
    return commerce(spark, sf_dir)[1].groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {COMMERCE_SQL} SELECT target_id AS id, count(*) AS n FROM edges WHERE type = 'USES' GROUP BY 1 ORDER BY n DESC, id LIMIT 20")
def part_fan_in_topk(spark, sf_dir):
    return G.degree(commerce(spark, sf_dir)[1].filter("type = 'USES'")).orderBy(F.desc("n"), "id").limit(20)


@query(f"WITH {COMMERCE_SQL} SELECT a.label AS source_label, b.label AS target_label, count(*) AS n FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id GROUP BY 1, 2")
def edges_with_labels(spark, sf_dir):
    nodes, edges = commerce(spark, sf_dir)
    return G.pair_counts(edges, nodes, "label")


@query(f"WITH {COMMERCE_SQL}, kept AS (SELECT id FROM nodes WHERE id NOT LIKE 'Customer:%5') SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM kept) OR target_id NOT IN (SELECT id FROM kept)")
def edges_missing_endpoint(spark, sf_dir):
    nodes, edges = commerce(spark, sf_dir)
    return G.missing_ends(edges, nodes.filter("id NOT LIKE 'Customer:%5'"))


PAIRS = [("Region", "Nation"), ("Nation", "Customer"), ("Order", "Part")]


@query(f"WITH {COMMERCE_SQL} SELECT a.label AS source_label, b.label AS target_label, source_id, target_id, type FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE (a.label, b.label) IN ({values(PAIRS)})")
def edges_allowed_pairs(spark, sf_dir):
    nodes, edges = commerce(spark, sf_dir)
    return G.allowed(G.with_labels(edges, nodes), PAIRS)


@query(f"WITH {COMMERCE_SQL} SELECT a.label AS source_label, b.label AS target_label, count(*) AS n FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE (a.label, b.label) NOT IN ({values(PAIRS)}) GROUP BY 1, 2")
def rejects_by_pair(spark, sf_dir):
    nodes, edges = commerce(spark, sf_dir)
    return G.rejected_by_pair(G.pair_counts(edges, nodes, "label"), 5, PAIRS)


@query(f"WITH {COMMERCE_SQL} SELECT * FROM edges WHERE source_id NOT LIKE 'Nation:1%' AND target_id NOT LIKE 'Nation:1%'")
def remove_node_cascade(spark, sf_dir):
    nodes, edges = commerce(spark, sf_dir)
    return G.without(nodes, edges, nodes.filter("id LIKE 'Nation:1%'"))[1]


@query(f"WITH RECURSIVE {COMMERCE_SQL}, walk AS (SELECT 'Region:0' AS id, 0 AS hop UNION SELECT target_id, hop + 1 FROM walk JOIN edges ON source_id = id WHERE hop < 3) SELECT id, min(hop)::INT AS hop FROM walk GROUP BY id")
def bfs_hops(spark, sf_dir):
    edges = commerce(spark, sf_dir)[1]
    return Q.hops(edges, inline(spark, [("Region:0",)], "id string"), 3)


@query(f"WITH {PAGES_SQL}, votes AS (SELECT string_split(file_path, '/')[1] AS community, regexp_replace(file_path, '/?[^/]*$', '') AS folder, count(*) AS n FROM nodes GROUP BY 1, 2) SELECT community, folder AS name FROM votes QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, folder) = 1")
def community_names(spark, sf_dir):
    nodes = G.folder_hierarchy(page_files(spark, sf_dir))[0]
    return Q.community_names(nodes.select("id", F.split("file_path", "/")[0].alias("community")), nodes)


@query(f"WITH {COMMERCE_SQL}, a AS (SELECT source_id AS id, count(*) AS calls FROM edges GROUP BY 1), b AS (SELECT target_id AS id, count(*) AS called FROM edges GROUP BY 1) SELECT id, round(calls / (coalesce(called, 0) + 1), 9) AS score FROM a LEFT JOIN b USING (id)")
def entry_scores(spark, sf_dir):
    return Q.entry_scores(commerce(spark, sf_dir)[1]).withColumn("score", F.round("score", 9))


NATIONS = f"WITH {COMMERCE_SQL}, rows AS (SELECT * FROM edges WHERE type = 'USES' AND target_id IN (SELECT 'Part:' || p_partkey FROM part)), m AS (SELECT 'Order:' || o_orderkey AS id, c_nationkey::BIGINT AS community FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'Part:' || p_partkey, p_size::BIGINT % 25 FROM part), both_ends AS (SELECT a.community AS x, b.community AS y FROM rows JOIN m a ON a.id = source_id JOIN m b ON b.id = target_id)"


def _communities(spark, sf_dir):
    nodes, edges = commerce(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    members = orders.select(F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("c_nationkey").cast("long").alias("community"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") % 25).cast("long").alias("community"))
    return edges.filter("type = 'USES'"), members.unionByName(parts)


@query(NATIONS + " SELECT c AS community, sum((x = y)::INT)::BIGINT AS internal, count(*) AS total, round(sum((x = y)::INT) / count(*), 6) AS cohesion FROM (SELECT x AS c, x, y FROM both_ends UNION ALL SELECT y, x, y FROM both_ends WHERE x <> y) GROUP BY c")
def community_cohesion(spark, sf_dir):
    return Q.cohesion(*_communities(spark, sf_dir)).withColumn("cohesion", F.round("cohesion", 6))


@query(NATIONS + " SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM both_ends WHERE x <> y GROUP BY 1, 2 HAVING count(*) >= 3")
def community_interacts(spark, sf_dir):
    return Q.interactions(*_communities(spark, sf_dir))


def _rounds(n: int) -> str:
    """Label propagation in SQL: a round is a vote of the neighbours' labels, the smallest of the commonest wins."""
    out = "l0 AS (SELECT DISTINCT a AS id, a AS community FROM sides)"
    for k in range(n):
        out += f", v{k} AS (SELECT a AS id, community, count(*) AS n FROM sides JOIN l{k} ON b = id GROUP BY 1, 2), l{k + 1} AS (SELECT id, community FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, community) = 1)"
    return out


@query(f"WITH {PAGES_SQL}, sides AS (SELECT source_id AS a, target_id AS b FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id), {_rounds(3)} SELECT id, community FROM l3")
def label_propagation(spark, sf_dir):
    return Q.propagated_labels(G.folder_hierarchy(page_files(spark, sf_dir))[1], 3)


@query(f"WITH RECURSIVE {COMMERCE_SQL}, walk AS (SELECT 'Region:0' AS id, 0 AS hop UNION SELECT target_id, hop + 1 FROM walk JOIN edges ON source_id = id WHERE hop < 3), near AS (SELECT id, min(hop)::INT AS hop FROM walk GROUP BY id) SELECT id, hop, round(exp(-0.5 * hop), 9) AS weight FROM near ORDER BY hop, id LIMIT 200")
def hop_decay(spark, sf_dir):
    reached = Q.hops(commerce(spark, sf_dir)[1], inline(spark, [("Region:0",)], "id string"), 3)
    return Q.decayed(reached, 0.5, 200).withColumn("weight", F.round("weight", 9))


DAG = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("p", "q"), ("c", "a")]


@query("SELECT * FROM (VALUES ('a>b>c>d'), ('x>c>a>b'), ('x>c>d')) t(trace)")
def process_traces(spark, sf_dir):
    edges = inline(spark, DAG, "source_id string, target_id string")
    got = Q.traces(edges, inline(spark, [("a",), ("x",), ("p",), ("b",)], "id string"))
    return got.select(F.array_join("trace", ">").alias("trace"))


# Tables at rest


def _field(x: str) -> str:
    """A CSV field in SQL."""
    return f"CASE WHEN regexp_matches({x}, '[,\"\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


@query(f"WITH {PAGES_SQL} SELECT label, {_field('id')} || ',' || {_field('name')} || CASE WHEN label = 'File' THEN ',,' || {_field('file_path')} || ',,,,' ELSE ',' || {_field('file_path')} END AS line FROM nodes")
def csv_node_lines(spark, sf_dir):
    """File and Folder nodes as lines of their own layouts."""
    nodes = store.flattened(G.folder_hierarchy(page_files(spark, sf_dir))[0])
    line = F.when(F.col("label") == "File", store.csv_lines(nodes, store.columns_of("File"))).otherwise(store.csv_lines(nodes, store.columns_of("Folder")))
    return nodes.select("label", line.alias("line"))


@query(f"WITH {PAGES_SQL} SELECT {_field('source_id')} || ',' || {_field('target_id')} || ',' || {_field('id')} || ',CONTAINS,,,,' AS line FROM edges")
def csv_relation_lines(spark, sf_dir):
    edges = G.folder_hierarchy(page_files(spark, sf_dir))[1].withColumnsRenamed({"source_id": "from", "target_id": "to"})
    return edges.select(store.csv_lines(edges, T.RELATION_COLUMNS).alias("line"))


@query("SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def load_lost_by_label(spark, sf_dir):
    """A load of nodes whose labels the schema lacks: all are lost, counted by label."""
    nodes, edges = commerce(spark, sf_dir)
    told = store.load_graph(nodes, edges.withColumn("id", F.concat_ws("-", "source_id", "target_id")), f"{cut(spark.range(0)).inputFiles()[0].rsplit('/', 1)[0]}-graph")
    return inline(spark, sorted(told["failed"].items()), "label string, n long")


@query(f"WITH {SNAPSHOTS_SQL} SELECT old.path, old.hash FROM old JOIN cur ON old.path = cur.path AND old.hash = cur.hash WHERE old.path NOT LIKE '%5'")
def parse_cache_at_rest(spark, sf_dir):
    """A cache put to rest, some of it dropped, asked for what still holds."""
    current, old = snapshots(spark, sf_dir)
    cache = store.ParseCache(spark, f"{cut(spark.range(0)).inputFiles()[0].rsplit('/', 1)[0]}-cache")
    cache.put(old.withColumn("rows", F.lit("[]")), 1)
    cache.drop(old.filter("path LIKE '%5'").select("path"), 2)
    return cache.get(current).select("path", "hash")


@query("SELECT count(*) AS n FROM embeddings")
def embeddings_stored(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    path = f"{cut(spark.range(0)).inputFiles()[0].rsplit('/', 1)[0]}-embeddings"
    store.store_embeddings(rows, path)
    left = store.to_embed(rows, store.stored_embeddings(spark, path))
    return store.stored_embeddings(spark, path).join(left, "id", "left_anti").agg(F.count("*").alias("n"))


# Snapshots and hashes


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT md5(text) AS hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def dedup_first_wins(spark, sf_dir):
    return G.first_wins(table(spark, sf_dir, "documents").select(F.md5("text").alias("hash"), "doc_id", "source"), "hash", ["doc_id"])


@query(f"WITH {SNAPSHOTS_SQL} SELECT * FROM delta")
def delta_classify(spark, sf_dir):
    return L.delta(*snapshots(spark, sf_dir))


@query(f"WITH {SNAPSHOTS_SQL} SELECT status, count(*) AS n FROM delta GROUP BY 1")
def delta_summary(spark, sf_dir):
    return L.delta(*snapshots(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {SNAPSHOTS_SQL} SELECT path, hash FROM old WHERE path IN (SELECT path FROM delta WHERE status = 'unchanged') UNION ALL SELECT path, hash FROM cur WHERE path IN (SELECT path FROM delta WHERE status IN ('new', 'modified'))")
def incremental_rebuild(spark, sf_dir):
    current, cached = snapshots(spark, sf_dir)
    return L.rebuilt(cached, current, L.delta(current, cached))


@query(f"WITH {SNAPSHOTS_SQL} SELECT old.path, old.hash FROM old JOIN cur ON old.path = cur.path AND old.hash = cur.hash")
def cache_hit_join(spark, sf_dir):
    return store.cached(*snapshots(spark, sf_dir))


# Scalars


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS lines FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.line_count(F.col("text")).alias("lines"))


@query("SELECT doc_id, substring(text, 1, 10000) AS content FROM documents")
def truncate_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 10_000).alias("content"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[3:8], chr(10)) AS part FROM documents")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.snippet(F.col("text"), 2, 7).alias("part"))


@query("SELECT doc_id, CASE WHEN regexp_matches(c, '[,\"\\r\\n]') THEN '\"' || replace(c, '\"', '\"\"') || '\"' ELSE c END AS field FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS c FROM documents)")
def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.csv_field(F.col("text")).alias("field"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round((length(text) - length(replace(text, chr(65533), ''))) / length(text), 6) END AS share FROM documents")
def replacement_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.replacement_share(F.col("text")), 6).alias("share"))


@query("SELECT doc_id, round(abs(-sum(p * log2(p))), 6) AS bits FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY 1, 2)) GROUP BY 1")
def entropy_chars(spark, sf_dir):
    """Entropy of all characters of the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.char_entropy(F.col("text")), 6).alias("bits"))


@query("SELECT doc_id, round(abs(-sum(p * log2(p))), 6) AS bits FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY 1, 2)) GROUP BY 1")
def entropy_bytes(spark, sf_dir):
    """Entropy of all bytes of the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.byte_entropy(F.encode("text", "UTF-8")), 6).alias("bits"))


BYTES = [("empty", "", False), ("bom", "FFFE4100", False), ("nul", "410042", True), ("text", "48656C6C6F20776F726C64", False), ("control", "0102034142", True), ("few", "01" + "41" * 19, False), ("random", "".join(f"{(i * 167 + 13) % 255 + 1:02X}" for i in range(2048)), True)]


@query(f"SELECT name, is_binary FROM (VALUES {values([(n, b) for n, _, b in BYTES])}) t(name, is_binary)")
def binary_flag(spark, sf_dir):
    rows = inline(spark, [(n, h) for n, h, _ in BYTES], "name string, hex string")
    return rows.select("name", S.is_binary_content(F.unhex("hex")).alias("is_binary"))


@query("WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents), w AS (SELECT i, doc_id, n_chars AS total, 0::BIGINT AS chunk FROM o WHERE i = 1 UNION ALL SELECT o.i, o.doc_id, CASE WHEN w.total > 0 AND w.total + o.n_chars > 50000 THEN o.n_chars ELSE w.total + o.n_chars END, CASE WHEN w.total > 0 AND w.total + o.n_chars > 50000 THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN o ON o.i = w.i + 1) SELECT doc_id, chunk FROM w")
def byte_budget_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("n_chars").alias("size"))
    return files.chunk_numbers(rows, 50_000).select(F.col("seq").alias("doc_id"), "chunk")


HEADS = [("a.m", "#import <x>\n@interface A\n@end", "objective_c"), ("b.m", "function y = f(x)\nend\n", "matlab"), ("c.m", "A\n S X=1\n SET Y=2\n DO B\n", "mumps"), ("d.m", "nothing", "objective_c"), ("e.cls", "VERSION 1.0 CLASS\nBEGIN\n", "vb6"), ("f.cls", "public class A {}", "apex"), ("g.pl", "use strict;\nmy $x;", "perl"), ("h.pl", ":- module(x, []).", "prolog"), ("src/I.PY", "x", "python"), ("j", "x", None), (".bashrc", "x", None), ("k.tar.go", "x", "go")]


@query(f"SELECT path, language FROM (VALUES {values([(p, lang) for p, _, lang in HEADS])}) t(path, language)")
def disambiguate(spark, sf_dir):
    rows = inline(spark, [(p, h) for p, h, _ in HEADS], "path string, head string")
    return rows.select("path", S.language_of(F.col("path"), F.col("head")).alias("language"))


IGNORE = ["*.log", "/build", "dir/", "**/tmp", "!keep.log", "# no", "", "docs/*.txt"]
PATHS = [("a.log", True), ("keep.log", False), ("x/keep.log", False), ("build/a.py", True), ("x/build/a.py", False), ("x/dir/a.py", True), ("dir", False), ("x/y/tmp/z", True), ("docs/a.txt", True), ("docs/x/a.txt", False), ("data/a.py", True), ("src/a.py", False)]


@query(f"SELECT path, ignored FROM (VALUES {values(PATHS)}) t(path, ignored)")
def gitignore_filter(spark, sf_dir):
    rows = inline(spark, [(p,) for p, _ in PATHS], "path string")
    return rows.select("path", files.is_ignored(F.col("path"), IGNORE).alias("ignored"))


NAMES = [("useAuth", "useAuth use auth"), ("AuthGuard", "AuthGuard auth guard"), ("get_user_by_id", "get_user_by_id get user by id"), ("HTMLParser", "HTMLParser html parser"), ("my-component", "my-component my component"), ("", ""), ("get2ndItem", "get2ndItem get 2 nd item")]


@query(f"SELECT name, parts FROM (VALUES {values(NAMES)}) t(name, parts)")
def split_identifier(spark, sf_dir):
    return inline(spark, [(n,) for n, _ in NAMES], "name string").select("name", S.split_identifier(F.col("name")).alias("parts"))


SIGNED = [("f", "(a, b)", "-> int", "f(a, b) -> int", 2), ("g", "()", None, "g()", 0), ("h", "(self, x: Map[A, B])", ": T", "h(self, x: Map[A, B]) -> T", 3), ("k", "(" + "x" * 600 + ")", None, ("k(" + "x" * 600)[:497] + "...", 1)]


@query(f"SELECT name, signature, n FROM (VALUES {values([(a, d, e) for a, _, _, d, e in SIGNED])}) t(name, signature, n)")
def brief_signature(spark, sf_dir):
    rows = inline(spark, [r[:3] for r in SIGNED], "name string, params string, returns string")
    return rows.select("name", S.brief_signature(F.col("name"), F.col("params"), F.col("returns")).alias("signature"), S.parameter_count(F.col("params")).alias("n"))


COMMENTS = [(1, "/** One.\n * Two.\n */", "One.\nTwo."), (2, "/* plain */", "plain")]


@query(f"SELECT id, text FROM (VALUES {values([(i, t) for i, _, t in COMMENTS])}) t(id, text)")
def strip_comments(spark, sf_dir):
    return inline(spark, [(i, c) for i, c, _ in COMMENTS], "id int, c string").select("id", S.strip_block_comment(F.col("c")).alias("text"))


ROUTES = [("a/./b/../c", "a/c"), ("../x", "x"), ("a//b", "a/b"), ("./a", "a"), ("a/b/../../c", "c")]


@query(f"SELECT path, plain FROM (VALUES {values(ROUTES)}) t(path, plain)")
def relpath_normalize(spark, sf_dir):
    return inline(spark, [(p,) for p, _ in ROUTES], "path string").select("path", S.normal_path(F.col("path")).alias("plain"))


DOTTED = [(".x", "a/b/c.py", "a/b/x"), ("..x.y", "a/b/c.py", "a/x/y"), ("....x", "a/b/c.py", None), ("m.n", "a/b/c.py", "m/n"), (".", "a/b/c.py", "a/b")]


@query(f"SELECT module, stem FROM (VALUES {values([(a, c) for a, _, c in DOTTED])}) t(module, stem)")
def relative_imports(spark, sf_dir):
    rows = inline(spark, [r[:2] for r in DOTTED], "module string, file string")
    return rows.select("module", S.relative_module(F.col("module"), F.col("file")).alias("stem"))


_EXTENSIONS = values(sorted(T.LANGUAGE_OF.items()))


@query(f"WITH e AS (SELECT *, row_number() OVER (ORDER BY ext) - 1 AS i FROM (VALUES {_EXTENSIONS}) t(ext, language)) SELECT page_id, language FROM pages JOIN e ON page_id % {len(T.LANGUAGE_OF)} = i")
def language_of_pages(spark, sf_dir):
    """Every suffix that a language has, dealt to the pages."""
    ends = F.array(*[F.lit(x) for x in sorted(T.LANGUAGE_OF)])
    path = F.concat(F.lit("a.b/c"), F.get(ends, (F.col("page_id") % len(T.LANGUAGE_OF)).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", S.language_of(path, F.lit("")).alias("language"))


@query("SELECT page_id, page_id % 3 = 0 AS tsx FROM pages")
def tsx_pages(spark, sf_dir):
    path = F.concat(F.lit("a/b"), F.element_at(F.array(F.lit(".tsx"), F.lit(".ts"), F.lit(".jsx")), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", S.is_tsx(path).alias("tsx"))


@query("SELECT p_partkey AS id, replace(p_name, ' ', '_') || CASE WHEN len(regexp_extract_all(p_name, '[a-z]+|[0-9]+')) = 0 THEN '' ELSE ' ' || array_to_string(regexp_extract_all(p_name, '[a-z]+|[0-9]+'), ' ') END AS parts FROM part WHERE p_name = lower(p_name) AND NOT regexp_matches(p_name, '[^a-z0-9 ]')")
def split_part_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").filter("p_name = lower(p_name) AND NOT p_name RLIKE '[^a-z0-9 ]'")
    return rows.select(F.col("p_partkey").alias("id"), S.split_identifier(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("parts"))


@query("SELECT p_partkey AS id, p_name || '(' || p_brand || ', ' || p_type || ') -> ' || p_size AS signature, 2 AS n FROM part")
def part_signatures(spark, sf_dir):
    params = F.concat(F.lit("("), "p_brand", F.lit(", "), "p_type", F.lit(")"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.brief_signature(F.col("p_name"), params, F.concat(F.lit("-> "), F.col("p_size").cast("string"))).alias("signature"), S.parameter_count(params).alias("n"))


@query(f"WITH {FILES_SQL} SELECT path, 'a/' || path AS plain FROM files WHERE NOT regexp_matches(path, '(^|/)\\.{{0,2}}(/|$)')")
def page_paths_normal(spark, sf_dir):
    rows = page_files(spark, sf_dir).filter(r"NOT path RLIKE '(^|/)\\.{0,2}(/|$)'")
    return rows.select("path", S.normal_path(F.concat(F.lit("./a/b/../"), "path", F.lit("/x/.."))).alias("plain"))


@query("SELECT p_partkey AS id, 'a/' || p_size || '/m' || p_partkey AS stem FROM part")
def part_relative_modules(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.relative_module(F.concat(F.lit(".."), size, F.lit(".m"), key), F.lit("a/b/c.py")).alias("stem"))


@query("SELECT p_partkey AS id, p_name || chr(10) || p_brand AS block, p_name || chr(10) || p_brand AS slashes, p_name AS hash, p_name AS plain FROM part")
def clean_docstrings(spark, sf_dir):
    both = lambda a, b, c, d: F.concat(F.lit(a), F.col("p_name"), F.lit(b), F.col("p_brand") if c else F.lit(""), F.lit(d))
    clean = lambda raw, language: S.clean_docstring(raw, F.lit(language))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), clean(both("/** ", "\n * ", True, "\n */"), "java").alias("block"), clean(both("/// ", "\n/// ", True, ""), "rust").alias("slashes"), clean(both("# ", "", False, ""), "ruby").alias("hash"), clean(F.col("p_name"), "python").alias("plain"))


@query("SELECT p_partkey AS id, p_size % 2 = 0 AS java, p_size % 3 = 0 AS go, p_size % 2 <> 0 AS kotlin, true AS perl FROM part")
def exported_by_language(spark, sf_dir):
    even = F.col("p_size") % 2 == 0
    told = lambda language, name, text: S.is_exported(F.lit(language), name, text)
    name = F.when(F.col("p_size") % 3 == 0, "Public").otherwise("private")
    java = F.concat(F.when(even, "public ").otherwise(""), F.lit("class Thing {"))
    kotlin = F.concat(F.when(even, "private ").otherwise(""), F.lit("fun go() {"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), told("java", F.lit("Thing"), java).alias("java"), told("go", name, F.lit("func x()")).alias("go"), told("kotlin", F.lit("go"), kotlin).alias("kotlin"), told("perl", F.lit("x"), F.lit("sub x")).alias("perl"))


@query("SELECT p_partkey AS id, 'Module m' || p_partkey || chr(10) || 'Public Structure T' || p_size || chr(10) || '  x As Long' || chr(10) || 'End Structure' || chr(10) || 'a = b' || chr(10) || 'End While' || chr(10) || chr(10) || 'End Module' || chr(10) AS code FROM part")
def vb6_rewritten(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    code = F.concat(F.lit('VERSION 1.0 CLASS\nBEGIN\n  MultiUse = -1\nEND\nAttribute VB_Name = "x"\nPublic Type T'), size, F.lit("\n  x As Long\nEnd Type\nSet a = b\nWend\n"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.vb6_as_vb(code, F.concat(F.lit("m"), key)).alias("code"))


@query("SELECT n_nationkey AS id, '@' || n_name || '/' AS alias, 'src/' || n_regionkey || '/' AS target, 'example.org/' || n_nationkey AS go, 'App' || n_regionkey AS space, 'lib/' || n_nationkey AS folder, 'A.N' || n_nationkey AS root FROM nation")
def configs_of_nations(spark, sf_dir):
    """Configuration files for every nation, read back."""
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    ts = F.concat(F.lit('{ // paths\n "compilerOptions": {"paths": {"@'), "n_name", F.lit('/*": ["src/'), region, F.lit('/*", "x"]}}}'))
    php = F.concat(F.lit('{"autoload": {"psr-4": {"App'), region, F.lit('": "old"}}, "autoload-dev": {"psr-4": {"App'), region, F.lit('": ["lib/'), key, F.lit('/", "y"]}}}'))
    project = F.concat(F.lit("<Project><RootNamespace>A.N"), key, F.lit("</RootNamespace></Project>"))
    aliases, spaces = files.tsconfig_aliases(ts), files.psr4(php)
    go = files.go_module(F.concat(F.lit("// m\nmodule example.org/"), key, F.lit("\ngo 1.2\n")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.map_keys(aliases)[0].alias("alias"), F.map_values(aliases)[0].alias("target"), go.alias("go"), F.map_keys(spaces)[0].alias("space"), F.map_values(spaces)[0].alias("folder"), files.root_namespace(F.lit("a/x.csproj"), project).alias("root"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def file_texts(spark, sf_dir):
    """Texts as the bytes of files, read back: none is binary."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.texts(rows).select(F.col("path").cast("long").alias("doc_id"), F.sha2("content", 256).alias("hash"))


@query("SELECT 'Part:' || p_partkey || ':' || p_name AS id FROM part")
def node_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(S.node_id("Part", F.col("p_partkey"), F.col("p_name")).alias("id"))


@query("SELECT doc_id, sha256(text) AS hash, length(text) - length(replace(text, chr(10), '')) AS line_count FROM documents")
def file_facts(spark, sf_dir):
    """Texts as files: digest of the bytes, and lines."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    facts = G.file_facts(rows).select(F.regexp_replace("id", "^File:", "").alias("path"), "line_count")
    return files.file_hashes(rows).join(facts, "path").select(F.col("path").cast("long").alias("doc_id"), "hash", "line_count")


@query("SELECT page_id, substring(md5(url), 1, 12) AS key FROM pages")
def repo_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.storage_key(F.col("url")).alias("key"))


@query("SELECT event_id, coalesce((props::JSON->>'k')::BIGINT, -1) AS k FROM events")
def prop_alias(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


# Symbols


@query(f"WITH {SYMBOLS_SQL} SELECT file_path, name, min(seq) AS seq, arg_min(node_id, seq) AS node_id FROM symbols GROUP BY 1, 2")
def symbol_exact(spark, sf_dir):
    return L.Symbols(symbol_table(spark, sf_dir)).exact().select("file_path", "name", "seq", "node_id")


FIRST = "(SELECT p_name FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))"


def _first_name(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.min_by("p_name", "p_partkey")).first()[0]


@query(f"WITH {SYMBOLS_SQL} SELECT seq, node_id, type FROM symbols WHERE type <> 'Property' AND name = {FIRST}")
def symbol_global(spark, sf_dir):
    return L.Symbols(symbol_table(spark, sf_dir)).named(_first_name(spark, sf_dir)).select("seq", "node_id", "type")


@query(f"WITH {SYMBOLS_SQL} SELECT seq, node_id, type FROM symbols WHERE type IN ('Function', 'Method', 'Constructor') AND name = {FIRST}")
def symbol_callable(spark, sf_dir):
    return L.Symbols(symbol_table(spark, sf_dir)).callables(_first_name(spark, sf_dir)).select("seq", "node_id", "type")


@query(f"WITH {SYMBOLS_SQL} SELECT owner_id, name, min(seq) AS seq FROM symbols WHERE owner_id IS NOT NULL AND type IN ('Property', 'Method', 'Constructor') GROUP BY 1, 2")
def symbol_field(spark, sf_dir):
    return L.Symbols(symbol_table(spark, sf_dir)).fields().select("owner_id", "name", "seq")


@query(f"WITH {SYMBOLS_SQL} SELECT count(DISTINCT file_path) AS files, count(*) AS symbols, count(DISTINCT CASE WHEN type <> 'Property' THEN name END) AS global_names FROM symbols")
def symbol_stats(spark, sf_dir):
    return L.Symbols(symbol_table(spark, sf_dir)).stats()


@query(f"WITH {SYMBOLS_SQL} SELECT seq, node_id, type FROM symbols WHERE name = {FIRST} ORDER BY list_position({T.SEARCH_ORDER}, type), node_id, seq LIMIT 5")
def match_by_name(spark, sf_dir):
    return L.Symbols(symbol_table(spark, sf_dir)).match("name", _first_name(spark, sf_dir), 5).select("seq", "node_id", "type")


@query(f"WITH {SYMBOLS_SQL} SELECT seq, node_id, type FROM symbols WHERE file_path = 'Brand#11' ORDER BY list_position({T.SEARCH_ORDER}, type), node_id, seq LIMIT 20")
def match_by_file(spark, sf_dir):
    return L.Symbols(symbol_table(spark, sf_dir)).match("file_path", "Brand#11", 20).select("seq", "node_id", "type")


@query(f"WITH {SYMBOLS_SQL} SELECT seq, node_id, type FROM symbols WHERE file_path = 'Brand#11' AND name = (SELECT min(name) FROM symbols WHERE file_path = 'Brand#11')")
def symbol_exact_all(spark, sf_dir):
    symbols = symbol_table(spark, sf_dir)
    name = symbols.filter("file_path = 'Brand#11'").agg(F.min("name")).first()[0]
    return L.Symbols(symbols).exact_all("Brand#11", name).select("seq", "node_id", "type")


# Search

VECTORS = "q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], e) AS distance FROM embeddings, q)"


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rows, [float(v) for v in rows.filter("id = 0").first()["embedding"]]


@query(f"WITH {VECTORS} SELECT id, round(distance, 6) AS distance FROM d ORDER BY d.distance, id LIMIT 10")
def vector_topk(spark, sf_dir):
    return Q.nearest(*_vectors(spark, sf_dir), 10).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {VECTORS} SELECT id, round(distance, 6) AS distance FROM d WHERE distance <= 0.9 ORDER BY d.distance, id LIMIT 50")
def vector_within(spark, sf_dir):
    return Q.nearest(*_vectors(spark, sf_dir), 50, most=0.9).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {VECTORS} SELECT d.id, round(distance, 6) AS distance, embedding[1]::DOUBLE AS first, len(embedding)::INT AS size FROM d JOIN embeddings ON vec_id = d.id ORDER BY d.distance, d.id LIMIT 10")
def vector_with_embedding(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir)
    found = Q.nearest(rows, q, 10).join(rows, "id")
    return found.select("id", F.round("distance", 6).alias("distance"), F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("size"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(0.7 * list_cosine_similarity(embedding::DOUBLE[], e) + 0.3 * (1 - levenshtein(vec_id::VARCHAR, '12345') / greatest(length(vec_id::VARCHAR), 5)), 6) AS score FROM embeddings, q")
def blended_similarity(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir)
    near = S.cosine(F.col("embedding"), F.array(*[F.lit(v) for v in q]))
    return rows.select("id", F.round(Q.blended(near, F.col("id").cast("string"), F.lit("12345")), 6).alias("score"))


@query()
def mmr_rerank(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir)
    return Q.rerank_mmr(rows, q, 10)


TERMS = ["the", "and", "with"]
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
_DF = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(TERMS)))
_PART = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / mean)) ELSE 0 END" for i in range(len(TERMS)))
BM25 = f"words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), tf AS (SELECT doc_id, len(w) AS l, {_TF} FROM words), st AS (SELECT count(*) AS n, avg(l) AS mean, {_DF} FROM tf), scored AS (SELECT doc_id, {_PART} AS score FROM tf, st)"


@query(f"WITH {BM25} SELECT doc_id, round(score, 4) AS score FROM scored WHERE score > 0 ORDER BY scored.score DESC, doc_id LIMIT 20")
def bm25_search(spark, sf_dir):
    return Q.bm25(table(spark, sf_dir, "documents"), TERMS).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {BM25}, {VECTORS}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM scored WHERE score > 0 QUALIFY r <= 50), b AS (SELECT id, row_number() OVER (ORDER BY round(distance, 9), id) AS r FROM d QUALIFY r <= 50) SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 8)::DOUBLE AS score FROM a FULL JOIN b ON a.id = b.id")
def rrf_fusion(spark, sf_dir):
    """Two top-50 lists; a window over 50 rows ranks each."""
    rows, q = _vectors(spark, sf_dir)
    text = Q.bm25(table(spark, sf_dir, "documents"), TERMS).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("s")).orderBy(F.desc("s"), "id").limit(50)
    near = Q.nearest(rows, q, 100).select("id", F.round("distance", 9).alias("s")).orderBy("s", "id").limit(50)
    text = text.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "id")))
    near = near.withColumn("rank", F.row_number().over(Window.orderBy("s", "id")))
    return Q.fused(text, near).select("id", F.round("score", 8).alias("score"))


@query(f"WITH {BM25}, hits AS (SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY 2 DESC, doc_id LIMIT 50) SELECT source AS community, count(*) AS hits, round(sum(score), 4) AS score, CASE WHEN count(*) >= 5 THEN 'strong' WHEN count(*) >= 2 THEN 'moderate' ELSE 'weak' END AS signal FROM hits JOIN documents USING (doc_id) GROUP BY 1")
def hits_by_community(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = Q.bm25(docs, TERMS).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    found = Q.by_community(hits, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("community")))
    return found.withColumn("score", F.round("score", 4))


@query("WITH touching AS (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') SELECT o_custkey AS process, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS ids FROM orders WHERE o_custkey IN (SELECT o_custkey FROM touching) GROUP BY 1")
def processes_touching(spark, sf_dir):
    """Customers' orders as processes, return flags as communities."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("process"), F.struct("o_orderdate", "o_orderkey").alias("step"), F.col("o_orderkey").alias("id"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("community"))
    return Q.processes_of(orders, members, "R").select("process", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"SELECT p_partkey AS id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z]+|[0-9]+')), lambda w: w NOT IN ({', '.join(repr(w) for w in Q.STOP_WORDS)}))), ' ') AS terms FROM part")
def query_terms(spark, sf_dir):
    """Part names, their words apart: lower case, no word twice, no stop word."""
    spaced = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.sort_array(Q.query_terms(spaced)), " ").alias("terms"))


# Ordered walks


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS class_id FROM events QUALIFY event_type = 'purchase'")
def heritage_carry(spark, sf_dir):
    rows = G.carried_forward(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type = 'signup'", "event_id", "class_id")
    return rows.filter("event_type = 'purchase'").select("event_id", "class_id")


@query("WITH p AS (SELECT *, sum((event_type = 'view')::INT) OVER w AS part, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS receiver FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, receiver FROM p WHERE event_type = 'click' AND part > 0 QUALIFY row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id) = 1")
def assignment_next_only(spark, sf_dir):
    return G.next_only(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type = 'view'", "event_type = 'click'", "event_id", "receiver").select("event_id", "receiver")


@query("WITH g AS (SELECT conv_id, turn, coalesce((turn - lag(turn) OVER w > 2)::INT, 0) AS new FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT conv_id, run::BIGINT AS run, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY 1, 2")
def comment_runs(spark, sf_dir):
    return G.runs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 2, "role", "user")


# Resolution

_TAILS = "[" + ", ".join(repr(x) for x in T.RESOLVE_SUFFIXES) + "]"
_TARGETS = f"{FILES_SQL}, told AS (SELECT DISTINCT path || {_TAILS}[length(path) % 30 + 1] AS path FROM files UNION SELECT path || {_TAILS}[length(path) * 7 % 30 + 1] FROM files)"


def _suffixed(pages: DataFrame) -> DataFrame:
    tails = F.array(*[F.lit(x) for x in T.RESOLVE_SUFFIXES])
    one = lambda i: pages.select(F.concat("path", F.get(tails, i)).alias("path"))
    return one(F.length("path") % 30).unionByName(one(F.length("path") * 7 % 30)).distinct()


@query(f"WITH {_TARGETS}, tries AS (SELECT path AS raw, i, path || {_TAILS}[i] AS target FROM files, unnest(range(1, 31)) t(i)) SELECT 'here' AS from_file, './x/../' || raw AS raw_path, arg_min(target, i) AS target FROM tries WHERE target IN (SELECT path FROM told) GROUP BY raw")
def import_candidates_exact(spark, sf_dir):
    """Every path with two of the thirty suffixes as files: the earlier one wins."""
    pages = page_files(spark, sf_dir)
    imports = pages.select(F.lit("here").alias("from_file"), F.concat(F.lit("./x/../"), "path").alias("raw_path"))
    return L.resolved_exact(imports, _suffixed(pages))


_PY = "replace(replace(path, '.', '_'), '-', '_')"


@query(f"WITH {FILES_SQL}, mods AS (SELECT DISTINCT {_PY} AS m FROM files) SELECT 'x.py' AS from_file, replace(m, '/', '.') AS raw_path, m || CASE WHEN length(m) % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS target FROM mods WHERE m LIKE '%/%'")
def imports_python(spark, sf_dir):
    """Dotted imports of page paths, half of them packages."""
    plain = page_files(spark, sf_dir).select(F.expr(_PY).alias("m")).distinct()
    known = plain.select(F.concat("m", F.when(F.length("m") % 2 == 0, ".py").otherwise("/__init__.py")).alias("path"))
    imports = plain.filter("m LIKE '%/%'").select(F.lit("python").alias("language"), F.lit("x.py").alias("from_file"), F.replace("m", F.lit("/"), F.lit(".")).alias("raw_path"))
    return I.resolved(imports, known)


@query(f"WITH {FILES_SQL}, own AS (SELECT path || '.go' AS path, regexp_replace(path, '/[^/]*$', '') AS folder FROM files WHERE path LIKE '%/%'), wanted AS (SELECT DISTINCT folder FROM own) SELECT 'm.go' AS from_file, 'example.org/mod/' || w.folder AS raw_path, own.path AS target FROM wanted w JOIN own ON own.folder = w.folder OR ends_with(own.folder, '/' || w.folder)")
def imports_go(spark, sf_dir):
    """Packages of a module: all files of their folders."""
    pages = page_files(spark, sf_dir).filter("path LIKE '%/%'")
    folders = pages.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    imports = folders.select(F.lit("go").alias("language"), F.lit("m.go").alias("from_file"), F.concat(F.lit("example.org/mod/"), "folder").alias("raw_path"))
    return I.resolved(imports, pages.select(F.concat("path", F.lit(".go")).alias("path")), I.Configs(go_module="example.org/mod"))


@query(f"WITH {FILES_SQL} SELECT 'm.swift' AS from_file, top AS raw_path, path || '.swift' AS target FROM (SELECT path, string_split(path, '/')[1] AS top FROM files WHERE path LIKE '%/%') WHERE top IN (SELECT DISTINCT string_split(path, '/')[1] FROM files ORDER BY 1 LIMIT 5)")
def imports_swift(spark, sf_dir):
    """Five hosts as package targets: every file below."""
    pages = page_files(spark, sf_dir)
    tops = [r["top"] for r in pages.select(F.split("path", "/")[0].alias("top")).distinct().orderBy("top").limit(5).collect()]
    imports = inline(spark, [("swift", "m.swift", t) for t in tops], "language string, from_file string, raw_path string")
    return I.resolved(imports, pages.select(F.concat("path", F.lit(".swift")).alias("path")), I.Configs(swift_targets={t: t for t in tops}))


@query(f"WITH {FILES_SQL}, tails AS (SELECT path, array_to_string(p[i:], '/') AS t FROM (SELECT path, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM files)), idx AS (SELECT DISTINCT path, t AS suffix FROM tails UNION SELECT path, regexp_replace(t, '\\.[^./]+$', '') FROM tails) SELECT suffix, path FROM idx WHERE suffix IN (SELECT string_split(path, '/')[-1] FROM files)")
def suffix_all(spark, sf_dir):
    """All paths of every last part."""
    pages = page_files(spark, sf_dir)
    return L.with_suffix(L.suffix_index(pages), pages.select(F.element_at(F.split("path", "/"), -1).alias("suffix")))


SUFFIXES = f"WITH {FILES_SQL}, parts AS (SELECT path, string_split(%s, '/') AS p FROM files), tails AS (SELECT path, array_to_string(p[i:], '/') AS t FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM parts)), idx AS (SELECT DISTINCT path, t AS suffix FROM tails UNION SELECT path, regexp_replace(t, '\\.[^./]+$', '') FROM tails) SELECT suffix, min(path) AS path FROM idx GROUP BY 1 HAVING count(DISTINCT path) = 1"


@query(SUFFIXES.replace("%s", "path"))
def suffix_unique(spark, sf_dir):
    return L.unique_suffixes(L.suffix_index(page_files(spark, sf_dir)))


@query(SUFFIXES.replace("%s", "lower(path)"))
def suffix_insensitive(spark, sf_dir):
    return L.unique_suffixes(L.suffix_index(page_files(spark, sf_dir), lower=True))


@query(f"WITH {FILES_SQL}, own AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS f FROM files), last AS (SELECT path, string_split(f, '/')[-1] AS folder FROM own) SELECT folder, path FROM last WHERE folder <> ''")
def dir_expand(spark, sf_dir):
    pages = page_files(spark, sf_dir)
    folders = pages.select(F.element_at(F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/"), -1).alias("folder")).filter("folder <> ''").distinct()
    return L.in_folder(folders, pages)


RULES = [("www", "w"), ("www.example", "we"), ("example", "e"), ("shop", "s")]


@query(f"WITH {FILES_SQL}, rules AS (SELECT * FROM (VALUES {values(RULES)}) t(prefix, target)) SELECT path, prefix, target FROM files JOIN rules ON starts_with(path, prefix) AND (length(path) = length(prefix) OR substring(path, length(prefix) + 1, 1) IN ('/', '.')) QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(prefix) DESC) = 1")
def prefix_longest(spark, sf_dir):
    return L.longest_prefix(page_files(spark, sf_dir), inline(spark, RULES, "prefix string, target string"))


BOUND = [("f", "x", "A", "seeded", 1), ("f", "x", "B", "explicit", 2), ("f", "x", "C", "explicit", 3), ("f", "y", "", "explicit", 4), ("f", "y", "D", "return", 5), ("g", "x", "E", "constructor", 6)]


@query(f"WITH b AS (SELECT * FROM (VALUES {values(BOUND)}) t(path, var, type, tier, seq)) SELECT path, var, type FROM b WHERE type <> '' QUALIFY row_number() OVER (PARTITION BY path, var ORDER BY list_position(['explicit', 'constructor', 'seeded', 'return'], tier), seq DESC) = 1")
def type_priority(spark, sf_dir):
    return L.receiver_types(inline(spark, BOUND, "path string, var string, type string, tier string, seq int"))


@query(f"SELECT w AS name, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE w <> '' AND w NOT IN ({', '.join(repr(b) for b in sorted(T.BUILTIN_CALLS))}) GROUP BY 1")
def builtin_filter(spark, sf_dir):
    """Words as calls, those of built-in names left out."""
    words = table(spark, sf_dir, "documents").select(F.lit("call").alias("kind"), F.explode(F.split("text", r"\s+")).alias("name")).filter("name <> ''")
    return extract.without_builtins(words).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT n_name AS name, n_nationkey AS path, 'new' AS indexed_at FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, n_nationkey, 'old' FROM nation WHERE n_regionkey <> 1 AND n_nationkey % 2 = 0")
def registry_of_nations(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    of = lambda rows, at: rows.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("path"), F.lit(at).alias("indexed_at"))
    return L.upserted(of(nation.filter("n_nationkey % 2 = 0"), "old"), of(nation.filter("n_regionkey = 1"), "new"))


@query("SELECT r_name AS name, r_regionkey AS path, 'a' || r_regionkey AS indexed_at FROM region WHERE lower(r_name) = 'asia'")
def registry_newest(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("path"), F.concat(F.lit("a"), F.col("r_regionkey").cast("string")).alias("indexed_at"))
    return L.newest(rows, "Asia")


OLD = [("a", "/a", "2024-01-01"), ("B", "/b", "2024-01-02")]
NEW = [("a2", "/a", "2024-02-01"), ("b", "/c", "2024-03-01")]


@query(f"SELECT * FROM (VALUES {values([*NEW, OLD[1]])}) t(name, path, indexed_at)")
def registry_upsert(spark, sf_dir):
    schema = "name string, path string, indexed_at string"
    return L.upserted(inline(spark, OLD, schema), inline(spark, NEW, schema))


# Extraction (golden rows)

PYTHON = '''from models.user import User, Repo as Repository

class Service(Base):
    """Builds users for the whole test."""

    def build(self, raw: Optional[User]) -> User:
        self.user = User(raw)
        return self.user

def helper():
    repo = Repository()
    return Service().build(repo)

def _private():
    pass
'''
SOURCES = [("sample.py", PYTHON), ("x.abap", "REPORT z.\nFORM go.\nPERFORM run.\nINCLUDE inc.\n"), ("x.tcl", "package require Tk\nproc draw {a} {\n}\n"), ("x.rpg", "DCL-PROC main;\nEXSR sub1;\nBEGSR sub1;\n"), ("x.zig", "fn a() {}")]


def _extracted(spark, kind):
    return extract.extracted(inline(spark, SOURCES, "path string, content string")).filter(F.col("kind") == kind)


@query(f"SELECT * FROM (VALUES {values([('sample.py', 'Service', 'Class', None, 2), ('sample.py', 'build', 'Method', 'Service', 5), ('sample.py', 'helper', 'Function', None, 9), ('sample.py', '_private', 'Function', None, 13), ('x.abap', 'z', 'report', None, 0), ('x.abap', 'go', 'form_definition', None, 1), ('x.tcl', 'draw', 'proc_definition', None, 1), ('x.rpg', 'main', 'dcl_proc', None, 0), ('x.rpg', 'sub1', 'begsr', None, 2)])}) t(path, name, label, owner, line)")
def definitions(spark, sf_dir):
    return _extracted(spark, "definition").select("path", "name", "label", "owner", F.col("line").cast("int").alias("line"))


@query(f"SELECT * FROM (VALUES {values([('sample.py', 'models.user', 'User=User,Repository=Repo'), ('x.abap', 'inc', None), ('x.tcl', 'Tk', None)])}) t(path, name, detail)")
def imports(spark, sf_dir):
    return _extracted(spark, "import").select("path", "name", "detail")


@query(f"SELECT * FROM (VALUES {values([('sample.py', 'User', 'constructor', None), ('sample.py', 'Repository', 'constructor', None), ('sample.py', 'build', 'member', None), ('sample.py', 'Service', 'constructor', None), ('x.abap', 'run', 'call_expression', None), ('x.rpg', 'sub1', 'call_expression', None)])}) t(path, name, form, receiver)")
def calls(spark, sf_dir):
    return _extracted(spark, "call").select("path", "name", F.col("label").alias("form"), F.col("detail").alias("receiver"))


@query("SELECT 'sample.py' AS path, 'Service' AS name, 'Base' AS base")
def heritage(spark, sf_dir):
    return _extracted(spark, "heritage").select("path", "name", F.col("detail").alias("base"))


@query("SELECT 'sample.py' AS path, 'user' AS name, 'self' AS receiver")
def assignments(spark, sf_dir):
    return _extracted(spark, "assignment").select("path", "name", F.col("detail").alias("receiver"))


@query(f"SELECT * FROM (VALUES {values([('raw', 'explicit', 'User'), ('build', 'return', 'User'), ('repo', 'constructor', 'Repository')])}) t(var, tier, type)")
def types(spark, sf_dir):
    return _extracted(spark, "type").select(F.col("name").alias("var"), F.col("label").alias("tier"), F.col("detail").alias("type"))


@query("SELECT 'Service' AS name, 'Builds users for the whole test.' AS content, 3 AS line")
def docstrings(spark, sf_dir):
    return _extracted(spark, "docstring").select("name", F.col("detail").alias("content"), F.col("line").cast("int").alias("line"))


@query("SELECT 'Class:sample.py:Service_has_method_Method:sample.py:build' AS id, 'Class:sample.py:Service' AS source_id, 'Method:sample.py:build' AS target_id, 'HAS_METHOD' AS type")
def owner_edges(spark, sf_dir):
    found = extract.extracted(inline(spark, SOURCES, "path string, content string"))
    return extract.owner_edges(extract.symbols(found))


# Extraction over a source for every part


def _part_rows(spark, sf_dir):
    return extract.extracted(P.part_sources(spark, sf_dir))


@query(P.DEFINITIONS)
def part_definitions(spark, sf_dir):
    found = extract.symbols(_part_rows(spark, sf_dir))
    return found.select("path", "name", "label", "owner_id", F.col("line").cast("int").alias("line"), F.col("end_line").cast("int").alias("end_line"), "exported")


@query(P.IMPORTS)
def part_imports(spark, sf_dir):
    return _part_rows(spark, sf_dir).filter("kind = 'import'").select("path", "name", "detail")


@query(P.CALLS)
def part_calls(spark, sf_dir):
    found = extract.enclosing(_part_rows(spark, sf_dir))
    return found.select("path", "name", F.col("label").alias("form"), F.col("detail").alias("receiver"), F.col("extra").alias("args"), "source_id")


@query(P.HERITAGE)
def part_heritage(spark, sf_dir):
    return _part_rows(spark, sf_dir).filter("kind = 'heritage'").select("path", "name", F.col("detail").alias("base"))


@query(P.ASSIGNMENTS)
def part_assignments(spark, sf_dir):
    return _part_rows(spark, sf_dir).filter("kind = 'assignment'").select("path", "name", F.col("detail").alias("receiver"), "scope")


@query(P.TYPES)
def part_types(spark, sf_dir):
    return _part_rows(spark, sf_dir).filter("kind = 'type'").select("path", F.col("name").alias("var"), F.col("label").alias("tier"), F.col("detail").alias("type"))


@query(P.SELF_TYPES)
def part_self_types(spark, sf_dir):
    return extract.self_types(_part_rows(spark, sf_dir)).groupBy("path", "type").agg(F.count("*").cast("int").alias("n"))


@query(P.NODES)
def part_graph_nodes(spark, sf_dir):
    nodes = extract.source_graph(_part_rows(spark, sf_dir), P.part_sources(spark, sf_dir))[0]
    return nodes.select("id", "label", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


@query(P.EDGES)
def part_graph_edges(spark, sf_dir):
    return extract.source_graph(_part_rows(spark, sf_dir), P.part_sources(spark, sf_dir))[1].select("source_id", "target_id", "type")


@query(P.RESOLVED)
def part_calls_resolved(spark, sf_dir):
    """A source is many times its part's size on disk, so tasks go by rows; each source is parsed once."""
    parts = P.part_sources(spark, sf_dir)
    rows = cut(extract.extracted(parts.repartition(1 + parts.count() // 10_000)))
    reach = inline(spark, [], "from_file string, target string")
    return Q.resolved_calls(extract.enclosing(rows), extract.symbols(rows), reach).select("path", "source_id", "target_id", "confidence")


@query(P.NODES.replace("AS path FROM part", "AS path FROM part WHERE p_partkey % 11 <> 0"))
def part_graph_rebuilt(spark, sf_dir):
    """The graph of parts but every 13th, brought to that of parts but every 11th, every 7th having changed."""
    sources = P.part_sources(spark, sf_dir)
    key = F.regexp_extract("path", "([0-9]+)[.]py$", 1).cast("long")
    now, then = sources.filter(key % 11 != 0), sources.filter(key % 13 != 0)
    then = then.withColumn("content", F.when(key % 7 == 0, F.replace("content", F.lit("def _free"), F.lit("def _old"))).otherwise(F.col("content")))
    nodes, edges = extract.source_graph(extract.extracted(then), then)
    cached = then.select("path", F.sha2("content", 256).alias("hash"))
    nodes = R.rebuild(nodes, edges, now, cached)[0]
    return nodes.select("id", "label", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


@query(P.PATTERN_ROWS)
def part_pattern_rows(spark, sf_dir):
    """Sources in the eight languages that go by fixed patterns, for every part."""
    return extract.extracted(P.pattern_sources(spark, sf_dir)).select("path", "kind", "name", "label", F.col("line").cast("int").alias("line"))


@query(P.JAVA_ROWS)
def part_java_rows(spark, sf_dir):
    return extract.extracted(P.java_sources(spark, sf_dir)).select("path", "kind", "name", F.col("line").cast("int").alias("line"))


@query(P.JAVA_BINDINGS)
def part_java_bindings(spark, sf_dir):
    return extract.extracted(P.java_sources(spark, sf_dir)).filter("kind = 'import'").select("path", "detail")


@query(P.JAVA_SYMBOLS)
def part_java_symbols(spark, sf_dir):
    return extract.symbols(extract.extracted(P.java_sources(spark, sf_dir))).select("node_id", "exported")


# Streaming shapes, as batches


@query("WITH e AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL 30 minute)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, run")
def user_sessions(spark, sf_dir):
    out = changes.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    out = changes.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
