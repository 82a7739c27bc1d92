import numpy as np
from pyspark.sql import functions as F

from quarryloom.functions import tables
from quarryloom.operators import graph, search
from quarryloom.sources import extract, files, store
from quarryloom.streaming import changes


def test_scan_and_text(spark, tmp_path):
    for name, data in {"src/app.py": b"x = 1\n", "README.md": b"# r", ".gitignore": b"ignored.txt\n", "ignored.txt": b"no", ".hid/a.py": b"1", "data/b.py": b"1", "bin.dat": b"a\x00b", "bad.txt": b"a\xffb"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, str(tmp_path), ["ignored.txt"])
    assert sorted(r["path"] for r in found.select("path").collect()) == [".gitignore", "README.md", "bad.txt", "bin.dat", "src/app.py"]
    read = {r["path"]: r["content"] for r in files.texts(found).collect()}
    assert read["bad.txt"] == "a�b" and "bin.dat" not in read


def test_store_and_rejects(spark, tmp_path):
    nodes = spark.createDataFrame([("File:a", "File", "a", "x,1"), ("Function:a:f", "Function", "f", 'say "hi"'), ("Impl:a:i", "Impl", "i", None)], "id string, label string, name string, content string")
    edges = spark.createDataFrame([("1", "File:a", "Function:a:f", "CONTAINS"), ("2", "Impl:a:i", "File:a", "USES"), ("3", "File:a", "nothing", "CONTAINS")], "id string, source_id string, target_id string, type string")
    assert store.load_graph(nodes, edges, str(tmp_path / "g")) == {"nodes": 3, "edges": 1, "rejected": 2, "failed": {}, "lost": 0}
    store.write_csv(nodes, str(tmp_path / "csv"), ["id", "name", "content"])
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()}
    assert lines == {'File:a,a,"x,1"', 'Function:a:f,f,"say ""hi"""', "Impl:a:i,i,"}


def test_configs(spark):
    row = spark.createDataFrame([('{"compilerOptions": {"paths": {"@/*": ["src/*", "x"]}}} // c', "module a/b\n", '{"autoload": {"psr-4": {"A": "src/", "B": ["b/", "c/"]}}, "autoload-dev": {"psr-4": {"A": "dev/"}}}')], "ts string, go string, php string")
    got = row.select(files.tsconfig_aliases(F.col("ts")), files.go_module(F.col("go")), files.psr4(F.col("php"))).first()
    assert got[0] == {"@/": "src/"} and got[1] == "a/b" and got[2] == {"A": "dev", "B": "b"}


def test_registered_language(spark):
    extract.register("zed", extract.PatternLanguage([("thing", r"^thing (?P<name>\w+)", extract.M)]))
    assert extract.by_patterns("x\nthing a\n", extract.LANGUAGES.pop("zed")) == [("definition", "a", "thing", None, 1, 1, "thing a", None, None)]
    assert extract.python_rows("def (") == [("skipped", None, None, None, 0, 0, "syntax error", None, None)]


def test_vectors_ties_and_odd_rows(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [1.0]), (5, None)], "id long, embedding array<double>")
    assert [(r["id"], round(r["distance"], 6)) for r in search.nearest(rows, [1.0, 0.0], 5).collect()] == [(1, 0.0), (3, 0.0), (2, 1.0)]


def test_hops_on_a_ring(spark):
    edges = spark.createDataFrame([(str(i), str((i + 1) % 12)) for i in range(12)], "source_id string, target_id string")
    got = {r["id"]: r["hop"] for r in search.hops(edges, spark.createDataFrame([("0",)], "id string"), 20).collect()}
    assert got == {str(i): i for i in range(12)}


def test_first_wins_is_stable(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, f"v{i}") for i, k in enumerate(rng.integers(0, 5, 200))]
    got = graph.first_wins(spark.createDataFrame(rows, "id long, seq long, v string"), "id", ["seq"]).collect()
    first = {}
    for k, i, v in rows:
        first.setdefault(k, (i, v))
    assert {r["id"]: (r["seq"], r["v"]) for r in got} == first


def test_stream_applies_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows.write.parquet(str(source))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    for _ in range(2):
        changes.on_changes(stream, lambda b, n: seen.extend(r["v"] for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_calls_of_built_in_names_are_left_out(spark):
    code = "def print():\n    pass\n\ndef f(x):\n    print(len(x))\n    Print(x)\n    return build(x)\n"
    found = extract.extracted(spark.createDataFrame([("a.py", code)], "path string, content string"))
    assert sorted(r["name"] for r in found.filter("kind = 'call'").collect()) == ["Print", "build"]
    assert sorted(r["name"] for r in found.filter("kind = 'definition'").collect()) == ["f", "print"]
    assert len(tables.BUILTIN_CALLS) == 336
