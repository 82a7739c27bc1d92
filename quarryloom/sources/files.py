"""Files as tables: scan, ignore rules, text, chunks, configuration files."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_binary_content
from ..functions.tables import CHUNK_BYTES, IGNORED, MAX_FILE_BYTES
from ..operators.imports import Configs

#: Names of the first configuration file that has aliases, and folders whose folders are package targets.
TSCONFIGS = ["tsconfig.json", "tsconfig.app.json", "tsconfig.base.json"]
SWIFT_FOLDERS = ["Sources", "Package/Sources", "src"]


def ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """(negated, regex on a relative path) of one line of an ignore file; None for blanks and comments."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].removeprefix("\\")
    folder_only = line.endswith("/")
    anchored = "/" in line.rstrip("/")
    body, i, line = "", 0, line.strip("/")
    while i < len(line):
        if line.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            body, i = body + "/.*", i + 3
        elif line[i] == "*":
            stars = len(line) - i - len(line[i:].lstrip("*"))
            body, i = body + ("[^/]*" if stars == 1 else ".*"), i + stars
        elif line[i] == "?":
            body, i = body + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            body, i = body + "[" + line[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            body, i = body + re.escape(line[i]), i + 1
    return negated, ("^" if anchored else "(?:^|/)") + body + ("/" if folder_only else "(?:/|$)")


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path ignores it."""
    out = F.lit(False)
    for p in [f"{name}/" for name in IGNORED] + list(patterns):
        if rule := ignore_regex(p):
            out = F.when(path.rlike(rule[1]), F.lit(not rule[0])).otherwise(out)
    return out


def _hidden(spark: SparkSession, root: str, most: int, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, length, content) of files that Spark's readers pass over: below ``root`` under a name that begins with ``.`` or ``_``, or empty.

    The driver lists them (paths and sizes); tasks read those that ``wanted`` leaves, a file at a time.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    walk = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    found, base = [], root.split("://")[-1].rstrip("/") + "/"
    while walk.hasNext():
        status = walk.next()
        path, size = status.getPath().toString(), status.getLen()
        if size <= most and (size == 0 or re.search(r"(?:^|/)[._]", path.split(base, 1)[-1])):
            found.append((path, size))
    listed = wanted(spark.createDataFrame(found, "path string, length long"))

    def read(batches):
        for b in batches:
            for path, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, at = pa_fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with store.open_input_stream(at) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([f.read()], pa.binary())], ["path", "length", "content"])

    return listed.select("path", "length").mapInArrow(read, "path string, length long, content binary")


def scan(spark: SparkSession, root: str, patterns: list[str] = (), exclude_folders: list[str] = (), most: int = MAX_FILE_BYTES, hidden: bool = True) -> DataFrame:
    """(path, size, content) below ``root``: relative paths, without ignored files, dot-folders, excluded folder names and files beyond ``most`` bytes.

    With ``hidden``, also empty files and those under names that begin with ``.`` or ``_``; without, what
    Spark's readers list, of which path and size can be selected without a content being read.
    """
    base = root.split("://")[-1].rstrip("/")

    def wanted(files: DataFrame) -> DataFrame:
        path = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
        keep = ~path.rlike(r"(?:^|/)\.[^/]+/") & ~is_ignored(path, list(patterns))
        for name in exclude_folders:
            keep = keep & ~F.concat(F.lit("/"), path).contains(f"/{name}/")
        return files.withColumn("_path", path).filter(keep & (F.col("length") <= most))

    files = wanted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "content"))
    if hidden:
        files = files.unionByName(wanted(_hidden(spark, root, most, wanted)))
    return files.select(F.col("_path").alias("path"), F.col("length").alias("size"), "content")


def texts(files: DataFrame) -> DataFrame:
    """(path, content): the text of files that aren't binary, bytes that aren't UTF-8 replaced."""
    return files.filter(~is_binary_content(F.col("content"))).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def chunk_numbers(files: DataFrame, budget: int = CHUNK_BYTES, group: str | None = None) -> DataFrame:
    """Adds ``chunk`` to files (seq, size): filled in order up to ``budget`` bytes; a larger file is alone.

    The sum starts anew with each chunk, so a ``group`` (say, a repository) is
    walked in order, in one task, with a state of fixed size. Without a group that is one walk over
    (seq, size) of all, which more machines don't shorten.
    """
    rows = files.select(*([F.col(group).alias("group")] if group else [F.lit(0).alias("group")]), F.col("seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size"))
    kind = rows.schema["group"].dataType.simpleString()
    rows = (rows.repartition("group") if group else rows.coalesce(1)).sortWithinPartitions("group", "seq")

    def walk(batches):
        now, total, chunk = object(), 0, 0
        for b in batches:
            out = []
            for of, size in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if of != now:
                    now, total, chunk = of, 0, 0
                if total > 0 and total + size > budget:
                    total, chunk = 0, chunk + 1
                total += size
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["group", "seq", "chunk"])

    walked = rows.mapInArrow(walk, f"group {kind}, seq long, chunk long")
    return files.join(walked.withColumnRenamed("group", group), ["seq", group]) if group else files.join(walked.drop("group"), "seq")


def tsconfig_aliases(content: Column) -> Column:
    """map<alias, first target> of a tsconfig's paths, comments stripped, trailing ``*`` dropped; null if it can't be read."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?m)//.*$", ""), r"(?s)/\*.*?\*/", "")
    paths = F.from_json(bare, "compilerOptions struct<paths: map<string, array<string>>>")["compilerOptions"]["paths"]
    entries = F.transform(F.map_entries(paths), lambda e: F.struct(F.regexp_replace(e["key"], r"\*$", ""), F.regexp_replace(e["value"][0], r"\*$", "")))
    return F.when(F.size(paths) > 0, F.map_from_entries(entries))


def go_module(content: Column) -> Column:
    found = F.regexp_extract(content, r"(?m)^module\s+(\S+)", 1)
    return F.when(found != "", found)


def psr4(content: Column) -> Column:
    """map<namespace, folder> of composer.json: autoload, then autoload-dev; of a list, the first folder."""
    kind = "struct<`psr-4`: map<string, string>>"
    told = F.from_json(content, f"autoload {kind}, `autoload-dev` {kind}")
    first = lambda m: F.transform_values(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda _, v: F.rtrim(F.coalesce(F.get(F.from_json(v, "array<string>"), F.lit(0)), v), F.lit("/")))
    own, dev = first(told["autoload"]["psr-4"]), first(told["autoload-dev"]["psr-4"])
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(dev, k)), dev)


def root_namespace(path: Column, content: Column) -> Column:
    found = F.regexp_extract(content, r"<RootNamespace>\s*([^<\s]+)\s*</RootNamespace>", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1))


def changed_in_git(spark: SparkSession, root: str, scope: str = "all", base: str = "HEAD~1") -> DataFrame:
    """(path) that git lists as changed: ``unstaged``, ``staged``, ``compare`` with a base, or ``all``; empty where git fails. Runs on the driver."""
    more = {"unstaged": [], "staged": ["--cached"], "compare": [base], "all": ["HEAD"]}[scope]
    try:
        done = subprocess.run(["git", "-C", root, "diff", "--name-only", *more], capture_output=True, text=True, timeout=30, check=True)
        names = [x for x in done.stdout.splitlines() if x]
    except (OSError, subprocess.SubprocessError):
        names = []
    return spark.createDataFrame([(n,) for n in names], "path string")


def swift_targets(paths: DataFrame) -> DataFrame:
    """(name, folder) of the package targets that scanned paths (path) show: a folder right below one of the source folders; of equal names the last source folder's."""
    found = None
    for rank, top in enumerate(SWIFT_FOLDERS):
        name = F.regexp_extract("path", f"^{top}/([^/]+)/", 1)
        own = paths.select(name.alias("name"), F.concat(F.lit(f"{top}/"), name).alias("folder"), F.lit(rank).alias("rank")).filter("name <> ''")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("name").agg(F.max_by("folder", "rank").alias("folder"))


def load_configs(files: DataFrame) -> Configs:
    """What the configuration files of a scan (path, content) say. Only they are read; what can't be read says nothing."""
    depth = F.size(F.split("path", "/")) - 1
    wanted = F.col("path").isin([*TSCONFIGS, "go.mod", "composer.json"]) | (F.col("path").endswith(".csproj") & (depth <= 6))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    told = files.filter(wanted).select("path", tsconfig_aliases(text).alias("aliases"), go_module(text).alias("go"), psr4(text).alias("psr4"), root_namespace(F.col("path"), text).alias("space"))
    rows = {r["path"]: r for r in told.orderBy("path").collect()}  # a repository's few configuration files
    aliases = next((rows[n]["aliases"] for n in TSCONFIGS if n in rows and rows[n]["aliases"]), {})
    spaces = [(r["space"], p.rpartition("/")[0] or ".") for p, r in rows.items() if p.endswith(".csproj")]
    targets = {r["name"]: r["folder"] for r in swift_targets(files.select("path")).collect()}
    of = lambda name, column: rows[name][column] if name in rows else None
    return Configs(aliases, of("go.mod", "go"), of("composer.json", "psr4") or {}, spaces, targets)


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, hash): SHA-256 of each file's bytes."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def git_state(root: str) -> dict:
    """Whether ``root`` is in a git work tree, that tree's top folder and its current commit; None where git can't say. Runs on the driver."""

    def ask(*words: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=30, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    return {"is_repo": ask("rev-parse", "--is-inside-work-tree") == "true", "root": ask("rev-parse", "--show-toplevel"), "head": ask("rev-parse", "HEAD")}
