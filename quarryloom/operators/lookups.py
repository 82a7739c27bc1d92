"""Symbol lookups, delta between snapshots, import resolution joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_path
from ..functions.tables import RESOLVE_SUFFIXES, SEARCH_ORDER
from .graph import first_wins

CALLABLE = ["Function", "Method", "Constructor"]


class Symbols:
    """Views over symbols (seq, file_path, name, node_id, type, owner_id)."""

    def __init__(self, symbols: DataFrame):
        self.rows = symbols

    def exact(self) -> DataFrame:
        """The first definition of each (file, name)."""
        keyed = self.rows.withColumn("_key", F.struct("file_path", "name"))
        return first_wins(keyed, "_key", ["seq"]).drop("_key")

    def exact_all(self, file_path: str, name: str) -> DataFrame:
        return self.rows.filter((F.col("file_path") == file_path) & (F.col("name") == name))

    def named(self, name: str) -> DataFrame:
        """All definitions of that exact name, properties aside."""
        return self.rows.filter((F.col("name") == name) & (F.col("type") != "Property"))

    def callables(self, name: str) -> DataFrame:
        return self.rows.filter((F.col("name") == name) & F.col("type").isin(CALLABLE))

    def fields(self) -> DataFrame:
        """The first property, method or constructor of each (owner, name)."""
        owned = self.rows.filter(F.col("owner_id").isNotNull() & F.col("type").isin("Property", "Method", "Constructor"))
        return first_wins(owned.withColumn("_key", F.struct("owner_id", "name")), "_key", ["seq"]).drop("_key")

    def stats(self) -> DataFrame:
        named = F.when(F.col("type") != "Property", F.col("name"))
        return self.rows.agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"), F.countDistinct(named).alias("global_names"))

    def match(self, column: str, value: str, limit: int, rank: Column | None = None) -> DataFrame:
        """The first rows of a name or file, by their labels' place in the search order (or a rank of one's own), then id."""
        rank = F.array_position(F.array(*[F.lit(x) for x in SEARCH_ORDER]), F.col("type")) if rank is None else rank
        return self.rows.filter(F.col("type").isin(SEARCH_ORDER) & (F.col(column) == value)).withColumn("rank", rank).orderBy("rank", "node_id", "seq").limit(limit)


def delta(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, status) of current against cached (path, hash): new, modified, unchanged, deleted. A null current hash is an unreadable file: new."""
    now, then = current.select("path", F.col("hash").alias("now"), F.lit(True).alias("here")), cached.select("path", F.col("hash").alias("then"), F.lit(True).alias("there"))
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull() | F.col("now").isNull(), "new").when(F.col("now") == F.col("then"), "unchanged").otherwise("modified")
    return now.join(then, "path", "full_outer").select("path", status.alias("status"))


def rebuilt(old: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Incremental rebuild: old rows of unchanged paths, fresh rows of new and modified ones."""
    keep = changes.filter("status = 'unchanged'").select("path")
    take = changes.filter("status IN ('new', 'modified')").select("path")
    return old.join(keep, "path", "left_semi").unionByName(fresh.join(take, "path", "left_semi"))


def resolved_exact(imports: DataFrame, files: DataFrame, suffixes=RESOLVE_SUFFIXES) -> DataFrame:
    """(from_file, raw_path, target): the file that the earliest suffix finds; imports without one are left out."""
    tries = imports.select("from_file", "raw_path", F.posexplode(F.array(*[F.concat(normal_path(F.col("raw_path")), F.lit(s)) for s in suffixes])).alias("rank", "path"))
    found = tries.join(files.select("path").distinct(), "path")
    return found.groupBy("from_file", "raw_path").agg(F.min_by("path", "rank").alias("target"))


def suffix_index(files: DataFrame, lower: bool = False) -> DataFrame:
    """(suffix, path): every trailing part of every path, also without the file's extension."""
    path = F.lower("path") if lower else F.col("path")
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    bare = F.transform(tails, lambda t: F.regexp_replace(t, r"\.[^./]+$", ""))
    return files.select(F.explode(F.array_distinct(F.concat(tails, bare))).alias("suffix"), "path")


def unique_suffixes(index: DataFrame) -> DataFrame:
    """(suffix, path) of suffixes that one path alone has."""
    return index.groupBy("suffix").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).filter("n = 1").select("suffix", "path")


def with_suffix(index: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(suffix, path): every path of each of the given trailing parts."""
    return index.join(suffixes.select("suffix").distinct(), "suffix")


def in_folder(folders: DataFrame, files: DataFrame, extension: str = "") -> DataFrame:
    """(folder, path): the files right inside each folder that end in ``extension``, found by any trailing part of a folder's path."""
    own = files.filter(F.col("path").endswith(extension)).select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"))
    parts = F.split("folder", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return own.select("path", F.explode(tails).alias("folder")).join(folders, "folder").select("folder", "path").distinct()


def longest_prefix(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, prefix, target): the longest rule prefix of each path that ends at its end or before ``/`` or ``.``.

    An equi-join on the path's own prefixes, so rules may be many.
    """
    ends = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: (i == F.length("path")) | F.substring(F.col("path"), i + 1, F.lit(1)).isin("/", "."))
    prefixes = paths.select("path", F.explode(F.transform(ends, lambda i: F.substring(F.col("path"), F.lit(1), i))).alias("prefix"))
    found = prefixes.join(rules, "prefix")
    return found.groupBy("path").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("r")).select("path", "r.prefix", "r.target")


TIERS = ["explicit", "constructor", "seeded", "return"]


def receiver_types(bindings: DataFrame) -> DataFrame:
    """(path, var, type): the last non-empty binding of the best tier."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    some = bindings.filter("type IS NOT NULL AND type <> ''")
    return some.groupBy("path", "var").agg(F.min_by("type", F.struct(rank.alias("rank"), (-F.col("seq")).alias("last"))).alias("type"))


def upserted(registry: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return registry.join(new.select(key), key, "left_anti").unionByName(new)


def newest(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(F.lower("name") == name.lower()).orderBy(F.desc("indexed_at"), "path").limit(1)


def sample(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n file paths in order, and the first n edges by id."""
    paths = nodes.filter("label = 'File'").select("file_path").orderBy("file_path").limit(n)
    return paths, edges.orderBy("id").limit(n)
