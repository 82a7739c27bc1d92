"""Import resolution by language: ordered candidates as column expressions, three equi-joins with the files.

Every import becomes a few candidates (rank, how, key): a path, a trailing part
of a path that one file alone has (letter case counting or not), the files right
inside a folder, or all below one. They meet tables of paths, of unique trailing
parts and of folders; the lowest rank that finds anything wins. Configurations
(aliases, module names, namespaces, targets) are parameters, a few entries each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_path
from ..functions.tables import RESOLVE_SUFFIXES
from .lookups import suffix_index, unique_suffixes

CANDIDATE = "array<struct<how:string,key:string,ext:string>>"


@dataclass(frozen=True)
class Configs:
    """What a repository's configuration files say; an empty value resolves nothing."""

    aliases: dict[str, str] = field(default_factory=dict)
    go_module: str | None = None
    psr4: dict[str, str] = field(default_factory=dict)
    namespaces: list[tuple[str, str]] = field(default_factory=list)
    swift_targets: dict[str, str] = field(default_factory=dict)


def _to(how: str, key: Column, ext: str = "") -> Column:
    return F.struct(F.lit(how).alias("how"), key.alias("key"), F.lit(ext).alias("ext"))


def _paths(*keys: Column) -> Column:
    return F.array(*[_to("path", k) for k in keys])


def _folder_of(path: Column) -> Column:
    """A file's folder with a slash behind, '' at the root."""
    return F.regexp_extract(path, r"^(.*/)?", 0)


def _up(folder: Column, levels: Column) -> Column:
    """A folder so many levels further up; null above the root."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    left = F.size(parts) - levels
    return F.when(left >= 0, F.concat_ws("", F.transform(F.slice(parts, F.lit(1), F.greatest(left, F.lit(0))), lambda p: F.concat(p, F.lit("/")))))


def _suffixes(raw: Column) -> Column:
    """The general way: a trailing part of one path alone, as it stands and with every known suffix."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), "^['\"]+|['\"]+$", ""), r"^[./]+", "")
    return F.array(*[_to("suffix", F.concat(plain, F.lit(s))) for s in RESOLVE_SUFFIXES])


def _python(raw: Column, here: Column) -> Column:
    dots = F.length(F.regexp_extract(raw, r"^(\.+)", 1))
    rest = F.replace(F.regexp_replace(raw, r"^\.+", ""), F.lit("."), F.lit("/"))
    base = F.concat(_up(_folder_of(here), dots - 1), rest)
    plain = F.regexp_replace(base, "/$", "")
    relative = _paths(F.concat(plain, F.lit("/__init__.py")), F.concat(plain, F.lit(".py")))
    beside = F.concat(_folder_of(here), raw)
    near = _paths(F.concat(beside, F.lit("/__init__.py")), F.concat(beside, F.lit(".py")))
    dotted = _paths(F.concat(rest, F.lit("/__init__.py")), F.concat(rest, F.lit(".py")))
    return F.when(dots > 0, relative).when(~raw.rlike(r"[./\\]"), near).when(raw.rlike(r"^[^/\\]*\.[^/\\]*$"), dotted).otherwise(F.array().cast(CANDIDATE))


def _jvm(raw: Column, extensions: list[str]) -> Column:
    parts = F.split(raw, r"\.")
    last = F.element_at(parts, -1)
    member = last.rlike(r"^\p{Ll}") | ((last == F.upper(last)) & last.rlike(r"\p{Lu}"))
    path = F.array_join(F.when(member, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts), "/")
    named = F.array(*[_to(how, F.concat(path, F.lit(e))) for e in extensions for how in ("suffix", "suffix_ci")])
    package = F.regexp_replace(F.replace(F.regexp_replace(raw, r"\.\*$", ""), F.lit("."), F.lit("/")), "^/+", "")
    folder = F.array(_to("folder", package, "|".join(extensions)))
    return F.when(raw.endswith(".*"), F.when(package != "", folder)).when(F.size(parts) > 1, named)


def _go(raw: Column, module: str | None) -> Column:
    rest = F.regexp_replace(F.substring(raw, len(module or "") + 1, 1 << 30), "^/", "")
    return F.when(raw.startswith(module) & (rest != ""), F.array(_to("folder", rest, ".go"))) if module else F.array().cast(CANDIDATE)


def _below(raw: Column, prefix: str, separator: str) -> Column:
    """What stands behind a namespace; null if ``raw`` isn't below it."""
    rest = F.substring(raw, len(prefix) + 1, 1 << 30)
    return F.when(raw.startswith(prefix) & ((rest == "") | rest.startswith(separator)), F.substring(rest, 2, 1 << 30))


def _csharp(raw: Column, namespaces: list[tuple[str, str]]) -> Column:
    out = F.array().cast(CANDIDATE)
    for root, folder in sorted(namespaces, key=lambda x: -len(x[0])):
        rest = F.replace(_below(raw, root, "."), F.lit("."), F.lit("/"))
        at = F.regexp_replace(F.concat(F.lit(folder.rstrip("/") + "/"), rest), "^/+|/+$", "")
        out = F.concat(out, F.when(rest.isNotNull(), F.array(_to("suffix", F.concat(at, F.lit(".cs"))), _to("folder", at, ".cs"))).otherwise(F.array().cast(CANDIDATE)))
    return out


def _php(raw: Column, psr4: dict[str, str]) -> Column:
    plain = F.replace(raw, F.lit("\\"), F.lit("/"))
    out = F.array().cast(CANDIDATE)
    for space, folder in sorted(psr4.items(), key=lambda x: -len(x[0])):
        rest = _below(plain, space.replace("\\", "/").rstrip("/"), "/")
        at = lambda r, folder=folder: F.regexp_replace(F.concat(F.lit(folder.rstrip("/") + "/"), r, F.lit(".php")), r"/\.php$", ".php")
        whole, parent = _to("path", at(rest)), _to("path", at(F.regexp_replace(rest, "/[^/]*$", "")))
        out = F.concat(out, F.when(rest.isNull() | plain.contains(".."), F.array().cast(CANDIDATE)).when(rest.contains("/"), F.array(whole, parent)).otherwise(F.array(whole)))
    return out


def _rust(raw: Column, here: Column) -> Column:
    path = F.replace(F.regexp_replace(F.regexp_extract(F.replace(raw, F.lit("\\"), F.lit("/")), r"^[^{]*", 0), ":+$", ""), F.lit("::"), F.lit("/"))
    rest = F.regexp_replace(path, "^(?:crate|super|self)/", "")
    folder = _folder_of(here)
    root = here.rlike("(?:^|/)(?:mod|lib)\\.rs$")
    above = F.coalesce(_up(folder, F.when(root, 2).otherwise(1)), F.lit(""))

    def tries(p: Column) -> Column:
        parent = F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", ""))
        return _paths(*[F.concat(p, F.lit(e)) for e in (".rs", "/mod.rs", "/lib.rs")], *[F.concat(parent, F.lit(e)) for e in (".rs", "/mod.rs")])

    return F.when(path.startswith("crate/"), F.concat(tries(F.concat(F.lit("src/"), rest)), tries(rest))).when(path.startswith("super/"), tries(F.concat(above, rest))).when(path.startswith("self/"), tries(F.concat(folder, rest))).otherwise(tries(path))


def _script(raw: Column, here: Column, aliases: dict[str, str]) -> Column:
    """Aliases by longest prefix, then the path as given or beside the importing file."""
    path = F.when(raw.startswith("."), normal_path(F.concat(_folder_of(here), raw))).otherwise(raw)
    for alias, target in sorted(aliases.items(), key=lambda x: len(x[0])):
        path = F.when(raw.startswith(alias), normal_path(F.concat(F.lit(target), F.substring(raw, len(alias) + 1, 1 << 30)))).otherwise(path)
    return _paths(*[F.concat(path, F.lit(s)) for s in RESOLVE_SUFFIXES])


def _swift(raw: Column, targets: dict[str, str]) -> Column:
    out = F.array().cast(CANDIDATE)
    for name, folder in targets.items():
        out = F.when(raw == name, F.array(_to("below", F.lit(folder.rstrip("/")), ".swift"))).otherwise(out)
    return out


def candidates(configs: Configs) -> Column:
    """The candidates of columns (language, raw_path, from_file), in order; nulls are none."""
    raw, here, language = F.col("raw_path"), F.col("from_file"), F.col("language")
    own = {
        "python": _python(raw, here),
        "java": _jvm(raw, [".java"]),
        "kotlin": _jvm(raw, [".kt", ".kts", ".java"]),
        "go": _go(raw, configs.go_module),
        "c_sharp": _csharp(raw, configs.namespaces),
        "php": _php(raw, configs.psr4),
        "rust": _rust(raw, here),
        "swift": _swift(raw, configs.swift_targets),
        "javascript": _script(raw, here, configs.aliases),
        "typescript": _script(raw, here, configs.aliases),
    }
    out = F.lit(None).cast(CANDIDATE)
    for name, found in own.items():
        out = F.when(language == name, found.cast(CANDIDATE)).otherwise(out)
    # a relative Python import and a wildcard have no other way
    general = F.when(((language == "python") & raw.startswith(".")) | raw.endswith(".*") | (language == "swift"), F.array().cast(CANDIDATE)).otherwise(_suffixes(raw))
    return F.concat(F.coalesce(out, F.array().cast(CANDIDATE)), general)


def resolved(imports: DataFrame, files: DataFrame, configs: Configs | None = None) -> DataFrame:
    """(from_file, raw_path, target): the files that imports (language, from_file, raw_path) mean, of ``files`` (path); imports of nothing known are left out.

    Both sides of every join are sorted: Spark doesn't count what an explode adds, and would
    send tables many times the broadcast threshold through the driver.
    """
    paths = files.select("path").distinct()
    tries = imports.select("language", "from_file", "raw_path").distinct().select("from_file", "raw_path", F.posexplode(candidates(configs or Configs())).alias("rank", "c"))
    tries = tries.select("from_file", "raw_path", "rank", "c.how", "c.key", "c.ext").filter("key IS NOT NULL AND key <> ''")
    of = lambda *how: tries.filter(F.col("how").isin(*how)).hint("merge")
    by_path = of("path").join(paths.select("path", F.col("path").alias("key")), "key")
    by_suffix = of("suffix").join(unique_suffixes(suffix_index(paths)).select(F.col("suffix").alias("key"), "path"), "key")
    lower = paths.select(F.lower("path").alias("path"), F.col("path").alias("real"))
    either = unique_suffixes(suffix_index(lower)).hint("merge").join(lower.groupBy("path").agg(F.min("real").alias("real"), F.count("*").alias("n")).filter("n = 1"), "path")
    by_either = of("suffix_ci").withColumn("key", F.lower("key")).hint("merge").join(either.select(F.col("suffix").alias("key"), F.col("real").alias("path")), "key")
    folders = F.filter(F.split(_folder_of(F.col("path")), "/"), lambda p: p != "")
    n = F.size("parts")
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("parts", i, n), "/"))
    heads = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))
    inside = paths.select("path", folders.alias("parts")).filter(n > 0)
    fits = F.exists(F.split("ext", r"\|"), lambda e: F.col("path").endswith(e)) & ~((F.col("ext") == ".go") & F.col("path").endswith("_test.go"))
    by_folder = of("folder").join(inside.select("path", F.explode(F.array_distinct(tails)).alias("key")), "key").filter(fits)
    by_head = of("below").join(inside.select("path", F.explode(F.array_distinct(heads)).alias("key")), "key").filter(fits)
    found = by_path
    for more in (by_suffix, by_either, by_folder, by_head):
        found = found.unionByName(more)
    first = found.groupBy("from_file", "raw_path").agg(F.min("rank").alias("rank"))
    return found.hint("merge").join(first, ["from_file", "raw_path", "rank"]).select("from_file", "raw_path", F.col("path").alias("target")).distinct()
