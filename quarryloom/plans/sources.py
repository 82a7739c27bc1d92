"""A Python source for every part of the test tables, and what extraction has to find in it, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import table

TEMPLATE = '''import os
from pkg%S.mod import Thing%S as T%K

class C%K(Base%S):
    """Keeps what part %K needs to know."""

    def run%K(self, raw: Raw%S) -> Out%S:
        self.part%K = Made%S(raw)
        self.step%K(raw)
        return super().run%K(raw)

def _free%K(x):
    obj%K = C%K()
    return obj%K.run%K(x)
'''


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): ``part/<key>.py`` for every part."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    content = F.replace(F.replace(F.lit(TEMPLATE), F.lit("%K"), key), F.lit("%S"), size)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), key, F.lit(".py")).alias("path"), content.alias("content"))


JAVA = """import a.b.Thing%S;
public class C%K {
  // int no(int x) { }
  private int run%K(int x) {
    return make%S(x);
  }
}
"""


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): ``part/<key>.java`` for every part."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    content = F.replace(F.replace(F.lit(JAVA), F.lit("%K"), key), F.lit("%S"), size)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), key, F.lit(".java")).alias("path"), content.alias("content"))


P = "p AS (SELECT p_partkey AS k, p_size AS s, 'part/' || p_partkey || '.py' AS path FROM part)"


def each(*rows: str) -> str:
    """SQL: the given select lists for every part, one after the other."""
    return f"WITH {P} " + " UNION ALL ".join(f"SELECT {r} FROM p" for r in rows)


DEFINITIONS = each(
    "path, 'C' || k AS name, 'Class' AS label, NULL AS owner_id, 3 AS line, 9 AS end_line, true AS exported",
    "path, 'run' || k, 'Method', 'Class:' || path || ':C' || k, 6, 9, true",
    "path, '_free' || k, 'Function', NULL, 11, 13, false",
)
IMPORTS = each("path, 'os' AS name, 'os' AS detail", "path, 'pkg' || s || '.mod', 'T' || k || '=Thing' || s")
CALLS = each(
    "path, 'Made' || s AS name, 'constructor' AS form, NULL AS receiver, '1' AS args, 'Method:' || path || ':run' || k AS source_id",
    "path, 'step' || k, 'member', 'self', '1', 'Method:' || path || ':run' || k",
    "path, 'run' || k, 'member', 'super()', '1', 'Method:' || path || ':run' || k",
    "path, 'C' || k, 'constructor', NULL, '0', 'Function:' || path || ':_free' || k",
    "path, 'run' || k, 'member', 'obj' || k, '1', 'Function:' || path || ':_free' || k",
)
HERITAGE = each("path, 'C' || k AS name, 'Base' || s AS base")
ASSIGNMENTS = each("path, 'part' || k AS name, 'self' AS receiver, 'C' || k AS scope")
TYPES = each("path, 'raw' AS var, 'explicit' AS tier, 'Raw' || s AS type", "path, 'run' || k, 'return', 'Out' || s", "path, 'obj' || k, 'constructor', 'C' || k")
SELF_TYPES = each("path, 'C' || k AS type, 2 AS n", "path, 'Base' || s, 1")
NODES = each(
    "'Class:' || path || ':C' || k AS id, 'Class' AS label, 4 AS start_line, 10 AS end_line",
    "'Method:' || path || ':run' || k, 'Method', 7, 10",
    "'Function:' || path || ':_free' || k, 'Function', 12, 14",
    "'Section:' || path || ':L4:C' || k || ':docstring', 'Section', 5, 5",
)
EDGES = each(
    "'File:' || path AS source_id, 'Class:' || path || ':C' || k AS target_id, 'CONTAINS' AS type",
    "'File:' || path, 'Method:' || path || ':run' || k, 'CONTAINS'",
    "'File:' || path, 'Function:' || path || ':_free' || k, 'CONTAINS'",
    "'Class:' || path || ':C' || k, 'Method:' || path || ':run' || k, 'HAS_METHOD'",
    "'Section:' || path || ':L4:C' || k || ':docstring', 'Class:' || path || ':C' || k, 'DESCRIBES'",
)
RESOLVED = each(
    "path, 'Method:' || path || ':run' || k AS source_id, 'Method:' || path || ':run' || k AS target_id, 1.0::DOUBLE AS confidence",
    "path, 'Function:' || path || ':_free' || k, 'Class:' || path || ':C' || k, 1.0",
    "path, 'Function:' || path || ':_free' || k, 'Method:' || path || ':run' || k, 1.0",
)
JAVA_ROWS = each(
    "replace(path, '.py', '.java') AS path, 'import' AS kind, 'a.b.Thing' || s AS name, 0 AS line",
    "replace(path, '.py', '.java'), 'definition', 'C' || k, 1",
    "replace(path, '.py', '.java'), 'definition', 'run' || k, 3",
    "replace(path, '.py', '.java'), 'call', 'make' || s, 4",
)
JAVA_SYMBOLS = each("'Class:' || replace(path, '.py', '.java') || ':C' || k AS node_id, true AS exported", "'Method:' || replace(path, '.py', '.java') || ':run' || k, false")
JAVA_BINDINGS = each("replace(path, '.py', '.java') AS path, 'Thing' || s || '=Thing' || s AS detail")

#: Sources of languages that go by patterns, and the rows that each gives: kind, name, label, line.
PATTERNED = {
    "abap": ("REPORT z%K.\nFORM go%K.\n  PERFORM run%S.\nINCLUDE inc%S.\n", [("definition", "z%K", "report", 0), ("definition", "go%K", "form_definition", 1), ("call", "run%S", "call_expression", 2), ("import", "inc%S", "include_statement", 3)]),
    "alg": ("procedure p%K;\nbegin q%S (1) end\n", [("definition", "p%K", "procedure_declaration", 0), ("call", "q%S", "call_expression", 1)]),
    "asm": ("main%K:\n  call f%S\n.include \"m%S.inc\"\n", [("definition", "main%K", "function_definition", 0), ("call", "f%S", "call_expression", 1), ("import", "m%S.inc", "include_statement", 2)]),
    "forth": ("VARIABLE v%K\n: w%K 1 + ;\nREQUIRE lib%S\n", [("definition", "v%K", "variable_definition", 0), ("definition", "w%K", "word_definition", 1), ("import", "lib%S", "include_statement", 2)]),
    "mps": ("L%K ;\n DO SUB%S\n SET X=$$FN%S\n", [("definition", "L%K", "function_definition", 0), ("call", "SUB%S", "call_expression", 1), ("call", "FN%S", "call_expression", 2)]),
    "ps": ("/f%K { 1 add } bind def\n/v%S 3 def\n(a%S.ps) run\n", [("definition", "f%K", "procedure_def", 0), ("definition", "v%S", "variable_definition", 1), ("import", "a%S.ps", "include_statement", 2)]),
    "rpgle": ("DCL-PROC m%K;\nEXSR s%S;\n/COPY c%S\n", [("definition", "m%K", "dcl_proc", 0), ("call", "s%S", "call_expression", 1), ("import", "c%S", "include_statement", 2)]),
    "tcl": ("namespace eval n%K {\n}\nproc d%K {a} {\n}\npackage require T%S\n", [("definition", "n%K", "module", 0), ("definition", "d%K", "proc_definition", 2), ("import", "T%S", "include_statement", 4)]),
}


def pattern_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a source in every patterned language for every part."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    each_language = F.explode(F.array(*[F.struct(F.lit(ext).alias("ext"), F.lit(text).alias("text")) for ext, (text, _) in PATTERNED.items()]))
    rows = table(spark, sf_dir, "part").select(key.alias("key"), size.alias("size"), each_language.alias("s"))
    content = F.replace(F.replace(F.col("s.text"), F.lit("%K"), F.col("key")), F.lit("%S"), F.col("size"))
    return rows.select(F.concat(F.lit("part/"), "key", F.lit("."), "s.ext").alias("path"), content.alias("content"))


def _said(name: str) -> str:
    return "replace(replace('" + name + "', '%K', k::VARCHAR), '%S', s::VARCHAR)"


PATTERN_ROWS = each(*[f"replace(path, '.py', '.{ext}') AS path, '{kind}' AS kind, {_said(name)} AS name, '{label}' AS label, {line} AS line" for ext, (_, rows) in PATTERNED.items() for kind, name, label, line in rows])
