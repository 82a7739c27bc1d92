"""Extraction from source text: definitions, calls, imports, heritage, assignments, types and docstrings.

Python files are parsed with the standard library, eight languages by patterns of
their own, fifteen more by approximate ones. ``register`` adds patterns or a parser, for instance one that walks a grammar that is
installed. All run as one Arrow pass over
(path, content) and give rows with a ``kind``; views select a kind.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_exported, language_of
from ..functions.tables import BUILTIN_CALLS, NODE_LABELS, NODE_TYPE_LABELS
from ..operators.graph import first_wins
from .patterns import OWN, bindings

COLUMNS = ["kind", "name", "label", "owner", "line", "end_line", "detail", "extra", "scope"]
SCHEMA = "path string, language string, seq long, kind string, name string, label string, owner string, line long, end_line long, detail string, extra string, scope string"


@dataclass(frozen=True)
class PatternLanguage:
    """Patterns with a group ``name``, each with its flags: definitions by node type, calls, imports.

    ``continuation`` is the character that, at a line's end, joins it to the next
    one. ``comments`` is what is blanked first; without it comments are read too. A call
    whose name is a definition's isn't one.
    """

    definitions: list[tuple[str, str, int]] = field(default_factory=list)
    calls: list[tuple[str, int]] = field(default_factory=list)
    imports: list[tuple[str, int]] = field(default_factory=list)
    continuation: str | None = None
    comments: str | None = None


I, M = re.IGNORECASE, re.MULTILINE
#: What each language's declarations, calls and inclusions look like.
LANGUAGES = {
    "abap": PatternLanguage(
        definitions=[
            ("form_definition", r"^\s*FORM\s+(?P<name>\w+)", I | M),
            ("method_definition", r"^\s*METHOD\s+(?P<name>\w+)", I | M),
            ("class_definition", r"^\s*CLASS\s+(?P<name>\w+)\s+(?:DEFINITION|IMPLEMENTATION)", I | M),
            ("function_definition", r"^\s*FUNCTION\s+(?P<name>\S+)", I | M),
            ("report", r"^\s*REPORT\s+(?P<name>\w+)", I | M),
        ],
        calls=[
            (r"\bCALL\s+FUNCTION\s+'(?P<name>[^']+)'", I),
            (r"\bCALL\s+METHOD\s+(?:\w+->)?(?P<name>\w+)", I),
            (r"\bPERFORM\s+(?P<name>\w+)", I),
        ],
        imports=[(r"^\s*INCLUDE\s+(?P<name>\w+)", I | M)],
    ),
    "algol": PatternLanguage(
        definitions=[("procedure_declaration", r"\b(?:procedure|PROCEDURE)\s+(?P<name>[A-Za-z_][A-Za-z0-9_]*)", M)],
        calls=[(r"\b(?P<name>[A-Za-z_][A-Za-z0-9_]*)\s*\(", 0)],
    ),
    "assembly": PatternLanguage(
        definitions=[("function_definition", r"^(?P<name>[A-Za-z_.][A-Za-z0-9_.]*):", M)],
        calls=[
            (r"\b(?:call|CALL)\s+(?P<name>[A-Za-z_.][A-Za-z0-9_.]*)", I),
            (r"\bbl\s+(?P<name>[A-Za-z_.][A-Za-z0-9_.]*)", I),
            (r"\bjsr\s+(?P<name>[A-Za-z_.][A-Za-z0-9_.]*)", I),
        ],
        imports=[(r'^\s*[.%]include\s+"(?P<name>[^"]+)"', I | M)],
    ),
    "forth": PatternLanguage(
        definitions=[
            ("word_definition", r":\s+(?P<name>\S+)", M),
            ("variable_definition", r"\b(?:VARIABLE|CONSTANT|CREATE|VALUE|2VARIABLE|2CONSTANT)\s+(?P<name>\S+)", I),
        ],
        imports=[(r"^\s*(?:INCLUDE|REQUIRE)\s+(?P<name>\S+)", I | M)],
    ),
    "mumps": PatternLanguage(
        definitions=[("function_definition", r"^(?P<name>[A-Za-z%][A-Za-z0-9]*)(?:\([^)]*\))?\s", M)],
        calls=[
            (r"\b(?:DO|D)\s+(?P<name>[A-Za-z%][A-Za-z0-9]*)(?:\^[A-Za-z%][A-Za-z0-9]*)?", I),
            (r"\$\$(?P<name>[A-Za-z%][A-Za-z0-9]*)(?:\^[A-Za-z%][A-Za-z0-9]*)?", 0),
        ],
    ),
    "postscript": PatternLanguage(
        definitions=[
            ("procedure_def", r"/(?P<name>[A-Za-z_][A-Za-z0-9_]*)\s*\{[^}]*\}\s*(?:bind\s+)?def\b", 0),
            ("variable_definition", r"/(?P<name>[A-Za-z_][A-Za-z0-9_]*)\s+(?!\{)\S+\s+def\b", 0),
        ],
        imports=[(r"\((?P<name>[^)]+)\)\s+run\b", 0)],
    ),
    "rpg": PatternLanguage(
        definitions=[
            ("dcl_proc", r"^\s*DCL-PROC\s+(?P<name>\w+)", I | M),
            ("dcl_ds", r"^\s*DCL-DS\s+(?P<name>\w+)", I | M),
            ("begsr", r"^\s*BEGSR\s+(?P<name>\w+)", I | M),
        ],
        calls=[(r"\bCALLP\s+(?P<name>\w+)\s*\(", I), (r"\bEXSR\s+(?P<name>\w+)", I)],
        imports=[(r"^\s*/(?:COPY|INCLUDE)\s+(?P<name>\S+)", I | M)],
    ),
    "tcl": PatternLanguage(
        definitions=[
            ("proc_definition", r"^\s*proc\s+(?P<name>[A-Za-z_:][A-Za-z0-9_:]*)\s+\{", M),
            ("class_definition", r"\boo::class\s+create\s+(?P<name>[A-Za-z_:][A-Za-z0-9_:]*)", M),
            ("module", r"^\s*namespace\s+eval\s+(?P<name>[A-Za-z_:][A-Za-z0-9_:]*)", M),
        ],
        imports=[
            (r"^\s*package\s+require\s+(?P<name>[A-Za-z_][A-Za-z0-9_.]*)", M),
            (r"^\s*source\s+(?P<name>\S+)", M),
        ],
    ),
}


LANGUAGES |= {language: PatternLanguage(**told) for language, told in OWN.items()}
#: Parsers by language, content -> rows of COLUMNS; what is registered here goes before patterns.
PARSERS: dict[str, Callable[[str], list[tuple]]] = {}


def register(language: str, patterns: PatternLanguage | Callable[[str], list[tuple]]) -> None:
    """Adds or replaces a language, by patterns or a parser (content -> rows of COLUMNS); it travels to the executors with the next extraction."""
    (LANGUAGES if isinstance(patterns, PatternLanguage) else PARSERS)[language] = patterns


def by_patterns(content: str, told: PatternLanguage, language: str = "") -> list[tuple]:
    """Rows of all matches, by line and column of where a match starts, a definition's with its text (200 characters at most) as detail, an import's with the names it binds; line numbers from 0."""
    if told.continuation:
        content = content.replace(told.continuation + "\n", " ")
    if told.comments:
        content = re.sub(told.comments, lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.DOTALL)
    groups = [("definition", told.definitions), ("call", [("call_expression", *p) for p in told.calls]), ("import", [("include_statement", *p) for p in told.imports])]
    starts = [0] + [m.end() for m in re.finditer("\n", content)]
    line_of = lambda at: bisect_right(starts, at) - 1
    found, declared = [], set()
    for kind, patterns in groups:
        for label, pattern, flags in patterns:
            for m in re.finditer(pattern, content, flags):
                if kind == "definition" and told.comments:
                    if m.start("name") in declared:
                        continue
                    declared.add(m.start("name"))
                elif kind == "call" and m.start("name") in declared:
                    continue
                line = line_of(m.start())
                text = m[0].strip()[:200] if kind == "definition" else None
                if kind == "import" and told.comments:
                    text = bindings(language, content[m.start() : content.find("\n", m.end()) if "\n" in content[m.end() :] else len(content)])
                found.append((line, m.start() - starts[line], kind, m["name"], label, line_of(m.end()), text))
    found.sort(key=lambda x: x[:2])  # what starts together stays in the order of the patterns
    return [(kind, name, label, None, line, end, text, None, None) for line, _, kind, name, label, end, text in found]


def _type_name(node: ast.expr | None) -> str | None:
    """A type's plain name: wrappers that mean "or nothing" are opened, qualified names give their last part."""
    if isinstance(node, ast.Constant):
        return _type_name(ast.parse(node.value, mode="eval").body) if isinstance(node.value, str) and node.value.isidentifier() else None
    if isinstance(node, ast.Subscript):
        outer = _type_name(node.value)
        return _type_name(node.slice) if outer in ("Optional", "Option", "Maybe", "Nullable") else outer
    if isinstance(node, ast.BinOp):
        return _type_name(node.left) or _type_name(node.right)
    name = node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None
    return None if name in ("str", "int", "float", "bool", "bytes", "None", "list", "dict", "set", "tuple", "object") else name


def python_rows(content: str) -> list[tuple]:
    """Rows of a Python file; a syntax error gives one row of kind ``skipped``. Lines from 0."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return [("skipped", None, None, None, 0, 0, "syntax error", None, None)]
    out: list[tuple] = []

    def dotted(node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        return f"{p}.{node.attr}" if isinstance(node, ast.Attribute) and (p := dotted(node.value)) else None

    def visit(node, cls: str | None, fn: str | None) -> None:
        add = lambda row: out.append((*row, cls))
        for child in ast.iter_child_nodes(node):
            inner_cls, inner_fn = cls, fn
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                label = "Method" if cls and isinstance(node, ast.ClassDef) else "Function"
                params = [a.arg for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs)]
                exported = "false" if child.name.startswith("_") else "true"
                add(("definition", child.name, label, cls if label == "Method" else None, child.lineno - 1, (child.end_lineno or child.lineno) - 1, ",".join(params), exported))
                for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs):
                    if t := _type_name(a.annotation):
                        add(("type", a.arg, "explicit", child.name, child.lineno - 1, child.lineno - 1, t, None))
                if t := _type_name(child.returns):
                    add(("type", child.name, "return", child.name, child.lineno - 1, child.lineno - 1, t, None))
                inner_fn = child.name
            elif isinstance(child, ast.ClassDef):
                add(("definition", child.name, "Class", cls, child.lineno - 1, (child.end_lineno or child.lineno) - 1, "", "false" if child.name.startswith("_") else "true"))
                for base in child.bases:
                    if name := dotted(base):
                        add(("heritage", child.name, "extends", None, child.lineno - 1, child.lineno - 1, name, None))
                inner_cls, inner_fn = child.name, None
            elif isinstance(child, ast.Import):
                for a in child.names:
                    add(("import", a.name, None, None, child.lineno - 1, child.lineno - 1, a.asname or a.name, None))
            elif isinstance(child, ast.ImportFrom):
                names = ",".join(f"{a.asname or a.name}={a.name}" for a in child.names)
                add(("import", "." * child.level + (child.module or ""), None, None, child.lineno - 1, child.lineno - 1, names, None))
            elif isinstance(child, ast.Call):
                if isinstance(child.func, ast.Attribute):
                    form, name = "member", child.func.attr
                    receiver = "super()" if isinstance(child.func.value, ast.Call) and dotted(child.func.value.func) == "super" else dotted(child.func.value)
                else:
                    name, receiver = dotted(child.func), None
                    form = "constructor" if name and name[:1].isupper() else "free"
                if name:
                    add(("call", name, form, fn or cls, child.lineno - 1, child.lineno - 1, receiver, str(len(child.args) + len(child.keywords))))
            elif isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name):
                if t := _type_name(child.annotation):
                    add(("type", child.target.id, "explicit", fn, child.lineno - 1, child.lineno - 1, t, None))
            if isinstance(child, (ast.Assign, ast.AnnAssign)):
                for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(target, ast.Attribute) and (receiver := dotted(target.value)):
                        add(("assignment", target.attr, None, fn or cls, child.lineno - 1, child.lineno - 1, receiver, None))
                    if isinstance(target, ast.Name) and isinstance(child.value, ast.Call) and (made := dotted(child.value.func)) and made.rsplit(".")[-1][:1].isupper():
                        add(("type", target.id, "constructor", fn, child.lineno - 1, child.lineno - 1, made.rsplit(".")[-1], None))
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                body = child.body[0]
                if isinstance(body, ast.Expr) and isinstance(body.value, ast.Constant) and isinstance(body.value.value, str):
                    text = ast.get_docstring(child) or ""
                    if len(text) >= 20:
                        add(("docstring", child.name, "Section", cls, body.lineno - 1, (body.end_lineno or body.lineno) - 1, text[:500], "Class" if isinstance(child, ast.ClassDef) else "Method" if cls and isinstance(node, ast.ClassDef) else "Function"))
            visit(child, inner_cls, inner_fn)

    visit(tree, None, None)
    return out


def dumped(sources: DataFrame) -> DataFrame:
    """(path, seq, depth, type, line, text): the syntax tree of every Python source, a row per node from the root down, its text cut to 80 characters; for looking at."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    todo = [(0, ast.parse(content or ""))]
                except (SyntaxError, ValueError):
                    continue
                n = 0
                while todo:
                    depth, node = todo.pop()
                    text = ast.get_source_segment(content, node) or "" if hasattr(node, "lineno") else ""
                    rows.append((path, n, depth, type(node).__name__, getattr(node, "lineno", 1) - 1, text[:80]))
                    todo += [(depth + 1, child) for child in reversed(list(ast.iter_child_nodes(node)))]
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["path", "seq", "depth", "type", "line", "text"])

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    python = sources.filter(language_of(F.col("path"), F.col("content")) == "python")
    return python.select("path", "content").mapInArrow(run, "path string, seq long, depth long, type string, line long, text string")


def extracted(sources: DataFrame) -> DataFrame:
    """Rows of every source (path, content), with the file's language and order; a language without a parser gives one ``skipped`` row. Calls of built-in names are left out."""
    languages, parsers = dict(LANGUAGES), {"python": python_rows, **PARSERS}

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for path, content, language in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if language in parsers:
                    found = parsers[language](content or "")
                elif language in languages:
                    found = by_patterns(content or "", languages[language], language)
                else:
                    found = [("skipped", None, None, None, 0, 0, "no parser", None, None)]
                rows += [(path, language, i, *r) for i, r in enumerate(found)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    names = ["path", "language", "seq", *COLUMNS]
    arrow = pa.schema([(n, pa.int64() if n in ("seq", "line", "end_line") else pa.string()) for n in names])
    rows = sources.select("path", "content", language_of(F.col("path"), F.col("content")).alias("language")).mapInArrow(run, SCHEMA)
    return without_builtins(rows)


def without_builtins(rows: DataFrame) -> DataFrame:
    """Extracted rows but the calls of built-in names."""
    names = rows.sparkSession.createDataFrame([(n,) for n in sorted(BUILTIN_CALLS)], "_builtin string")
    return rows.join(F.broadcast(names), (rows["kind"] == "call") & (rows["name"] == names["_builtin"]), "left_anti")


def symbols(rows: DataFrame) -> DataFrame:
    """Definition rows as symbols and nodes: id ``Label:path:name``, owner ``Class:path:owner``. A node type of a pattern gives its label; one without a label is no symbol. Where a parser doesn't say whether it is exported, its language's rule does."""
    known = F.create_map(*[F.lit(x) for pair in NODE_TYPE_LABELS.items() for x in pair])
    label = F.when(F.col("label").isin(NODE_LABELS), F.col("label")).otherwise(F.element_at(known, F.col("label")))
    found = rows.filter("kind = 'definition'").withColumn("label", label).filter("label IS NOT NULL")
    owner = F.when(F.col("owner").isNotNull(), F.concat(F.lit("Class:"), "path", F.lit(":"), "owner"))
    return found.select("path", "seq", "name", "label", F.concat("label", F.lit(":"), "path", F.lit(":"), "name").alias("node_id"), owner.alias("owner_id"), "line", "end_line", F.coalesce(F.col("extra") == "true", is_exported(F.col("language"), F.col("name"), F.col("detail"))).alias("exported"))


def owner_edges(found: DataFrame) -> DataFrame:
    """HAS_METHOD and HAS_PROPERTY edges of symbols with an owner."""
    kind = F.when(F.col("label") == "Property", "HAS_PROPERTY").otherwise("HAS_METHOD")
    owned = found.filter("owner_id IS NOT NULL AND label IN ('Method', 'Constructor', 'Property')")
    return owned.select(F.concat("owner_id", F.lit("_"), F.lower(kind), F.lit("_"), "node_id").alias("id"), F.col("owner_id").alias("source_id"), F.col("node_id").alias("target_id"), kind.alias("type")).distinct()


def contains_edges(found: DataFrame) -> DataFrame:
    """CONTAINS edges from a file to each of its symbols."""
    file = F.concat(F.lit("File:"), "path")
    return found.select(F.concat(file, F.lit("_contains_"), "node_id").alias("id"), file.alias("source_id"), F.col("node_id").alias("target_id"), F.lit("CONTAINS").alias("type")).distinct()


def sections(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a Section for every docstring, and its DESCRIBES edge to what it documents. Lines from 1."""
    rows = rows.filter("kind = 'docstring'")
    node = F.concat(F.lit("Section:"), "path", F.lit(":L"), F.col("line").cast("string"), F.lit(":"), "name", F.lit(":docstring"))
    target = F.concat("extra", F.lit(":"), "path", F.lit(":"), "name")
    nodes = rows.select(node.alias("id"), F.lit("Section").alias("label"), F.concat("name", F.lit(" docstring")).alias("name"), F.col("path").alias("file_path"), (F.col("line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), F.col("detail").alias("content"))
    edges = rows.select(F.concat(F.lit("DESCRIBES:"), node, F.lit("->"), target).alias("id"), node.alias("source_id"), target.alias("target_id"), F.lit("DESCRIBES").alias("type"))
    return nodes.distinct(), edges.distinct()


def source_graph(rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted rows and their sources (path, content): symbols with lines from 1 and a snippet, docstring sections, CONTAINS, HAS_METHOD, HAS_PROPERTY, DESCRIBES. Of equal ids the first stays."""
    found = symbols(rows)
    first = first_wins(found.withColumnRenamed("path", "file_path"), "node_id", ["file_path", "seq"])
    nodes = first.join(sources.select(F.col("path").alias("file_path"), "content"), "file_path")
    lines = F.slice(F.split("content", "\n", -1), F.col("line").cast("int") + 1, F.least(F.col("end_line") - F.col("line") + 1, F.lit(200)).cast("int"))
    nodes = nodes.select(F.col("node_id").alias("id"), "label", "name", "file_path", (F.col("line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), F.array_join(lines, "\n").alias("content"))
    section_nodes, describes = sections(rows)
    edges = contains_edges(found).unionByName(owner_edges(found)).unionByName(describes)
    return nodes.unionByName(section_nodes), edges


def enclosing(rows: DataFrame) -> DataFrame:
    """Call rows with ``source_id``: the function or class they stand in, else the file."""
    owner = F.when(F.col("scope").isNotNull() & (F.col("owner") != F.col("scope")), "Method").when(F.col("owner") == F.col("scope"), "Class").otherwise("Function")
    source = F.when(F.col("owner").isNull(), F.concat(F.lit("File:"), "path")).otherwise(F.concat(owner, F.lit(":"), "path", F.lit(":"), "owner"))
    return rows.filter("kind = 'call'").withColumn("source_id", source)


def self_types(rows: DataFrame) -> DataFrame:
    """(path, seq, type) of calls and assignments through ``self`` or ``cls`` (the enclosing class) and ``super()`` (its first base)."""
    used = rows.filter("kind IN ('call', 'assignment') AND scope IS NOT NULL AND detail IN ('self', 'cls', 'super()')")
    base = rows.filter("kind = 'heritage'").groupBy("path", F.col("name").alias("scope")).agg(F.min_by("detail", "seq").alias("base"))
    found = used.join(base, ["path", "scope"], "left")
    return found.select("path", "seq", F.when(F.col("detail") == "super()", F.col("base")).otherwise(F.col("scope")).alias("type")).filter("type IS NOT NULL")
