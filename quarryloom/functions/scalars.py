"""Scalar functions as column expressions; only byte_entropy leaves the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import AMBIGUOUS, EXPORTED_NAMES, LANGUAGE_OF, TSX_SUFFIXES


def node_id(*parts) -> Column:
    """``Label:part:...``; null if a part is."""
    out = [F.lit(parts[0]) if isinstance(parts[0], str) else parts[0]]
    for p in parts[1:]:
        out += [F.lit(":"), p.cast("string")]
    return F.concat(*out)


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def snippet(text: Column, start: int, end: int, most: int = 200) -> Column:
    """Lines [start, min(end + 1, start + most)), counted from 0."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start + 1, min(end + 1 - start, most)), "\n")


def csv_field(value: Column) -> Column:
    """A CSV field: null, '' and 'None' are empty; control characters go; commas, quotes and line ends are quoted."""
    clean = F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    quoted = F.when(clean.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(clean, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(clean)
    return F.when(value.isNull() | value.isin("", "None"), "").otherwise(quoted)


def replacement_share(text: Column) -> Column:
    """Share of U+FFFD in a text; 0 for an empty one."""
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.replace(text, F.lit("�"), F.lit("")))) / n)


def is_binary_text(text: Column) -> Column:
    return replacement_share(text) > 0.01


def byte_codes(content: Column, most: int = 8192) -> Column:
    """The first bytes of a binary column as an array of numbers."""
    head = F.hex(F.substring(content, 1, most))
    return F.transform(F.regexp_extract_all(head, F.lit("(..)"), 1), lambda x: F.conv(x, 16, 10).cast("int"))


def char_entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, bits; 0 if empty. Each distinct one is counted by what the text loses without it."""
    n = F.length(text)
    chars = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    shares = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n == 0, 0.0).otherwise(F.abs(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))))


def byte_entropy(content: Column) -> Column:
    """Shannon entropy of all bytes, bits; 0 if empty, null of null. One counting pass."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        out = []
        for value in column:
            raw = value.as_buffer()
            if raw is None:
                out.append(None)
                continue
            n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            p = n[n > 0] / max(1, n.sum())
            out.append(float(abs(-(p * np.log2(p)).sum())))
        return pa.array(out, pa.float64())

    return of(content)


def is_binary_content(content: Column) -> Column:
    """Empty: no. A Unicode byte order mark: no. Then: any NUL, over 5 % control bytes, or over 7.5 bits of entropy in the first 8192 bytes."""
    head = F.hex(F.substring(content, 1, 4))
    marked = head.startswith("FFFE") | head.startswith("FEFF") | head.startswith("EFBBBF") | (head == "0000FEFF")
    codes = byte_codes(content)
    n = F.size(codes)
    control = F.size(F.filter(codes, lambda c: c.between(1, 8) | c.between(14, 31)))
    return F.when(content.isNull() | (F.length(content) == 0) | marked, False).when(F.array_contains(codes, 0), True).when(control / n > 0.05, True).otherwise(byte_entropy(F.substring(content, 1, 8192)) > 7.5)


def split_identifier(name: Column) -> Column:
    """The name, then its lower-case parts: at ``_ - . /``, camel case, acronyms and numbers."""
    token = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
    segments = F.filter(F.split(name, "[_.\\-/]"), lambda s: s != "")
    parts = F.flatten(F.transform(segments, lambda s: F.when(s.rlike("[A-Za-z0-9]"), F.regexp_extract_all(s, F.lit(token), 0)).otherwise(F.array(s))))
    return F.when(F.size(parts) == 0, name).otherwise(F.concat(name, F.lit(" "), F.lower(F.array_join(parts, " "))))


def strip_block_comment(text: Column) -> Column:
    text = F.regexp_replace(F.trim(text), r"^/\*\*?", "")
    text = F.regexp_replace(text, r"\*/$", "")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^[ \t]*\*[ ]?", "")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def strip_line_comment(text: Column, prefix: str) -> Column:
    one = lambda x: F.when(F.trim(x).startswith(prefix), F.regexp_replace(F.substring(F.trim(x), len(prefix) + 1, 1 << 30), "^ ", "")).otherwise(F.trim(x))
    return F.trim(F.array_join(F.transform(F.split(text, "\n", -1), one), "\n"))


def clean_docstring(raw: Column, language: Column) -> Column:
    """A docstring without its language's comment marks."""
    block = lambda: strip_block_comment(raw)
    slashes = F.when(F.ltrim(raw).startswith("///"), strip_line_comment(raw, "///")).otherwise(block())
    general = F.when(F.ltrim(raw).startswith("/*"), block()).otherwise(strip_line_comment(raw, "//"))
    out = F.when(language == "python", raw).when(language.isin("rust", "swift", "c_sharp"), slashes)
    return out.when(language == "vb6", strip_line_comment(raw, "'")).when(language == "go", strip_line_comment(raw, "//")).when(language == "ruby", strip_line_comment(raw, "#")).otherwise(general)


def is_exported(language: Column, name: Column, declaration: Column) -> Column:
    """Whether a symbol is visible from outside, by its language's rule on its name or the text of its declaration; true where there is no rule.

    A modifier counts where it stands as a word in the declaration's first line, before the name.
    """
    head = F.call_function("substring_index", F.substring_index(declaration, "\n", 1), name, F.lit(1))
    has = lambda *words: head.rlike(r"\b(?:" + "|".join(words) + r")\b")
    out = F.when(language == "python", ~name.startswith("_")).when(language == "go", name.rlike(r"^\p{Lu}"))
    out = out.when(language.isin("javascript", "typescript"), F.ltrim(declaration).startswith("export "))
    out = out.when(language.isin("java", "c_sharp", "apex"), has("public")).when(language == "rust", has("pub"))
    out = out.when(language == "kotlin", ~has("private", "internal")).when(language.isin("c", "cpp"), ~has("static"))
    out = out.when(language == "php", has("public") | ~has("private")).when(language == "swift", has("public", "open"))
    out = out.when(language == "vb6", ~F.lower(F.substring_index(declaration, "\n", 1)).contains("private")).when(language.isin("scala", "delphi"), ~has("private"))
    return out.when(language == "solidity", ~declaration.rlike(r"\b(?:private|internal)\b")).otherwise(True)


def is_tsx(path: Column) -> Column:
    return suffix_of(path).isin(TSX_SUFFIXES)


#: Visual Basic 6 source as the parser of its successor reads it: pattern and replacement, in order.
_VB6 = [
    (r"(?im)^VERSION\s[^\n]*\n", ""),
    (r"(?ims)^BEGIN\b.*?^END\s*$\n?", ""),
    (r"(?im)^Attribute\s[^\n]*\n?", ""),
    (r"(?im)^(\s*(?:Public\s+|Private\s+)?)Type\s+(\w+)", "$1Structure $2"),
    (r"(?im)^(\s*)End\s+Type\b", "$1End Structure"),
    (r"(?im)^(\s*)Set\s+(?=[\w.]+\s*=)", "$1"),
    (r"(?im)^(\s*)Wend\b", "$1End While"),
    (r"(?im)^(\s*)On\s+Error\b[^\n]*", "$1"),
    (r"(?im)^(\s*)Option\s+(?:Base|Compare|Private)\b[^\n]*", "$1"),
    (r"(?im)^(\s*)GoSub\s+(\w+)", "$1$2()"),
    (r"(?im)^(\s*)Def(?:Bool|Byte|Int|Lng|Cur|Sng|Dbl|Date|Str|Obj|Var)\b[^\n]*", "$1"),
]


def vb6_as_vb(content: Column, name: Column) -> Column:
    """Visual Basic 6 source rewritten line by line: headers and attributes go, statements that its successor dropped become ones it has, all inside a Module, so that lines move by one."""
    for pattern, new in _VB6:
        content = F.regexp_replace(content, pattern, new)
    return F.concat(F.lit("Module "), F.regexp_replace(name, r"\W", "_"), F.lit("\n"), content, F.lit("\nEnd Module\n"))


def prop(columns: list[str], name: str, default=None) -> Column:
    """A node's property by its own name or its exported one, whichever ``columns`` has, else its entry in ``extra``, else the default."""
    names = [name, EXPORTED_NAMES.get(name), *[own for own, out in EXPORTED_NAMES.items() if out == name]]
    found = [F.col(n).cast("string") for n in names if n in columns] + [F.col("extra")[n] for n in names if n and "extra" in columns]
    return F.coalesce(*found, F.lit(default).cast("string"))


def brief_signature(name: Column, params: Column, returns: Column) -> Column:
    """name(params)[ -> type], at most 500 characters, cut to 497 and three dots."""
    kind = F.trim(F.regexp_replace(F.coalesce(returns, F.lit("")), r"^\s*(->|:)\s*", ""))
    whole = F.concat(name, F.coalesce(params, F.lit("()")), F.when(kind != "", F.concat(F.lit(" -> "), kind)).otherwise(""))
    return F.when(F.length(whole) > 500, F.concat(F.substring(whole, 1, 497), F.lit("..."))).otherwise(whole)


def parameter_count(params: Column) -> Column:
    """Non-empty pieces between commas of a parenthesised list."""
    inner = F.regexp_replace(params, r"^\s*\(|\)\s*$", "")
    return F.size(F.filter(F.split(inner, ","), lambda p: F.trim(p) != ""))


def normal_path(path: Column) -> Column:
    """A path with ``.`` and ``..`` applied; ``..`` above the root is dropped."""
    parts = F.split(path, "/")
    step = lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def relative_module(module: Column, from_file: Column) -> Column:
    """The path stem of a leading-dots import: one dot is the file's folder, each further one its parent; null if that leaves the root."""
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    folder = F.split(from_file, "/")
    up = F.size(folder) - dots
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    stem = F.slice(folder, F.lit(1), F.greatest(up, F.lit(0)))
    return F.when(dots == 0, F.replace(module, F.lit("."), F.lit("/"))).when(up < 0, F.lit(None)).otherwise(F.array_join(F.filter(F.concat(stem, F.array(rest)), lambda p: p != ""), "/"))


def storage_key(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 12)


def suffix_of(path: Column) -> Column:
    """The lower-cased last suffix of a file name, with its dot; '' without one."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1))


def language_of(path: Column, head: Column | None = None) -> Column:
    """The language by suffix; of a shared suffix, the one with most of its strings in the head, the first of equals."""
    ext = suffix_of(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    out = F.when(F.map_contains_key(known, ext), F.element_at(known, ext))
    for shared, languages in AMBIGUOUS.items():
        names = list(languages)
        if head is None:
            out = out.when(ext == shared, F.lit(names[0]))
            continue
        text = F.coalesce(F.substring(head, 1, 2048), F.lit(""))
        score = lambda lang: sum((text.contains(s).cast("int") for s in languages[lang]), F.lit(0))  # noqa: B023, E731
        best = F.sort_array(F.array(*[F.struct((-score(lang)).alias("s"), F.lit(i).alias("i"), F.lit(lang).alias("lang")) for i, lang in enumerate(names)]))
        out = out.when(ext == shared, best[0]["lang"])
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 if a side has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
