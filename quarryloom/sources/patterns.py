"""Patterns of this library's own for languages whose grammars aren't at hand: what a declaration, call or import looks like.

They approximate a parser: comments are blanked, nesting isn't followed, so a
method has no owner. A parser registered for a language goes before them.
"""

from __future__ import annotations

import re

M = re.MULTILINE
_SLASHES = r"//[^\n]*|/\*.*?\*/"
_HASH = r"(?m)(?<![\w$'\"])#[^\n]*"
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
#: A name before an open parenthesis, unless it is a statement's word or stands behind a declaring one.
_CALL = (r"(?<!\bfunction )(?<!\bfunc )(?<!\bfun )(?<!\bfn )(?<!\bdef )\b(?!(?:if|for|foreach|while|switch|match|return|catch|sizeof|typeof|elseif|when|until|unless|function|func|fun|fn|def|new|using|lock|throw|and|or|not)\b)" + _NAME + r"\s*\(", 0)
_BODY = r"\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)"
_JVM_MODS = r"^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|partial|readonly|data|open|inline|suspend|synchronized|native|default|extern|unsafe|case|implicit|lazy)\s+)*"


def _typed_method(node_type: str) -> tuple[str, str, int]:
    return node_type, _JVM_MODS + r"(?!(?:return|new|else|throw|await|yield|package|import|using|goto|case)\b)[A-Za-z_][\w.<>\[\],? ]*[ \t]+" + _NAME + r"[ \t]*" + _BODY + r"\s*(?:throws\s+[\w., ]+)?\s*\{", M


def _script(typed: bool) -> dict:
    out = [
        ("class_declaration", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+" + _NAME, M),
        ("function_declaration", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*" + _NAME, M),
        ("function_declaration", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+" + _NAME + r"\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>", M),
        ("method_definition", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?!(?:if|for|while|switch|catch|function|return|constructor)\b)" + _NAME + r"\s*" + _BODY + r"\s*(?::[^{;\n]+)?\{", M),
    ]
    if typed:
        out += [("interface_declaration", r"^[ \t]*(?:export\s+)?interface\s+" + _NAME, M), ("enum_declaration", r"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+" + _NAME, M), ("type_alias_declaration", r"^[ \t]*(?:export\s+)?type\s+" + _NAME + r"\s*(?:<[^=\n]*>)?\s*=", M)]
    return {"definitions": out, "calls": [_CALL], "imports": [(r"""^[ \t]*(?:import|export)\b[^;'"\n]*?(?:from\s*)?['"](?P<name>[^'"\n]+)['"]""", M), (r"""\brequire\(\s*['"](?P<name>[^'"\n]+)['"]\s*\)""", 0)], "comments": _SLASHES}


OWN = {
    "javascript": _script(False),
    "typescript": _script(True),
    "java": {
        "definitions": [("class_declaration", _JVM_MODS + r"class\s+" + _NAME, M), ("interface_declaration", _JVM_MODS + r"interface\s+" + _NAME, M), ("enum_declaration", _JVM_MODS + r"enum\s+" + _NAME, M), _typed_method("method_declaration")],
        "calls": [_CALL],
        "imports": [(r"^[ \t]*import\s+(?:static\s+)?(?P<name>[\w.]+(?:\.\*)?)\s*;", M)],
        "comments": _SLASHES,
    },
    "c_sharp": {
        "definitions": [("class_declaration", _JVM_MODS + r"class\s+" + _NAME, M), ("interface_declaration", _JVM_MODS + r"interface\s+" + _NAME, M), ("struct_declaration", _JVM_MODS + r"struct\s+" + _NAME, M), ("enum_declaration", _JVM_MODS + r"enum\s+" + _NAME, M), _typed_method("method_declaration")],
        "calls": [_CALL],
        "imports": [(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<name>[\w.]+)\s*;", M)],
        "comments": _SLASHES,
    },
    "kotlin": {
        "definitions": [("class_declaration", _JVM_MODS + r"(?:enum\s+)?class\s+" + _NAME, M), ("interface_declaration", _JVM_MODS + r"interface\s+" + _NAME, M), ("object_declaration", _JVM_MODS + r"object\s+" + _NAME, M), ("function_declaration", _JVM_MODS + r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?" + _NAME, M)],
        "calls": [_CALL],
        "imports": [(r"^[ \t]*import\s+(?P<name>\w+(?:\.\w+)*(?:\.\*)?)", M)],
        "comments": _SLASHES,
    },
    "scala": {
        "definitions": [("class_definition", _JVM_MODS + r"class\s+" + _NAME, M), ("object_definition", _JVM_MODS + r"object\s+" + _NAME, M), ("trait_definition", _JVM_MODS + r"trait\s+" + _NAME, M), ("function_definition", _JVM_MODS + r"def\s+" + _NAME, M)],
        "calls": [_CALL],
        "imports": [(r"^[ \t]*import\s+(?P<name>\w+(?:\.\w+)*)", M)],
        "comments": _SLASHES,
    },
    "go": {
        "definitions": [("function_declaration", r"^func\s+" + _NAME, M), ("method_declaration", r"^func\s+\([^)]*\)\s*" + _NAME, M), ("struct_declaration", r"^type\s+" + _NAME + r"\s+struct\b", M), ("interface_declaration", r"^type\s+" + _NAME + r"\s+interface\b", M)],
        "calls": [_CALL],
        "imports": [(r'^import\s+(?:[\w.]+\s+)?"(?P<name>[^"\n]+)"', M), (r'^[ \t]+(?:[\w.]+[ \t]+)?"(?P<name>[\w./-]+)"[ \t]*$', M)],
        "comments": _SLASHES,
    },
    "rust": {
        "definitions": [("function_item", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+" + _NAME, M), ("struct_declaration", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+" + _NAME, M), ("enum_item", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+" + _NAME, M), ("trait_item", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+" + _NAME, M), ("impl_item", r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?" + _NAME, M)],
        "calls": [_CALL],
        "imports": [(r"^[ \t]*(?:pub\s+)?use\s+(?P<name>[\w:]+(?:\{[^}]*\})?)", M)],
        "comments": _SLASHES,
    },
    "c": {
        "definitions": [_typed_method("function_definition"), ("struct_specifier", r"^[ \t]*(?:typedef\s+)?struct\s+" + _NAME + r"\s*\{", M)],
        "calls": [_CALL],
        "imports": [(r'^[ \t]*#[ \t]*include\s*[<"](?P<name>[^>"\n]+)[>"]', M)],
        "comments": _SLASHES,
    },
    "cpp": {
        "definitions": [_typed_method("function_definition"), ("class_specifier", r"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+" + _NAME + r"[^;{]*\{", M), ("struct_specifier", r"^[ \t]*(?:typedef\s+)?struct\s+" + _NAME + r"[^;{]*\{", M)],
        "calls": [_CALL],
        "imports": [(r'^[ \t]*#[ \t]*include\s*[<"](?P<name>[^>"\n]+)[>"]', M)],
        "comments": _SLASHES,
    },
    "php": {
        "definitions": [("class_declaration", r"^[ \t]*(?:abstract\s+|final\s+)*class\s+" + _NAME, M), ("interface_declaration", r"^[ \t]*interface\s+" + _NAME, M), ("trait_item", r"^[ \t]*trait\s+" + _NAME, M), ("function_definition", r"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?" + _NAME, M)],
        "calls": [_CALL],
        "imports": [(r"^use\s+(?:function\s+|const\s+)?(?P<name>[\w\\]+)", M), (r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"](?P<name>[^'"\n]+)['"]""", 0)],
        "comments": _SLASHES,
    },
    "ruby": {
        "definitions": [("class_declaration", r"^[ \t]*class\s+" + _NAME, M), ("module", r"^[ \t]*module\s+" + _NAME, M), ("method", r"^[ \t]*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)", M)],
        "calls": [_CALL],
        "imports": [(r"""^[ \t]*require(?:_relative)?\s*\(?\s*['"](?P<name>[^'"\n]+)['"]""", M)],
        "comments": _HASH,
    },
    "swift": {
        "definitions": [("class_declaration", r"^[ \t]*(?:(?:public|open|final|private|internal|fileprivate)\s+)*class\s+(?!func\b|var\b)" + _NAME, M), ("struct_declaration", r"^[ \t]*(?:(?:public|private|internal|fileprivate)\s+)*struct\s+" + _NAME, M), ("protocol_declaration", r"^[ \t]*(?:(?:public|private|internal)\s+)*protocol\s+" + _NAME, M), ("enum_declaration", r"^[ \t]*(?:(?:public|private|internal|indirect)\s+)*enum\s+" + _NAME, M), ("function_declaration", r"^[ \t]*(?:(?:public|open|private|internal|static|class|override|mutating|final|fileprivate)\s+)*func\s+" + _NAME, M)],
        "calls": [_CALL],
        "imports": [(r"^[ \t]*(?:@\w+\s+)?import\s+(?:(?:class|struct|func|enum|protocol)\s+)?(?P<name>\w+(?:\.\w+)*)", M)],
        "comments": _SLASHES,
    },
    "perl": {
        "definitions": [("subroutine_declaration", r"^[ \t]*sub\s+" + _NAME, M), ("package_declaration", r"^[ \t]*package\s+(?P<name>[\w:]+)", M)],
        "calls": [(r"(?<!\bsub )\b(?!(?:if|for|foreach|while|unless|until|my|return|and|or|not)\b)(?P<name>[A-Za-z_]\w*)\s*\(", 0)],
        "imports": [(r"^[ \t]*(?:use|require)\s+(?P<name>[A-Za-z][\w:]*)", M)],
        "comments": _HASH,
    },
    "vb6": {
        "definitions": [("function_definition", r"(?i)^[ \t]*(?:(?:Public|Private|Friend|Static)\s+)*(?:Sub|Function)\s+(?P<name>\w+)", M), ("property_declaration", r"(?i)^[ \t]*(?:(?:Public|Private|Friend|Static)\s+)*Property\s+(?:Get|Let|Set)\s+(?P<name>\w+)", M), ("structure_block", r"(?i)^[ \t]*(?:(?:Public|Private)\s+)?Type\s+(?P<name>\w+)", M), ("enum_block", r"(?i)^[ \t]*(?:(?:Public|Private)\s+)?Enum\s+(?P<name>\w+)", M), ("field_declaration", r"(?i)^[ \t]*(?:Public|Private)\s+(?!(?:Sub|Function|Property|Type|Enum|Const|Declare|WithEvents)\b)(?P<name>\w+)\s+As\b", M)],
        "calls": [(r"(?i)^[ \t]*Call\s+(?:\w+\.)*(?P<name>\w+)", M), (r"(?i)(?<!\bSub )(?<!\bFunction )\b(?!(?:If|ElseIf|While|And|Or|Not|Sub|Function|Call)\b)(?:\w+\.)*(?P<name>[A-Za-z_]\w*)\(", 0)],
        "imports": [],
        "comments": r"(?m)'[^\n]*",
    },
}


def _named(items: str, separator: str) -> list[tuple[str, str]]:
    """(local, exported) of a list of names, each perhaps renamed by ``as``; of a qualified name the last part."""
    out = []
    for item in filter(None, map(str.strip, items.split(","))):
        name, _, local = re.sub(r"^type\s+", "", item).partition(" as ")
        name = name.strip().rsplit(separator, 1)[-1]
        out.append((local.strip() or name, name))
    return out


def bindings(language: str, statement: str) -> str | None:
    """The names that an import statement binds, as ``local=exported`` with commas between; None where it binds none by name."""
    found: list[tuple[str, str]] = []
    braces = re.search(r"\{([^}]*)\}", statement, re.DOTALL)
    if language in ("javascript", "typescript"):
        if default := re.match(r"\s*import\s+(?!type\b)([A-Za-z_$][\w$]*)\s*(?:,|\bfrom\b)", statement):
            found.append((default[1], "default"))
        if whole := re.search(r"\*\s+as\s+([A-Za-z_$][\w$]*)", statement):
            found.append((whole[1], "*"))
        found += _named(braces[1], ".") if braces else []
    elif language in ("java", "kotlin") and (m := re.match(r"\s*import\s+(?:static\s+)?(\w+(?:\.\w+)*(?:\.\*)?(?:\s+as\s+\w+)?)", statement)):
        found += [] if m[1].endswith("*") else _named(m[1], ".")
    elif language == "c_sharp" and (m := re.match(r"\s*(?:global\s+)?using\s+(\w+)\s*=\s*([\w.]+)", statement)):
        found.append((m[1], m[2].rsplit(".", 1)[-1]))
    elif language == "rust" and (m := re.match(r"\s*(?:pub\s+)?use\s+([\w:]+(?:\s+as\s+\w+)?)", statement)):
        found += [x for x in _named(braces[1] if braces else m[1], "::") if x[1] not in ("self", "*")]
    elif language == "php" and (m := re.match(r"\s*use\s+(?:function\s+|const\s+)?([\w\\]+(?:\s+as\s+\w+)?)", statement)):
        found += _named(braces[1] if braces else m[1], "\\")
    return ",".join(f"{local}={name}" for local, name in found) or None
