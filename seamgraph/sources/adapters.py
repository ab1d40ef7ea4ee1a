"""Syntax adapters: one file's bytes -> declarations, relations, types. Standard library only.

Python and Starlark go through the ast module, data formats through their parsers; the other languages
through a scanner that blanks literals and comments at equal length, balances brackets, and reads
declarations and relations from what is left. Dynamic dispatch is never guessed. Literals and values are
withheld: only names, and hashes of exact bytes, leave an adapter.
"""

from __future__ import annotations

import ast
import configparser
import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field
from html.parser import HTMLParser
from importlib import resources

from ..model import VERSION, Limits, SymbolRef, TypeRef, digest, fail

STRUCTURED = {"css", "ini", "json", "sql", "toml", "yaml"}
_MISSING = {
    "php": ["php_autoload_resolution", "php_namespace_resolution", "php_runtime_effects"],
    "vue": ["vue_sfc_compiler", "vue_style_semantics", "vue_template_semantics"],
}
_SAFE_LABEL = re.compile(r"[-+=()/\[\]!?*&,<>$.:\\\s\w]{1,512}")
_SAFE_KEY = re.compile(r"[-\w:./<>@]{1,128}")
_LONG_NUMBER = re.compile(r"\b(?:[0-9]{6,}|0x[a-fA-F0-9]+)\b")


def implementation() -> str:
    """Changes with any of the package's sources that a graph is built by. They are read as the package's resources, so the
    executors, who have them in an archive, tell the same."""
    found = {}

    def walk(folder, at: str) -> None:
        for x in folder.iterdir():
            if x.is_dir() and x.name not in ("llm", "__pycache__"):
                walk(x, f"{at}{x.name}/")
            elif x.name.endswith(".py"):
                found[at + x.name] = hashlib.sha256(x.read_bytes()).hexdigest()

    walk(resources.files(__package__.partition(".")[0]), "")
    return digest(found)


def provenance(language: str) -> dict:
    return {"adapter": language, "versions": {"seamgraph": VERSION}, "rule": f"source/syntax/{VERSION}", "implementation": IMPLEMENTATION}


IMPLEMENTATION = implementation()


def label(text: str) -> str:
    return text if _SAFE_LABEL.fullmatch(text) else "<expression>"


@dataclass
class Decl:
    """A declaration found in a unit: offsets in characters of its text."""

    node: str
    kind: str
    name: str
    start: int
    end: int
    scope: tuple = ()
    parameters: int | None = None
    method: bool = False
    attributes: list = field(default_factory=list)
    cfg: list = field(default_factory=list)


@dataclass
class Rel:
    """A relation found in a unit."""

    kind: str
    name: str
    start: int
    end: int
    module: str | None = None
    bindings: list = field(default_factory=list)
    aliases: list = field(default_factory=list)
    type_only: bool = False


# ---- blanking


def _rules(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts), re.S)


_DQ, _SQ, _BT = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'", r"`(?:\\.|[^`\\])*`"
_HASH, _LINE, _BLOCK = r"(?<![\w$&{])#[^\n]*", r"//[^\n]*", r"/\*.*?\*/"
BLANKS = {
    "rust": _rules(r'r(#*)".*?"\1', _LINE, _BLOCK, r'b?"(?:\\.|[^"\\])*"', r"b?'(?:\\[^']+|[^'\\])'"),
    "script": _rules(_LINE, _BLOCK, _DQ, _SQ, _BT),
    "php": _rules(r"\?>.*?(?=<\?php|\Z)", r"\A.*?(?=<\?php)", _LINE, r"#(?!\[)[^\n]*", _BLOCK, r"<<<\s*[\"']?(?P<tag>\w+)[\"']?\n.*?\n\s*(?P=tag)\b", _DQ, _SQ),
    "bash": _rules(r"<<-?\s*[\"']?(?P<tag>\w+)[\"']?\n.*?\n\s*(?P=tag)(?=\n|\Z)", _HASH, _DQ, r"'[^']*'"),
    "make": _rules(r"#[^\n]*"),
    "nix": _rules(r"#[^\n]*", _BLOCK, r"''.*?''", _DQ),
    "powershell": _rules(r"<#.*?#>", r"#[^\n]*", r'@".*?"@', r"@'.*?'@", r'"(?:`.|[^"`])*"', r"'[^']*'"),
}


def _space(m: re.Match) -> str:
    return re.sub(r"[^\n\r]", " ", m[0])


def blank(text: str, rules: re.Pattern) -> str:
    """text with literals and comments as spaces; lines keep their places."""
    return rules.sub(_space, text)


def _closed(text: str, path: str) -> dict[int, int]:
    """Opening bracket -> the place after its closing one; unbalanced text can't be parsed."""
    pair, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
    for m in re.finditer(r"[()\[\]{}]", text):
        if m[0] in "([{":
            stack.append(m.start())
        elif not stack or text[stack[-1]] != pair[m[0]]:
            fail("ParseFailure", path)
        else:
            out[stack.pop()] = m.end()
    if stack:
        fail("ParseFailure", path)
    return out


# ---- declarations of bracket languages: (node, kind, pattern); group n is the name

_RUST_HEAD = r"(?<![\w])(?:pub(?:\s*\([^)]*\))?\s+)?"
_TS_HEAD = r"(?<![\w.$])(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?"
DECLARED = {
    "rust": [
        ("function_item", "Function", _RUST_HEAD + r"(?:(?:const|async|unsafe|extern)\s+(?:\s*)?)*fn\s+(?P<n>\w+)"),
        ("struct_item", "Struct", _RUST_HEAD + r"struct\s+(?P<n>\w+)"),
        ("enum_item", "Enum", _RUST_HEAD + r"enum\s+(?P<n>\w+)"),
        ("trait_item", "Trait", _RUST_HEAD + r"(?:unsafe\s+)?trait\s+(?P<n>\w+)"),
        ("type_item", "TypeAlias", _RUST_HEAD + r"type\s+(?P<n>\w+)(?=[^;{}]*=)"),
        ("mod_item", "Module", _RUST_HEAD + r"mod\s+(?P<n>\w+)"),
        ("const_item", "Constant", _RUST_HEAD + r"const\s+(?P<n>[A-Z_]\w*)\s*:"),
        ("static_item", "Static", _RUST_HEAD + r"static\s+(?:mut\s+)?(?P<n>\w+)\s*:"),
        ("impl_item", "", r"(?<!\w)(?:unsafe\s+)?impl(?:\s*<[^{;]*?>)?\s+(?:[^{;]*?\sfor\s+)?(?P<n>\w+)"),
    ],
    "script": [
        ("function_declaration", "Function", _TS_HEAD + r"(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)"),
        ("class_declaration", "Class", _TS_HEAD + r"class\s+(?P<n>[\w$]+)"),
        ("interface_declaration", "Interface", _TS_HEAD + r"interface\s+(?P<n>[\w$]+)"),
        ("type_alias_declaration", "TypeAlias", _TS_HEAD + r"type\s+(?P<n>[\w$]+)(?=\s*(?:<[^=;]*>)?\s*=)"),
        ("arrow_function", "Function", r"(?<![\w.$])(?P<n>[\w$]+)\s*(?::[^=;{}()]*)?=\s*(?=(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=;{}]*)?=>)"),
        ("function_expression", "Function", r"(?<![\w.$])(?P<n>[\w$]+)\s*=\s*(?=(?:async\s+)?function\b)"),
    ],
    "php": [
        ("namespace_definition", "Namespace", r"(?<![\w$\\])namespace\s+(?P<n>[\w\\]+)"),
        ("function_definition", "Function", r"(?<![\w$])(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?\s*(?P<n>\w+)"),
        ("class_declaration", "Class", r"(?<![\w$:])(?:(?:final|abstract|readonly)\s+)*class\s+(?P<n>\w+)"),
        ("trait_declaration", "Trait", r"(?<![\w$])trait\s+(?P<n>\w+)"),
        ("interface_declaration", "Interface", r"(?<![\w$])interface\s+(?P<n>\w+)"),
        ("enum_declaration", "Enum", r"(?<![\w$])enum\s+(?P<n>\w+)"),
    ],
    "bash": [("function_definition", "Function", r"(?m)^[ \t]*(?:function[ \t]+(?P<m>[\w.:-]+)[ \t]*(?:\(\s*\))?|(?P<n>[\w.:-]+)[ \t]*\(\s*\))\s*(?=\{)")],
    "powershell": [("function_statement", "Function", r"(?i)(?<![\w-])(?:function|filter)\s+(?P<n>[\w:-]+)")],
}
_METHOD = re.compile(r"(?m)(?<=[{};\n])[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?\s*(?P<n>[\w$#]+)\s*(?:<[^(){}]*>)?\((?=[^;]*?\)\s*(?::[^;{}=]*)?\{)")
_NOT_CALLS = set(
    "if for while switch match return catch function fn elseif echo print and or not new typeof sizeof isset unset empty list array declare use "
    "await else in loop move unsafe where as super do try param foreach until static let const var import export".split()
)
_TYPE_CONTEXT = {"class_definition", "class_declaration", "interface_declaration", "impl_item", "trait_declaration", "trait_item", "enum_declaration"}


def _declarations(text: str, family: str, ends: dict[int, int]) -> list[Decl]:
    found = []
    for node, kind, pattern in DECLARED[family]:
        for m in re.finditer(pattern, text):
            name = m.groupdict().get("n") or m.groupdict().get("m")
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            body = re.compile(r"[{;]").search(text, m.end())
            nested = m.end()
            while body and body[0] == ";" and any(a < body.start() < b - 1 for a, b in ends.items() if nested <= a < body.start()):
                body = re.compile(r"[{;]").search(text, body.end())
            end = len(text) if body is None else ends[body.start()] if body[0] == "{" else body.end()
            here = node
            if node == "arrow_function":
                arrow = text.index("=>", m.end()) + 2
                rest = re.compile(r"\S").search(text, arrow)
                if rest and rest[0] in "{([":
                    end = ends[rest.start()]
                else:
                    stop = re.compile(r"[;\n]").search(text, arrow)
                    end = stop.start() if stop else len(text)
            elif node == "function_item" and body and body[0] == ";":
                here = "function_signature_item"
            elif node == "namespace_definition" and body and body[0] == ";":
                end = body.end()
            opening = text.find("(", m.end(), body.start() if body else len(text))
            count = None
            if kind == "Function":
                open_at = text.find("(", m.start(), end) if family == "bash" else opening
                if open_at >= 0 and open_at in ends:
                    inside = text[open_at + 1 : ends[open_at] - 1]
                    depth, count = 0, 1 if inside.strip() else 0
                    for c in inside.rstrip().rstrip(","):
                        depth += (c in "([{<") - (c in ")]}>")
                        count += c == "," and depth == 0
            found.append(Decl(here, kind, name, start, end, parameters=count if family != "bash" else None))
    if family == "script":
        classes = [d for d in found if d.node == "class_declaration"]
        for c in classes:
            open_at = text.find("{", c.start, c.end)
            for m in _METHOD.finditer(text, open_at, c.end) if open_at >= 0 else ():
                inner = [a for a, b in ends.items() if text[a] == "{" and a > open_at and a < m.start("n") < b]
                if inner or m["n"] in _NOT_CALLS:
                    continue
                paren = text.index("(", m.start("n"))
                brace = text.index("{", ends[paren])
                found.append(Decl("method_definition", "Method", m["n"], m.start("n"), ends[brace], parameters=len([x for x in text[paren + 1 : ends[paren] - 1].split(",") if x.strip()])))
    found.sort(key=lambda d: (d.start, -d.end))
    return found


def _scoped(found: list[Decl]) -> list[Decl]:
    """Gives each declaration its enclosing names; blocks that only scope others leave the list."""
    for d in found:
        around = [o for o in found if o is not d and o.start <= d.start and d.end <= o.end and (o.start, -o.end) < (d.start, -d.end)]
        d.scope = tuple(o.name for o in around)
        d.method = d.method or any(o.node in _TYPE_CONTEXT for o in around)
    return [d for d in found if d.kind]


def _rust_attributes(text: str, raw: str, found: list[Decl], ends: dict[int, int]) -> None:
    spans = [(m.start(), ends[m.end() - 1]) for m in re.finditer(r"#!?\[", text)]
    for d in found:
        own, at = [], d.start
        for a, b in reversed(spans):
            if b <= at and not text[b:at].strip():
                own.append(raw[a:b])
                at = a
        d.attributes = own
    for d in found:
        above = [o for o in found if o.start <= d.start and d.end <= o.end]
        every = [a for o in above for a in o.attributes]
        d.cfg = sorted({a[:512] for a in every if a[:5] == "#[cfg" and a.find('"') < 0})
    for d in found:
        d.attributes = sorted({hashlib.sha256(a.encode()).hexdigest() for o in found if o.start <= d.start and d.end <= o.end for a in o.attributes})


def _relations(text: str, raw: str, family: str, found: list[Decl]) -> list[Rel]:
    out = []
    if family == "rust":  # attributes are no expressions
        text = re.sub(r"#!?\[[^\]]*\]", _space, text)
    names_at = {text.find(d.name, d.start) for d in found}
    if family in ("rust", "script", "php"):
        for m in re.finditer(r"(?<![\w$.>:\\])(?:new\s+)?(?P<n>[A-Za-z_$][\w$]*(?:(?:\?\.|->|::|\.|\\)[A-Za-z_$][\w$]*)*)\s*(?P<g>::<[^()]*>)?(?P<x>!?)\s*[(\[{]", text):
            opener, name = m[0][-1], m["n"]
            if m["x"]:
                if family == "rust":
                    out.append(Rel("Macro", name, m.start("n"), m.end() - 1))
                continue
            if opener != "(" or name in _NOT_CALLS or m.start("n") in names_at or re.search(r"(?:\bfn|\bfunction|\bclass)\s*&?\s*$", text[max(0, m.start("n") - 12) : m.start("n")]):
                continue
            out.append(Rel("Call", name, m.start("n"), m.end()))
        for m in re.finditer(r"(?<![\w$])(?:self|this|\$?[A-Za-z_]\w*)(?:(?:\?\.|->|\.)[A-Za-z_]\w*)+", text):
            out.append(Rel("Property", m[0], m.start(), m.end()))
    if family in ("rust", "script"):
        for m in re.finditer(r"(?:->|(?<![:?]):(?!:))\s*(?:&\s*(?:mut\s+)?)?(?P<n>[A-Za-z_][\w]*)(?=\s*[,)={;<|\[>\n]|\s*$)", text):
            out.append(Rel("TypeReference", m["n"], m.start("n"), m.end("n")))
    if family == "rust":
        for m in re.finditer(r"(?<!\w)(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<n>[^;]+);", text):
            rel = Rel("Import", " ".join(m[0].split()), m.start(), m.end(), module=label(m["n"].strip()))
            rel.bindings = re.findall(r"\w+", m["n"])
            rel.aliases = [{"name": a.rsplit("::", 1)[-1], "local": b} for a, b in re.findall(r"([\w:]+)\s+as\s+(\w+)", m["n"])]
            out.append(rel)
        for m in re.finditer(r"(?<!\w)(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)\s*;", text):
            out.append(Rel("Module", m["n"], m.start(), m.end()))
        for rel in out:
            if rel.kind == "Macro" and rel.name == "include":
                literal = re.match(r'include!\s*\(\s*"([\w./-]{1,256})"\s*\)', raw[rel.start :])
                if literal:
                    rel.kind, rel.module = "Include", literal[1]
    if family == "script":
        for m in re.finditer(r"(?<![\w.$])(?P<k>import|export)\b(?P<b>[^;()'\"`]*?)(?:\bfrom\b)?\s*(?P<q>[\"'])(?P<s>[^\"'\n]*)(?P=q)", raw):
            if text[m.start() : m.start() + 6] != m["k"]:
                continue
            rel = Rel("Import", label(raw[m.start() : m.end()]), m.start(), m.end(), type_only=m[0].startswith("export type"))
            rel.module = m["s"] if re.fullmatch(r"[-\w./@]{1,256}", m["s"]) else None
            rel.bindings = [w for w in re.findall(r"[\w$]+", m["b"]) if w not in ("type", "as")]
            inner = re.search(r"\{([^}]*)\}", m["b"])
            for item in (inner[1].split(",") if inner else []):
                both = re.fullmatch(r"\s*(?:type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*", item)
                if both:
                    rel.aliases.append({"name": both[1], "local": both[2] or both[1]})
            out.append(rel)
    if family == "php":
        for m in re.finditer(r"(?<![\w$\\])(?:use\s+(?P<n>[\w\\]+)(?:\s+as\s+(?P<a>\w+))?\s*;|(?:include|require)(?:_once)?\b[^;]*;)", text):
            out.append(Rel("Import", label(" ".join(m[0].split())), m.start(), m.end(), module=m["n"]))
    if family in ("bash", "powershell"):
        for m in re.finditer(r"(?m)(?:^|[;|&({])[ \t]*(?P<n>[A-Za-z_][\w.:/-]*)(?=[ \t;\n|&)]|$)", text):
            if m["n"] not in _NOT_CALLS | set("then fi done esac case function in elif filter".split()) and m.start("n") not in names_at:
                out.append(Rel("Call", m["n"], m.start("n"), m.end("n")))
    if family == "nix":
        for m in re.finditer(r"(?<![\w.'-])(?P<n>[A-Za-z_][\w.'-]*)\s+(?=[({\[]|[A-Za-z_./<])", text):
            if m["n"] not in set("let in with inherit if then else rec assert or".split()):
                out.append(Rel("Call", m["n"], m.start("n"), m.end("n")))
    return sorted(out, key=lambda r: (r.start, -r.end))


def _shadowed(text: str, family: str, found: list[Decl], ends: dict[int, int]) -> set[str]:
    out = set()
    if family == "rust":
        out |= set(re.findall(r"\blet\s+(?:mut\s+)?(\w+)", text))
    if family == "script":
        out |= set(re.findall(r"\b(?:let|const|var)\s+([\w$]+)", text))
    for d in found:
        if d.parameters:
            at = text.find("(", d.start)
            if at in ends:
                out |= set(re.findall(r"(?:^|[,(])\s*(?:mut\s+)?([\w$]+)\s*(?=[:,=?)]|$)", text[at : ends[at]]))
    return out


# ---- Python


def _python(text: str, path: str) -> tuple[list[Decl], list[Rel], set[str], str]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        fail("ParseFailure", path)
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    rows = text.splitlines(keepends=True)

    def place(row: int, col: int) -> int:
        return lines[row - 1] + len(rows[row - 1].encode()[:col].decode())

    def span(n) -> tuple[int, int]:
        return place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset)

    decls, rels, shadowed, blanks = [], [], set(), []

    def visit(n, scope: tuple, method: bool):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a, b = span(n)
            kind = "Class" if isinstance(n, ast.ClassDef) else "Function"
            args = None if kind == "Class" else n.args
            count = None if args is None else len(args.posonlyargs + args.args + args.kwonlyargs) + bool(args.vararg) + bool(args.kwarg)
            decls.append(Decl("class_definition" if kind == "Class" else "function_definition", kind, n.name, a, b, scope, count, method))
            if args is not None:
                shadowed.update(x.arg for x in args.posonlyargs + args.args + args.kwonlyargs)
            scope, method = (*scope, n.name), method or kind == "Class"
        elif isinstance(n, ast.Call):
            a, b = span(n)
            rels.append(Rel("Call", label(ast.get_source_segment(text, n.func) or ""), a, b))
        elif isinstance(n, ast.Attribute):
            a, b = span(n)
            rels.append(Rel("Property", label(ast.get_source_segment(text, n) or ""), a, b))
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            a, b = span(n)
            module = "." * n.level + (n.module or "") if isinstance(n, ast.ImportFrom) else None
            rels.append(Rel("Import", label(text[a:b]), a, b, bindings=[x.asname or x.name for x in n.names]))
            if module and not module.startswith("."):
                rels[-1].module = module
        elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
            shadowed.add(n.id)
        elif isinstance(n, (ast.Constant, ast.JoinedStr)) and (isinstance(n, ast.JoinedStr) or isinstance(n.value, (str, bytes))):
            blanks.append(span(n))
        for note in [getattr(n, "returns", None), getattr(n, "annotation", None)]:
            if note is not None:
                rels.append(Rel("TypeReference", label(ast.get_source_segment(text, note) or ""), *span(note)))
        for child in ast.iter_child_nodes(n):
            visit(child, scope, method)

    import sys

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 10_000))
    try:
        visit(tree, (), False)
    except RecursionError:
        fail("ResourceLimitExceeded", "syntax depth")
    finally:
        sys.setrecursionlimit(before)
    clean = list(text)
    for a, b in blanks:
        for k in range(a, b):
            if clean[k] not in "\r\n":
                clean[k] = " "
    clean = re.sub(r"(?<!\w)#[^\n]*", _space, "".join(clean))
    decls.sort(key=lambda d: (d.start, -d.end))
    return decls, sorted(rels, key=lambda r: (r.start, -r.end)), shadowed, clean


# ---- units


class _Embedded(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.scripts, self.tags, self.inside = [], [], False

    def handle_starttag(self, tag, attrs):
        row, col = self.getpos()
        name = re.match(r"<\s*([\w.-]+)", self.get_starttag_text() or "")
        self.tags.append((row, col + 1, name[1] if name else tag))
        self.inside = tag == "script"

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "script"

    def handle_data(self, data):
        if self.inside and data.strip():
            self.scripts.append((*self.getpos(), data))


_FAMILY = {"javascript": "script", "tsx": "script", "typescript": "script"}


def _unit(text: str, language: str, path: str) -> tuple[list[Decl], list[Rel], set[str], str]:
    if language in ("python", "starlark"):
        return _python(text, path)
    family = _FAMILY.get(language, language)
    clean = blank(text, BLANKS[family])
    if family in ("script", "rust", "php", "nix", "powershell") and re.search(r'"', clean):
        fail("ParseFailure", path)
    if family == "make":
        found = []
        for m in re.finditer(r"(?m)^(?P<n>[^\s:=#][^:=#\n]*?)\s*:(?!=)[^\n]*(?:\n\t[^\n]*)*", clean):
            found.append(Decl("rule", "BuildRule", label(m["n"]), m.start(), m.end()))
        return found, [], set(), clean
    ends = _closed(clean if family != "bash" else re.sub(r"(?m)^[^\n]*\)(?=[^\n]*;;)|\$\(\(|\)\)", _space, clean), path)
    if family == "nix":
        found = []
        for m in re.finditer(r"(?<![\w.'=!<>])(?P<n>[A-Za-z_][\w.'-]*)\s*=(?!=)", clean):
            stop = m.end()
            while stop < len(clean) and clean[stop] != ";":
                stop = ends.get(stop, stop + 1)
            found.append(Decl("binding", "Binding", m["n"], m.start("n"), min(len(clean), stop + 1)))
        found = _scoped(sorted(found, key=lambda d: (d.start, -d.end)))
        return found, _relations(clean, text, family, found), set(), clean
    found = _declarations(clean, family, ends)
    if family == "php":
        for d in found:
            inside = any(o.node in _TYPE_CONTEXT and o.start < d.start and d.end <= o.end for o in found)
            if d.node == "function_definition" and inside:
                d.node, d.kind = "method_declaration", "Method"
    found = _scoped(found)
    if family == "rust":
        _rust_attributes(clean, text, found, ends)
    relations = _relations(clean, text, family, found)
    return found, relations, _shadowed(clean, family, found, ends), clean


def analyze(language: str, path: str, raw: bytes, file_id: str, owner: str, limits: Limits = Limits()) -> dict:
    """The analysis of one file: symbols, edges (in order; an edge's id holds its ordinal), types, and what is known of it."""
    text = raw.decode()
    if language in STRUCTURED:
        return _structured(language, path, raw, text, file_id, owner, limits)
    units, edges = [(0, text, language)], []
    if language in ("html", "vue"):
        page = _Embedded()
        page.feed(text)
        starts = [0] + [m.end() for m in re.finditer("\n", text)]
        units = [(starts[r - 1] + c, code, "typescript" if language == "vue" else "javascript") for r, c, code in page.scripts]
        for row, col, tag in page.tags:
            if tag[:1].isupper():
                at = len(text[: starts[row - 1] + col].encode())
                edges.append(dict(kind="Component", source=file_id, name=tag, start=at, resolution="Unresolved", targets=[], syntax_digest=None, shadowed=False))
    symbols, types, seen = [], {}, {}
    rest = ["\n" if c == "\n" else " " for c in text]
    notes = _MISSING.get(language, [])
    for offset, code, lang in units:
        found, relations, shadowed, clean = _unit(code, lang, path if offset == 0 else f"{path}:script")
        if len(found) + len(relations) > limits.ast_nodes:
            fail("ResourceLimitExceeded", "syntax nodes")
        clean = _LONG_NUMBER.sub(_space, clean)
        rest[offset : offset + len(code)] = clean
        byte = _byte_places(text, offset)
        spans = []
        for d in found:
            qualified = "::".join([*d.scope, d.name])
            nth = seen[d.node, qualified] = seen.get((d.node, qualified), -1) + 1
            identity = SymbolRef.of(file_id, d.node, qualified, nth).value
            body = hashlib.sha256(code[d.start : d.end].encode()).hexdigest()
            symbols.append(dict(
                id=identity, file=file_id, owner=owner, name=label(d.name), qualified=qualified,
                kind="Method" if d.method and d.kind == "Function" else d.kind, start=byte(offset + d.start), end=byte(offset + d.end),
                line=text.count("\n", 0, offset + d.start) + 1, body_digest=body, source=clean[d.start : d.end], attributes=d.attributes,
                parameter_count=d.parameters, cfg=d.cfg, resolution="PartiallyResolved",
                missing=["compiler_type_resolution", "dynamic_dispatch", *notes],
            ))
            spans.append((d.start, d.end, identity))
            edges.append(dict(kind="Declaration", source=file_id, name=label(d.name), start=byte(offset + d.start), resolution="Resolved", targets=[identity], syntax_digest=body, shadowed=False))
        for a, b, _ in spans:
            rest[offset + a : offset + b] = ["\n" if c == "\n" else " " for c in code[a:b]]
        inside = _innermost(spans, file_id)
        for r in relations:
            edge = dict(
                kind=r.kind, source=inside(r.start, r.end), name=r.name or "<dynamic>", start=byte(offset + r.start), resolution="Unresolved", targets=[],
                syntax_digest=hashlib.sha256(code[r.start : r.end].encode()).hexdigest(), shadowed=r.name in shadowed, module=r.module,
                bindings=r.bindings, type_only=r.type_only, aliases=r.aliases,
            )
            if r.kind == "TypeReference":
                identity = TypeRef.of(file_id, r.name).value
                types[identity] = dict(id=identity, file=file_id, name=r.name, owner=owner, resolution="Declared", digest=digest([r.name, file_id]))
                edge |= dict(resolution="Resolved", targets=[identity])
            edges.append(edge)
    return dict(
        symbols=symbols, edges=edges, types=list(types.values()), coverage="PartiallyResolved", module_source="".join(rest),
        syntax_units=len(units), missing=["compiler_type_resolution", "dynamic_dispatch", "macro_expansion", *notes],
    )


def _byte_places(text: str, start: int):
    if text.isascii():
        return lambda k: k
    places = [0]
    for c in text:
        places.append(places[-1] + len(c.encode()))
    return places.__getitem__


def _innermost(spans, outer):
    """Who holds a range: one sweep over nested spans, sorted by start."""

    def find(a: int, b: int) -> str:
        best = None
        for s, e, who in spans:
            if s > a:
                break
            if b <= e and (best is None or e - s < best[0]):
                best = (e - s, who)
        return best[1] if best else outer

    return find


def _structured(language: str, path: str, raw: bytes, text: str, file_id: str, owner: str, limits: Limits) -> dict:
    """Top-level names only; values never leave the file."""
    try:
        names = _KEYS[language](text)
    except (ValueError, configparser.Error):
        fail("ParseFailure", path)
    if len(names) > limits.symbols:
        fail("ResourceLimitExceeded", "declarations")
    whole = hashlib.sha256(raw).hexdigest()
    symbols = []
    for k, n in enumerate(names):
        name = n if _SAFE_KEY.fullmatch(n) else "<key>"
        symbols.append(dict(
            id=SymbolRef.of(file_id, name, k).value, file=file_id, owner=owner, name=name, qualified=name, kind="DataDeclaration", start=0, end=0,
            line=1, body_digest=whole, source="", attributes=[], parameter_count=None, cfg=[], resolution="PartiallyResolved", missing=["runtime_semantics"],
        ))
    return dict(symbols=symbols, edges=[], types=[], coverage="STRUCTURED_FILE_ADAPTER", module_source="", syntax_units=0, missing=["runtime_semantics"])


def _object_keys(value) -> list[str]:
    return sorted(value) if isinstance(value, dict) else ["<array>"]


def _ini(text: str) -> list[str]:
    parser = configparser.ConfigParser(strict=False, interpolation=None)
    parser.optionxform = str
    parser.read_string(text)
    return [f"{s}:{k}" for s in parser.sections() for k in parser[s]]


def _sql(text: str) -> list[str]:
    clean = blank(text, _rules(r"--[^\n]*", _BLOCK, r"'(?:''|[^'])*'", r"\$(\w*)\$.*?\$\1\$"))
    parts = [p.split() for p in clean.split(";") if p.strip()]
    known = set("ALTER CREATE DELETE DROP INSERT MERGE REPLACE SELECT UPDATE WITH".split())
    return [f"statement:{k}:{w[0].upper() if w[0].upper() in known else 'UNKNOWN'}" for k, w in enumerate(parts)]


def _css(text: str) -> list[str]:
    clean = blank(text, _rules(_BLOCK, _DQ, _SQ))
    _closed(clean, "css")
    out, depth, start = [], 0, None
    for k, c in enumerate(clean):
        if start is None and not c.isspace():
            start = k
        depth += (c == "{") - (c == "}")
        if start is not None and depth == 0 and (c == "}" or c == ";" and clean[start] == "@"):
            kind = "at-rule" if clean[start] == "@" else "qualified-rule"
            out.append(f"{kind}:{clean.count(chr(10), 0, start) + 1}:{start - clean.rfind(chr(10), 0, start)}")
            start = None
    if start is not None:
        raise ValueError("an open rule")
    return out


def _yaml(text: str) -> list[str]:
    if re.search(r"(?m)^\t+\S", text):
        raise ValueError("tabs indent")
    out = []
    for line in blank(text, _rules(r"(?m)(?:^|(?<=\s))#[^\n]*")).splitlines():
        m = re.match(r"(?P<k>[^\s:#\-\[\]{},&*!|>'\"%@`][^:#]*?|\"[^\"]*\"|'[^']*')\s*:(?:\s|$)", line)
        if m:
            out.append(label(m["k"].strip("\"'")))
    return out


_KEYS = {
    "css": _css, "ini": _ini, "sql": _sql, "yaml": _yaml,
    "json": lambda t: _object_keys(json.loads(t)), "toml": lambda t: _object_keys(tomllib.loads(t)),
}
