import pytest

from seamgraph.model import EvidenceError
from seamgraph.sources.adapters import analyze

CASES = {
    "typescript": ("export class A { go(x: number) { return other('hunter2'); } }\n", ["A", "A::go"]),
    "vue": ("<template><Top/></template><script>function one() { two('hunter2') }</script>", ["one"]),
    "python": ("def f(a):\n    '''hunter2'''\n    return g(a)\n", ["f"]),
    "bash": ("run() {\n  echo 'hunter2'\n}\n", ["run"]),
    "rust": ('fn f() { println!("hunter2"); }\n', ["f"]),
    "sql": ("select 'hunter2'; create table t(a int)", ["statement:0:SELECT", "statement:1:CREATE"]),
    "starlark": ('cc_library(name = "hunter2")\ndef macro(name):\n    pass\n', ["macro"]),
    "html": ("<script>function inner() { var a = 'hunter2' }</script>", ["inner"]),
    "nix": ('{ hello = "hunter2"; }', ["hello"]),
    "make": ("all: one\n\ttrue # hunter2\n", ["all"]),
    "powershell": ('function Get-It { Write-Host "hunter2" }', ["Get-It"]),
    "ini": ("[Unit]\nPass=hunter2\n", ["Unit:Pass"]),
    "json": ('{"key": "hunter2"}', ["key"]),
    "toml": ('key = "hunter2"', ["key"]),
    "yaml": ("top:\n  inner: hunter2\n", ["top"]),
    "css": ("@container x { .a { color: red } }\n.b { x: 'hunter2' }", ["at-rule:1:1", "qualified-rule:2:1"]),
    "php": ("<p>hunter2</p><?php\nnamespace A;\nclass C { function m() { return h('hunter2'); } }\n", ["A", "C", "C::m"]),
}


@pytest.mark.parametrize("language", CASES)
def test_names_are_found_and_literals_withheld(language):
    text, names = CASES[language]
    found = analyze(language, f"a.{language}", text.encode(), "F", "O")
    assert [s["qualified"] for s in found["symbols"]] == names
    assert "hunter2" not in repr([s["source"] for s in found["symbols"]] + [found["module_source"]] + [e["name"] for e in found["edges"]])


@pytest.mark.parametrize("language,text", [("rust", "fn f( {"), ("python", "def ("), ("json", "{"), ("typescript", "class A {"), ("yaml", "a:\n\tb: 1")])
def test_broken_sources_are_refused(language, text):
    with pytest.raises(EvidenceError) as e:
        analyze(language, "x", text.encode(), "F", "O")
    assert e.value.code == "ParseFailure"


def test_rust_attributes_and_shadows():
    text = "#[cfg(test)]\nmod t { fn inner() {} }\nfn empty() {}\nfn target() {}\nfn run(target: fn()) { target(); }\ninclude!(\"g.rs\");\n"
    found = analyze("rust", "src/lib.rs", text.encode(), "F", "O")
    by = {s["qualified"]: s for s in found["symbols"]}
    assert by["t::inner"]["cfg"] == ["#[cfg(test)]"] and by["t::inner"]["attributes"] and not by["empty"]["attributes"]
    assert by["empty"]["parameter_count"] == 0 and by["run"]["parameter_count"] == 1
    assert [e["shadowed"] for e in found["edges"] if e["kind"] == "Call"] == [True]
    assert [e["module"] for e in found["edges"] if e["kind"] == "Include"] == ["g.rs"]


def test_twice_declared_names_have_ids_of_their_own():
    found = analyze("vue", "a.vue", b"<script>function a() {}</script><script setup>function a() {}</script>", "F", "O")
    assert len({s["id"] for s in found["symbols"]}) == 2 and found["syntax_units"] == 2


def test_byte_offsets():
    found = analyze("rust", "a.rs", "// é漢\nfn f() {}\n".encode(), "F", "O")
    s = found["symbols"][0]
    assert "// é漢\nfn f() {}\n".encode()[s["start"] : s["end"]] == b"fn f() {}" and s["line"] == 2
