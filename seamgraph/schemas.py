"""Table schemas of a snapshot."""

from __future__ import annotations

SYMBOL = (
    "id string, file string, owner string, name string, qualified string, kind string, start int, `end` int, line int, body_digest string, "
    "source string, attributes array<string>, parameter_count int, cfg array<string>, resolution string, missing array<string>"
)
TYPE = "id string, file string, name string, owner string, resolution string, digest string"
RAW_EDGE = (
    "kind string, source string, name string, start int, resolution string, targets array<string>, syntax_digest string, shadowed boolean, "
    "module string, bindings array<string>, type_only boolean, aliases array<struct<name:string,local:string>>, candidates array<string>"
)


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{c.split()[0]}:{c.split(None, 1)[1]}" for c in ddl.split(", ")) + ">"


#: One row per file: what its adapter found, kept so that an unchanged file is not parsed again.
ANALYSIS = (
    "id string, path string, language string, owner string, digest string, adapter string, module_source string, coverage string, "
    f"syntax_units int, missing array<string>, symbols array<{_struct(SYMBOL)}>, types array<{_struct(TYPE)}>, relations array<{_struct(RAW_EDGE)}>"
)
TABLES = ("packages", "files", "types", "symbols", "effects", "edges")
