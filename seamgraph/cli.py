"""Command lines over the library: canonical JSON out, typed failures, exit code 2."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import observe as observations
from .index import RULE_KEYS, Index
from .model import EvidenceError, Limits, PacketLimits, SourceFileRef, SymbolRef, TypeRef, canonical, fail

REFS = {"file": SourceFileRef, "symbol": SymbolRef, "type": TypeRef}
#: command: positional words, then options; =n is a whole number's default, ! marks what must be given.
_COMMANDS = """
index create: index root --repository! --file-bytes={file} --repository-bytes={repository} --rules
index update: index --rules
index rebuild: index --rules
index status: index
index verify: index
inspect symbol: index subject
inspect file: index subject
inspect type: index subject
query symbols: index subject
query effects: index subject
query reads: index subject
query writes: index subject
query revision: index subject
query dependencies: index subject --subject-kind
query dependents: index subject --subject-kind
query owners: index subject --subject-kind
packet build: index subject --subject-kind --max-bytes={bytes} --depth={depth} --max-source-bytes={source} --continuation
diff: index previous --limit=128 --continuation
doctor: index
stats: index
"""


def _parser() -> argparse.ArgumentParser:
    defaults = dict(
        file=Limits.file_bytes, repository=Limits.repository_bytes, bytes=PacketLimits.max_bytes, depth=PacketLimits.max_depth,
        source=PacketLimits.max_source_bytes,
    )
    top = argparse.ArgumentParser(prog="seamgraph")
    commands, groups = top.add_subparsers(required=True, dest="command"), {}
    for line in _COMMANDS.format(**defaults).strip().splitlines():
        names, _, words = line.partition(":")
        group, *rest = names.split()
        if not rest:
            p = commands.add_parser(group)
        else:
            if group not in groups:
                groups[group] = commands.add_parser(group).add_subparsers(required=True, dest="operation")
            p = groups[group].add_parser(rest[0])
        for word in words.split():
            name, _, number = word.rstrip("!").partition("=")
            how = {"type": int, "default": int(number)} if number else {}
            if name == "--subject-kind":
                how = {"choices": [k for k in REFS if group == "query" or k != "type"], "default": "symbol"}
            elif word.endswith("!"):
                how = {"required": True}
            p.add_argument(name, **how)
    return top


def _cursor(text: str | None) -> dict | None:
    if not text:
        return None
    if len(text.encode()) > 1 << 16:
        fail("ResourceLimitExceeded", "continuation bytes")
    try:
        value = json.loads(text)
    except ValueError:
        value = None
    if not isinstance(value, dict):
        fail("InvalidEvidence", "a JSON object is needed")
    return value


def _rules(path: str | None) -> dict | None:
    if not path:
        return None
    with open(path, "rb") as f:
        raw = f.read((1 << 20) + 1)
    if len(raw) > 1 << 20:
        fail("ResourceLimitExceeded", "rule bytes")
    value = json.loads(raw)
    if not isinstance(value, dict) or not value.keys() <= RULE_KEYS:
        fail("InvalidEvidence", "rule keys")
    return value


def _answer(a: argparse.Namespace):
    cursor = _cursor(getattr(a, "continuation", None))
    rules = _rules(getattr(a, "rules", None))
    if a.command == "index" and a.operation == "create":
        limits = Limits(file_bytes=a.file_bytes, repository_bytes=a.repository_bytes)
        return Index.create(a.index, a.root, a.repository, limits, rules=rules).index_status()
    if a.command == "index" and a.operation in ("rebuild", "update"):
        return Index.update(a.index, rules=rules, rebuild=a.operation == "rebuild").index_status()
    index = Index.open_existing(a.index)
    ref = REFS[getattr(a, "subject_kind", "symbol")]
    if a.command == "index":
        return index.index_status()
    if a.command == "inspect":
        return index.inspect_file(a.subject) if a.operation == "file" else getattr(index, a.operation)(REFS[a.operation](a.subject))
    if a.command == "query":
        if a.operation == "symbols":
            return index.find_symbols(a.subject)
        name = "evidence_revision" if a.operation == "revision" else f"{a.operation}_of"
        return getattr(index, name)(ref(a.subject))
    if a.command == "packet":
        limits = PacketLimits(max_bytes=a.max_bytes, max_depth=a.depth, max_source_bytes=a.max_source_bytes)
        return index.build_packet(ref(a.subject), limits, cursor)
    if a.command == "diff":
        return index.diff(Index.open_existing(a.previous), a.limit, cursor)
    return {"findings": index.doctor()} if a.command == "doctor" else index.stats()


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        value = _answer(a)
    except EvidenceError as why:
        print(canonical(why.wire()))
        return 2
    except (KeyError, OSError, ValueError) as why:
        print(canonical({"error": "InternalFailure", "detail": type(why).__name__}))
        return 2
    print(canonical(value))
    return 2 if a.command == "doctor" and value["findings"] else 0


def observe_main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="seamgraph-observe")
    kinds = top.add_subparsers(dest="kind", required=True)
    flags = dict(
        resource={"--configuration": Path, "--resource-ref": str}, workbook={"--root": Path, "--source": Path}, folder={"--root": Path, "--source": Path}
    )
    for kind, needed in flags.items():
        p = kinds.add_parser(kind).add_subparsers(dest="operation", required=True).add_parser("observe")
        for flag, read in needed.items():
            p.add_argument(flag, required=True, type=read)
        if kind == "folder":
            for flag, how in {"--maximum-entries": dict(default=4096, type=int), "--exclude-directory": dict(default=[], action="append")}.items():
                p.add_argument(flag, **how)
        if kind != "resource":
            p.add_argument({"folder": "--include-entry-paths", "workbook": "--include-labels"}[kind], action="store_true")
    a = top.parse_args(argv)
    try:
        if a.kind == "folder":
            value = observations.observe_folder(
                a.root, a.source, maximum_entries=a.maximum_entries, include_entry_paths=a.include_entry_paths,
                excluded_directory_names=tuple(a.exclude_directory),
            )
        elif a.kind == "workbook":
            value = observations.observe_workbook(a.root, a.source, include_labels=a.include_labels)
        else:
            value = observations.observe_resource(a.configuration, a.resource_ref)
    except observations.ObservationError as why:
        body = dict(detail=why.detail, code=why.code, kind="source/observation/error", schema_version=observations.SCHEMA_VERSION)
        print(json.dumps(body, sort_keys=True), file=sys.stderr)
        return 2
    print(json.dumps(value, sort_keys=True, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
