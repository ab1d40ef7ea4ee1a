"""Content-free observations of folders, workbooks and configured resources."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
from collections import Counter
from pathlib import Path, PurePosixPath
from xml.etree import ElementTree
from zipfile import BadZipFile, ZipFile

SCHEMA_VERSION = "0.10.0"
FILE_BYTES = 64 << 20
_TIGHT = (",", ":")
_OOXML = "http://schemas.openxmlformats.org"
_SHEET_NS = f"{{{_OOXML}/spreadsheetml/2006/main}}"
_LINK_NS = f"{{{_OOXML}/officeDocument/2006/relationships}}"


class ObservationError(ValueError):
    """A refusal: its code, and a sentence."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


def _need(ok, code: str, detail: str) -> None:
    if not ok:
        raise ObservationError(code, detail)


def _sealed(body: dict) -> dict:
    text = json.dumps(body, sort_keys=True, ensure_ascii=False, separators=_TIGHT)
    return body | {"observation_digest_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _hash_of(path: Path, most: int) -> str:
    _need(path.stat().st_size <= most, "source-too-large", f"over {most} bytes")
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _place(root, source) -> tuple[Path, str]:
    top, below = Path(root), Path(source)
    _need(top.is_absolute() and top.is_dir(), "invalid-root", "an absolute directory is needed")
    _need(not below.is_absolute() and ".." not in below.parts, "source-outside-root", "a relative path below the root is needed")
    real = top.resolve(strict=True)
    step = real
    for name in below.parts:
        step = step / name
        _need(os.path.lexists(step), "source-not-found", "there is no such source")
        _need(not step.is_symlink(), "symbolic-link-rejected", "links are not observed")
    found = step.resolve(strict=True)
    _need(found.is_relative_to(real), "source-outside-root", "the source lies outside the root")
    return found, found.relative_to(real).as_posix()


def _entry(path: Path, most: int) -> tuple[str, int, str | None]:
    info = path.lstat()
    if stat.S_ISREG(info.st_mode):
        return "file", info.st_size, _hash_of(path, most) if info.st_size <= most else None
    kind = "symbolic_link_rejected" if stat.S_ISLNK(info.st_mode) else "directory" if stat.S_ISDIR(info.st_mode) else "special_file_rejected"
    return kind, 0, None


def _fine_name(name: str) -> bool:
    return 0 < len(name) <= 128 and name not in (".", "..") and not re.search(r"[/\\\x00-\x1f\x7f]", name)


def observe_folder(root, source, *, maximum_entries=4096, maximum_file_bytes=FILE_BYTES, include_entry_paths=False, excluded_directory_names=()) -> dict:
    """Kinds, sizes and hashes of what a folder holds; never content, and names only on request."""
    _need(0 < maximum_entries < 1 << 16, "invalid-limit", "1 to 65535 entries")
    skip = set(excluded_directory_names)
    _need(len(skip) == len(excluded_directory_names) <= 32 and all(map(_fine_name, skip)), "invalid-exclusion", "32 distinct path components at most")
    folder, where = _place(root, source)
    _need(folder.is_dir(), "source-not-directory", "a folder is needed")
    entries, skipped = [], 0
    for here, dirs, files in os.walk(folder):
        skipped += len(skip.intersection(dirs))
        dirs[:] = sorted(set(dirs) - skip)
        for name in [*dirs, *sorted(files)]:
            path = Path(here, name)
            kind, size, sha = _entry(path, maximum_file_bytes)
            rel = path.relative_to(folder).as_posix()
            entry = dict(path_digest_sha256=hashlib.sha256(rel.encode()).hexdigest(), kind=kind, size_bytes=size, content_digest_sha256=sha)
            entries.append(entry | ({"relative_path": rel} if include_entry_paths else {}))
            _need(len(entries) <= maximum_entries, "entry-limit-exceeded", f"over {maximum_entries} entries")
        dirs[:] = [d for d in dirs if not os.path.islink(os.path.join(here, d))]
    kinds = Counter(e["kind"] for e in entries)
    return _sealed(dict(
        kind="source/folder/observation", schema_version=SCHEMA_VERSION, source_ref=where, entries=entries, entry_count=len(entries),
        entry_kinds={k: kinds[k] for k in sorted(kinds)}, total_regular_file_bytes=sum(e["size_bytes"] for e in entries),
        excluded_directory_names=sorted(skip), excluded_directory_count=skipped, content_included=False,
    ))


def column_number(reference: str) -> int | None:
    """Base 26: A is 1, AZ 52; None if the reference is none."""
    hit = re.fullmatch(r"[$]?([A-Z]+)[$]?[1-9]\d*", reference.upper())
    if not hit:
        return None
    n = 0
    for c in hit[1]:
        n = n * 26 + (ord(c) & 31)
    return n


class _Book:
    def __init__(self, archive: ZipFile, most: int):
        self.archive, self.most = archive, most

    def part(self, name: str) -> ElementTree.Element:
        _need(name in self.archive.namelist(), "missing-workbook-part", name)
        with self.archive.open(name) as f:
            raw = f.read(self.most + 1)
        _need(len(raw) <= self.most, "workbook-part-too-large", name)
        head = raw[:4096].upper()
        _need(b"<!ENTITY" not in head and b"<!DOCTYPE" not in head, "unsafe-xml", name)
        try:
            return ElementTree.fromstring(raw)
        except ElementTree.ParseError:
            raise ObservationError("invalid-workbook-xml", name) from None


def observe_workbook(
    root, source, *, maximum_file_bytes=FILE_BYTES, maximum_members=2048, maximum_uncompressed_bytes=128 << 20, maximum_sheets=1024,
    maximum_rows=1 << 20, maximum_columns=1 << 14, include_labels=False,
) -> dict:
    """Counts of a workbook's sheets, rows, cells and formulas; no cell content, and labels only on request."""
    book, where = _place(root, source)
    _need(book.is_file(), "source-not-file", "a file is needed")
    _need(book.suffix.lower() in (".xlsm", ".xlsx"), "unsupported-workbook", "an .xlsx or .xlsm file is needed")
    sha = _hash_of(book, maximum_file_bytes)
    try:
        archive = ZipFile(book)
    except (OSError, BadZipFile):
        raise ObservationError("invalid-workbook", "not a workbook") from None
    with archive:
        members = archive.infolist()
        _need(len(members) <= maximum_members, "member-limit-exceeded", f"over {maximum_members} members")
        unsafe = lambda name: name.startswith("/") or ".." in PurePosixPath(name).parts
        _need(not any(unsafe(m.filename) for m in members), "unsafe-archive-path", "a member's path leaves the archive")
        _need(sum(m.file_size for m in members) <= maximum_uncompressed_bytes, "workbook-too-large", "uncompressed size")
        parts = _Book(archive, maximum_uncompressed_bytes)
        top = parts.part("xl/workbook.xml")
        links = {n.get("Id", ""): n.get("Target", "") for n in parts.part("xl/_rels/workbook.xml.rels")}
        sheets = []
        for node in top.iter(f"{_SHEET_NS}sheet"):
            target = links.get(node.get(f"{_LINK_NS}id", ""), "")
            _need(not unsafe(target), "unsafe-workbook-reference", "a sheet's target leaves the workbook")
            sheet = parts.part(str(PurePosixPath("xl", target)))
            rows, cells = (list(sheet.iter(_SHEET_NS + k)) for k in ("row", "c"))
            last_row = max((int(r.get("r")) for r in rows if (r.get("r") or "").isdigit()), default=0)
            last_column = max((column_number(c.get("r", "")) or 0 for c in cells), default=0)
            _need(last_row <= maximum_rows, "row-limit-exceeded", f"over {maximum_rows} rows")
            _need(last_column <= maximum_columns, "column-limit-exceeded", f"over {maximum_columns} columns")
            size = next(sheet.iter(f"{_SHEET_NS}dimension"), None)
            name = node.get("name", "")
            own = dict(
                sheet_ref=hashlib.sha256(name.encode()).hexdigest(), label_available=name != "", row_count=len(rows), cell_count=len(cells),
                formula_count=sum(1 for _ in sheet.iter(f"{_SHEET_NS}f")), dimension=None if size is None else size.get("ref"),
            )
            sheets.append(own | ({"label": name} if include_labels else {}))
        _need(len(sheets) <= maximum_sheets, "sheet-limit-exceeded", f"over {maximum_sheets} sheets")
        macros = "xl/vbaProject.bin" in archive.namelist()
    return _sealed(dict(
        kind="source/workbook/observation", schema_version=SCHEMA_VERSION, source_ref=where, source_digest_sha256=sha, format=book.suffix[1:].lower(),
        sheets=sheets, sheet_count=len(sheets), contains_macros=macros, formula_text_included=False, content_included=False,
    ))


def observe_resource(configuration, resource_ref: str) -> dict:
    """The observation of one resource of a configuration file, without the machine's paths."""
    bad = "invalid-configuration"
    path = Path(configuration)
    _need(path.is_absolute() and path.is_file(), bad, "an absolute file path is needed")
    _need(not path.is_symlink(), "symbolic-link-rejected", "the configuration is a link")
    _need(path.stat().st_size <= 1 << 16, "configuration-too-large", "over 64 KiB")
    try:
        document = json.loads(path.read_bytes())
    except (OSError, ValueError):
        raise ObservationError(bad, "not JSON in UTF-8") from None
    _need(isinstance(document, dict) and document.keys() == {"resources", "schema_version"}, bad, "unknown or missing fields")
    _need(document["schema_version"] == SCHEMA_VERSION and isinstance(document["resources"], list), bad, "unsupported schema")
    hits = [r for r in document["resources"] if isinstance(r, dict) and r.get("resource_ref") == resource_ref]
    _need(len(hits) == 1, "resource-not-selected", "exactly one resource must match")
    chosen, must = hits[0], {"root", "source", "kind", "resource_ref"}
    folder = chosen.get("kind") == "folder"
    may = {"excluded_directory_names", "maximum_entries"} if folder else set()
    _need(must <= chosen.keys() <= must | may and chosen["kind"] in ("workbook", "folder"), bad, "resource fields")
    _need(all(isinstance(chosen[k], str) for k in must), bad, "resource values")
    if chosen["kind"] == "folder":
        most, skip = chosen.get("maximum_entries", 4096), chosen.get("excluded_directory_names", [])
        _need(type(most) is int and isinstance(skip, list) and all(isinstance(s, str) for s in skip), bad, "folder bounds")
        seen = observe_folder(chosen["root"], chosen["source"], maximum_entries=most, excluded_directory_names=tuple(skip))
    else:
        seen = observe_workbook(chosen["root"], chosen["source"])
    inner = seen.pop("observation_digest_sha256")
    del seen["source_ref"]
    return _sealed(seen | {"resource_ref": resource_ref, "source_observation_digest_sha256": inner})
