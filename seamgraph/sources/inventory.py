"""Source trees: bounded inventory, guarded reads, ownership boundaries, and a data source over them.

Links are never followed: every directory on a file's way is opened by itself, relative to the one before.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import tomllib
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import Limits, RepositoryRef, fail

_SUFFIXES = """
bash: sh; css: css; documentation: md; html: html; ini: service timer; javascript: js jsx mjs cjs; json: json
nix: nix; php: php; powershell: ps1; python: py; rust: rs; sql: sql; starlark: bazel bzl; toml: toml; tsx: tsx
typescript: ts mts cts; vue: vue; yaml: yaml yml
"""
BY_SUFFIX = {f".{s}": k.strip() for line in _SUFFIXES.replace("\n", ";").split(";") if line.strip() for k, v in [line.split(":")] for s in v.split()}
BY_NAME = dict.fromkeys(("GNUmakefile", "Makefile"), "make") | {"Cargo.lock": "toml"}
SKIPPED = set("node_modules vendor dist build target protocol-snapshot __pycache__ .output .nuxt .venv .artifacts .git".split())
MANIFESTS = ("pyproject.toml", "package.json", "Cargo.toml")
_SHEBANG = re.compile(rb"#!(?:/bin/(?P<a>bash|sh)|/usr/bin/env (?P<b>bash|sh)|/usr/bin/(?:env )?(?P<c>python3))$")


def real_directory(path) -> Path:
    """The absolute path, if each step of it is a directory and no link."""
    whole = Path(os.path.abspath(path))
    for step in (*reversed(whole.parents), whole):
        try:
            plain = stat.S_ISDIR(os.lstat(step).st_mode)
        except FileNotFoundError:
            plain = False
        if not plain:
            fail("UnsafePath", f"not a plain directory: {step.name or step}")
    return whole


def read_guarded(root, relative: str, most: int) -> bytes:
    """A regular file's bytes: no links on the way, no more than `most`, unchanged while read."""
    parts = PurePosixPath(relative).parts
    if not parts or relative.startswith("/") or {"..", "."} & set(parts):
        fail("UnsafePath", "a plain relative path is needed")
    open_dirs = []
    try:
        at = os.open(real_directory(root), os.O_DIRECTORY | os.O_NOFOLLOW)
        open_dirs.append(at)
        for name in parts[:-1]:
            at = os.open(name, os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
            open_dirs.append(at)
        with open(os.open(parts[-1], os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=at), "rb") as f:
            first = os.fstat(f.fileno())
            if not stat.S_ISREG(first.st_mode):
                fail("UnsafePath", "only regular files are read")
            raw = f.read(most + 1)
            if len(raw) > most:
                fail("ResourceLimitExceeded", "file bytes")
            same = lambda s: (s.st_ino, s.st_dev, s.st_size, s.st_mtime_ns, s.st_ctime_ns)
            if same(os.fstat(f.fileno())) != same(first):
                fail("SourceChangedDuringAnalysis", relative)
            return raw
    except OSError as why:
        fail("UnsafePath", f"can't be opened: {why.strerror}")
    finally:
        for d in reversed(open_dirs):
            os.close(d)


def language_of(root, relative: str, mode: int, most: int) -> str | None:
    """By name, else suffix, else for executables without one the first line."""
    name = PurePosixPath(relative).name
    known = BY_NAME.get(name) or BY_SUFFIX.get(PurePosixPath(relative).suffix)
    if known or PurePosixPath(relative).suffix or not mode & 0o111:
        return known
    hit = _SHEBANG.match(read_guarded(root, relative, most).partition(b"\n")[0])
    return hit and ("python" if hit["c"] else "bash")


def language_column(path: Column, first_line: Column | None = None) -> Column:
    """language_of over a column of paths, for tables of files: by name, else suffix, else, where there is none, the first
    line of an executable (null for others); null if nothing knows it."""

    def of(table: dict[str, str], key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)

    name = F.regexp_extract(path, r"([^/]*)/?$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    known = F.coalesce(of(BY_NAME, name), of(BY_SUFFIX, suffix))
    if first_line is None:
        return known
    shell = F.regexp_like(first_line, F.lit("^#!(?:/bin/|/usr/bin/env )(?:bash|sh)$"))
    snake = F.regexp_like(first_line, F.lit("^#!/usr/bin/(?:env )?python3$"))
    return F.coalesce(known, F.when(suffix == "", F.when(shell, "bash").when(snake, "python")))


def inventory(root, limits: Limits = Limits()) -> tuple[list[tuple[str, str]], list[dict]]:
    """(path, language) of every file to analyse, in order, and what was refused on the way."""
    limits.check()
    top = real_directory(root)
    files, refused, total = [], [], 0

    def unreadable(why):
        fail("UnsafePath", f"unreadable directory: {why.strerror}")

    for here, dirs, names in os.walk(top, onerror=unreadable):
        rel = lambda n: Path(here, n).relative_to(top).as_posix()
        wanted = sorted(d for d in dirs if d not in SKIPPED and not d.endswith(".egg-info"))
        links = [d for d in wanted if os.path.islink(os.path.join(here, d))]
        refused += [{"path": rel(d), "code": "UnsafePath"} for d in links]
        dirs[:] = [d for d in wanted if d not in links]
        for name in sorted(names):
            if limits.files <= len(refused) + len(files):
                fail("ResourceLimitExceeded", "inventory entries")
            info = os.lstat(os.path.join(here, name))
            if not stat.S_ISREG(info.st_mode):
                refused.append({"path": rel(name), "code": "UnsafePath"})
                continue
            language = language_of(top, rel(name), info.st_mode, limits.file_bytes)
            if language is None:
                refused.append({"path": rel(name), "code": "UnsupportedLanguage"})
            elif language != "documentation":
                total += info.st_size
                if info.st_size > limits.file_bytes or total > limits.repository_bytes:
                    fail("ResourceLimitExceeded", "source bytes")
                files.append((rel(name), language))
    return sorted(files), refused


def observe(root, path: str, limits: Limits) -> tuple[bytes, str]:
    raw = read_guarded(root, path, limits.file_bytes)
    try:
        raw.decode()
    except UnicodeDecodeError:
        fail("ParseFailure", f"not UTF-8: {path}")
    return raw, hashlib.sha256(raw).hexdigest()


def boundaries(root, paths: list[str], identity: str) -> dict[str, str]:
    """Directory -> RepositoryRef for the root and each directory that a .git entry or a repository.toml marks."""
    out = {".": RepositoryRef.of(identity).value}
    for d in sorted({p.as_posix() for x in paths for p in PurePosixPath(x).parents} - {"."}):
        modes = {}
        for marker in ("repository.toml", ".git"):
            try:
                modes[marker] = os.lstat(Path(root, d, marker)).st_mode
            except FileNotFoundError:
                continue
        if any(stat.S_ISREG(m) for m in modes.values()) or stat.S_ISDIR(modes.get(".git", 0)):
            out[d] = RepositoryRef.of(identity, d).value
    return out


def manifests(root, paths: list[tuple[str, str]], limits: Limits) -> dict[str, str]:
    """Manifest path -> declared package name."""
    out = {}
    for path, language in paths:
        if PurePosixPath(path).name not in MANIFESTS:
            continue
        raw, _ = observe(root, path, limits)
        try:
            read = {"json": json.loads, "toml": tomllib.loads}[language]
            top = read(raw.decode())
        except ValueError:
            fail("ParseFailure", path)
        own = top if language == "json" else top.get("package") or top.get("project") or {}
        name = own.get("name", "<workspace>") if isinstance(own, dict) else None
        if type(name) is not str or re.fullmatch(r"[-\w@/<>.]{1,200}", name) is None:
            fail("InvalidEvidence", f"package name in {path}")
        out[path] = name
    return out


class _Part(InputPartition):
    def __init__(self, paths):
        super().__init__(0)
        self.paths = paths


class InventorySource(DataSource):
    """spark.read.format("source_tree").option("root", ...): path, language, digest, content. Files are dealt
    into partitions of about `partitionBytes`; the root must be readable at the same place everywhere."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, language string, digest string, content binary"

    def reader(self, schema):
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.limits = Limits(**json.loads(options.get("limits", "{}")))
        self.most = int(options.get("partitionBytes", 8 << 20))

    def partitions(self):
        parts, own, size = [], [], 0
        for path, language in inventory(self.root, self.limits)[0]:
            own.append((path, language))
            size += os.path.getsize(os.path.join(self.root, path))
            if size >= self.most:
                parts.append(_Part(own))
                own, size = [], 0
        return parts + ([_Part(own)] if own or not parts else [])

    def read(self, partition):
        for path, language in partition.paths:
            raw, sha = observe(self.root, path, self.limits)
            yield path, language, sha, raw


def source_tree(spark: SparkSession, root, limits: Limits = Limits()) -> DataFrame:
    import dataclasses

    spark.dataSource.register(InventorySource)
    return spark.read.format("source_tree").option("root", str(root)).option("limits", json.dumps(dataclasses.asdict(limits))).load()
