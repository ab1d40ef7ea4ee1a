"""Immutable snapshots of the graph tables, and the pointer that publishes one.

A snapshot is a directory of Parquet tables and a manifest, never changed once published. The pointer
names the current one; publishing takes a lock, compares the digest that the build started from, and
renames a new pointer into place. Readers keep the snapshot that they opened. The lock and the rename
are those of a POSIX file system.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import FORMAT, canonical, digest, fail
from .operators import digests, joins
from .schemas import TABLES

POINTER, MANIFEST = "_CURRENT", "manifest.json"
#: What the digest leaves out of the manifest.
UNSEALED = ("digest", "measurements")


def pin(path) -> Path:
    """The snapshot that path publishes now."""
    pointer = Path(path, POINTER)
    if not pointer.is_file() or pointer.is_symlink():
        fail("MissingIndex", str(path))
    name = pointer.read_text().strip()
    at = Path(path, name)
    if "/" in name or not at.is_dir():
        fail("CorruptIndex", "the pointer names no snapshot")
    return at


def read_manifest(at: Path) -> dict:
    try:
        manifest = json.loads((at / MANIFEST).read_text())
    except (OSError, ValueError):
        fail("CorruptIndex", "manifest")
    if manifest.get("format") != FORMAT:
        fail("CorruptIndex", "format")
    return manifest


def tables(spark: SparkSession, at: Path) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{at}/{t}.parquet") for t in (*TABLES, "analysis", "edges_reverse")}


def seal(frames: dict[str, DataFrame], manifest: dict) -> str:
    """The state's digest: two levels of hashes for each table (buckets by the ids' first byte), then the
    tables' roots and the manifest."""
    roots = {}
    for t in TABLES:
        cols = sorted(frames[t].columns)
        row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
        found = digests.state_root(frames[t], row, F.substring("id", 1, 2)).first()
        roots[t] = found and found["root"]
    return digest([roots, {k: v for k, v in manifest.items() if k not in UNSEALED}])


def validate(frames: dict[str, DataFrame]) -> None:
    """Every end of every row is there."""
    symbols, files, types, edges = (frames[t] for t in ("symbols", "files", "types", "edges"))
    ends = symbols.select("id").unionByName(files.select("id")).unionByName(types.select("id"))
    checks = {
        "a symbol's file is missing": joins.orphans(symbols, "file", files, "id"),
        "a type's file is missing": joins.orphans(types, "file", files, "id"),
        "an edge's source is missing": joins.orphans(edges, "source", ends, "id"),
        "an edge's target is missing": joins.orphans(edges, "target", ends, "id"),
        "a resolved edge has no target": edges.filter("resolution = 'Resolved' AND target IS NULL"),
        "a file's package is missing": joins.orphans(files, "owner", frames["packages"], "id"),
        "an effect's symbol is missing": joins.orphans(frames["effects"], "source", symbols, "id"),
    }
    found = None
    for why, rows in checks.items():
        one = rows.limit(1).select(F.lit(why).alias("why"))
        found = one if found is None else found.unionByName(one)
    bad = found.limit(1).collect()
    if bad:
        fail("CorruptIndex", bad[0]["why"])


def stage(path: Path) -> Path:
    path.mkdir(parents=True, exist_ok=True)
    at = path / f"snap-{uuid.uuid4().hex}"
    at.mkdir()
    return at


def write(frames: dict[str, DataFrame], at: Path) -> None:
    """Edges twice: by source and by target, each in ranges of that key, so that a lookup prunes row groups."""
    for t, df in frames.items():
        if t == "edges":
            df.repartitionByRange("source").sortWithinPartitions("source", "kind", "id").write.parquet(f"{at}/edges.parquet")
        elif t == "symbols":
            df.repartitionByRange("name").sortWithinPartitions("name", "file").write.parquet(f"{at}/symbols.parquet")
        else:
            df.write.parquet(f"{at}/{t}.parquet")
    spark = frames["edges"].sparkSession
    edges = spark.read.parquet(f"{at}/edges.parquet")
    edges.repartitionByRange("target").sortWithinPartitions("target", "kind", "id").write.parquet(f"{at}/edges_reverse.parquet")


def publish(path: Path, at: Path, manifest: dict, expected: str | None) -> None:
    """Point path at a snapshot, if it still shows the digest that the build started from."""
    (at / MANIFEST).write_text(canonical(manifest))
    with open(path / ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        current = read_manifest(pin(path))["digest"] if (path / POINTER).exists() else None
        if current != expected:
            fail("PublicationConflict", "another build was published meanwhile")
        fresh = path / f"{POINTER}.{uuid.uuid4().hex}"
        with open(fresh, "w") as f:
            f.write(at.name)
            f.flush()
            os.fsync(f.fileno())
        os.replace(fresh, path / POINTER)
        held = os.open(path, os.O_DIRECTORY)
        try:
            os.fsync(held)
        finally:
            os.close(held)


def discard(at: Path) -> None:
    shutil.rmtree(at, ignore_errors=True)
