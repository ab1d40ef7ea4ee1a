"""The index: builds, updates and answers bounded questions about a source tree's graph."""

from __future__ import annotations

import dataclasses
import posixpath
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packet as packets
from . import snapshot
from .functions.ship import ship
from .model import (
    FORMAT, VERSION, Effect, EvidenceRequest, Limits, PacketLimits, Ref, Relation, RepositoryRef, SourceFileRef, SymbolRef,
    TypeRef, canonical, digest, fail,
)
from .operators import graph, joins, paging
from .plans import build
from .sources import adapters
from .sources import inventory as trees

COMPILERS = ("typescript_compiler", "rust_compiler")
RULE_KEYS = {"effects", "version", *COMPILERS}
TABLE_OF = {TypeRef: "types", SymbolRef: "symbols", SourceFileRef: "files"}
LOCKS = ("package-lock.json", "pnpm-lock.yaml", "Cargo.lock")


def session() -> SparkSession:
    return ship(SparkSession.getActiveSession() or SparkSession.builder.appName("seamgraph").getOrCreate())


class Index:
    """A reader pinned to one published snapshot."""

    def __init__(self, path: Path, at: Path, spark: SparkSession):
        self.path, self.at, self.spark = path, at, spark
        self.meta = snapshot.read_manifest(at)
        self.limits = Limits(**self.meta["limits"])
        self.t = snapshot.tables(spark, at)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        """Nothing is held open: the snapshot stays readable."""

    # ---- building

    @classmethod
    def create(cls, path, root, repository: str, limits: Limits = Limits(), rules: dict | None = None, failpoint: str | None = None) -> "Index":
        path = Path(path)
        if path.exists():
            fail("PublicationConflict", "the path exists")
        return cls._build(None, path, tree=root, name=repository, limits=limits, rules=rules or {}, failpoint=failpoint)

    @classmethod
    def open_existing(cls, path, verify: bool = True) -> "Index":
        path = Path(path)
        out = cls(path, snapshot.pin(path), session())
        out.limits.check()
        if verify:
            out.verify()
        return out

    @classmethod
    def update(cls, path, rules: dict | None = None, failpoint: str | None = None, rebuild: bool = False) -> "Index":
        old = cls.open_existing(path)
        m = old.meta
        return cls._build(
            old, old.path, tree=m["root"], name=m["repository"], limits=old.limits, rules=m["rules"] if rules is None else rules, failpoint=failpoint, rebuild=rebuild
        )

    def verify(self) -> None:
        """The sealed digest and every reference hold."""
        try:
            if snapshot.seal(self.t, self.meta) != self.meta["digest"]:
                fail("CorruptIndex", "digest")
        except (OSError, ValueError) as why:
            fail("CorruptIndex", type(why).__name__)
        snapshot.validate(self.t)

    def validate(self) -> None:
        snapshot.validate(self.t)

    @classmethod
    def _build(cls, old, path, *, tree, name, limits, rules, failpoint=None, rebuild=False) -> "Index":
        spark, began = session(), time.monotonic()
        limits.check()
        if limits.parallel_parsers != 1 or limits.queue_depth != 1:
            fail("ResourceLimitExceeded", "the bounds on parsers are fixed at one")
        if not isinstance(name, str) or not 0 < len(name) <= 200:
            fail("InvalidEvidence", "repository identity")
        if not isinstance(rules, dict) or set(rules) - RULE_KEYS:
            fail("InvalidEvidence", "rule keys")
        for tool in COMPILERS:
            if rules.get(tool):
                fail("AnalyzerUnavailable", tool)

        def stop(at: str, code: str) -> None:
            if failpoint == at:
                fail(code, f"injected: {at}")

        root = trees.real_directory(tree)
        paths, findings = trees.inventory(root, limits)
        if any(f["code"] == "UnsafePath" for f in findings):
            fail("UnsafePath", "the tree holds links or special files")
        roots = trees.boundaries(root, [p for p, _ in paths], name)
        root_ref = RepositoryRef.of(name).value
        everything = build.places(paths, trees.manifests(root, paths, limits), roots, root_ref)
        live = {r["path"]: r["digest"] for r in trees.source_tree(spark, root, limits).select("path", "digest").collect()}
        same = cls._unchanged(old, everything, live) if old and not rebuild else set()
        incremental = bool(old) and not rebuild and not cls._other_analyzer(old)
        stop("parse", "ParseFailure")
        fresh = [p for p in everything if p.id not in same]
        staged = snapshot.stage(path)
        try:
            parsed = _typed(build.parse(spark, root, limits, fresh) if fresh else None, spark)
            if old and same:
                kept = spark.createDataFrame([(i,) for i in sorted(same)], "id string")
                parsed = parsed.unionByName(old.t["analysis"].join(kept, "id", "left_semi"))
            parsed.write.parquet(f"{staged}/analysis.parquet")
            analysis = spark.read.parquet(f"{staged}/analysis.parquet")
            n = analysis.agg(F.sum(F.size("symbols")), F.sum(F.size("relations"))).first()
            if (n[0] or 0) > limits.symbols or (n[1] or 0) > limits.edges:
                fail("ResourceLimitExceeded", "declarations or relations")
            stop("resolution", "ResolutionFailure")
            frames = {
                "files": build.files_of(analysis), "symbols": build.symbols_of(analysis), "types": build.types_of(analysis),
                "packages": build.packages_of(spark, everything),
            }
            resolved = len(everything)
            if incremental:
                gone = {r["id"]: r["owner"] for r in old.t["files"].select("id", "owner").collect()}
                moved = {p.owner for p in fresh} | {o for i, o in gone.items() if i not in same}
                seeds = {p.id for p in everything if p.owner in moved} | {p.id for p in fresh} | (set(gone) - {p.id for p in everything})
                only = spark.createDataFrame([(i,) for i in sorted(seeds)], "node string")
                only = build.affected_files(old.t, only).select("node") if seeds else only
                now = frames["files"].select(F.col("id").alias("node"))
                only = only.join(now, "node", "left_semi")
                resolved = only.count()
                frames["edges"] = build.resolve(analysis, frames["symbols"], limits, only).unionByName(
                    old.t["edges"].join(only.select(F.col("node").alias("file")), "file", "left_anti").join(now.select(F.col("node").alias("file")), "file", "left_semi")
                )
            else:
                frames["edges"] = build.resolve(analysis, frames["symbols"], limits)
            stop("index", "InvalidEvidence")
            frames["effects"] = build.effects(spark, frames["symbols"], frames["edges"], rules)
            snapshot.write(frames, staged)
            frames = snapshot.tables(spark, staged)
            if frames["edges"].count() > limits.edges:
                fail("ResourceLimitExceeded", "edges")
            again = {r["path"]: r["digest"] for r in trees.source_tree(spark, root, limits).select("path", "digest").collect()}
            if again != live or trees.boundaries(root, [p for p, _ in paths], name) != roots:
                fail("SourceChangedDuringAnalysis", "the tree changed while it was read")
            if adapters.implementation() != adapters.IMPLEMENTATION:
                fail("SourceChangedDuringAnalysis", "the analyzer changed while it ran")
            meta = {
                "repository": name, "repository_roots": roots, "repository_ref": root_ref, "root": str(root), "limits": dataclasses.asdict(limits),
                "packages": {p.owner: p.manifest for p in everything}, "findings": findings, "rules": rules, "package_version": VERSION,
                "measurements": {
                    "duration_seconds": time.monotonic() - began, "files_reresolved": resolved, "files_analyzed": len(fresh),
                    "publication_mode": ("reconstruction", "incremental")[incremental], **{tool: {} for tool in COMPILERS},
                },
                "format": FORMAT,
            }
            meta["digest"] = snapshot.seal(frames, meta)
            snapshot.validate(frames)
            stop("persistence", "InternalFailure")
            stop("before_publish", "InternalFailure")
            snapshot.publish(path, staged, meta, old.meta["digest"] if old else None)
        except BaseException as why:
            snapshot.discard(staged)
            if old is None and path.exists() and not any(path.glob("snap-*")):
                snapshot.discard(path)
            _raise_typed(why)
        return cls(path, staged, spark)

    @staticmethod
    def _other_analyzer(old: "Index") -> bool:
        mark = f'"implementation":"{adapters.IMPLEMENTATION}"'
        return not old.t["files"].filter(~F.col("adapter").contains(mark)).isEmpty()

    @staticmethod
    def _unchanged(old: "Index", everything: list, live: dict[str, str]) -> set[str]:
        """Files whose bytes, owner and adapter are those of the old snapshot: their analysis is reused."""
        before = {r["id"]: (r["digest"], r["owner"], r["adapter"]) for r in old.t["files"].select("id", "digest", "owner", "adapter").collect()}
        return {p.id for p in everything if before.get(p.id) == (live.get(p.path), p.owner, canonical(adapters.provenance(p.language)))}

    # ---- lookups

    def _rows(self, df: DataFrame, order: str = "id", limit: int | None = None) -> list[dict]:
        most = self.limits.result_size
        n = most if limit is None else limit
        if n < 0 or n > most:
            fail("ResourceLimitExceeded", "result bound")
        try:
            return [r.asDict(recursive=True) for r in paging.at_most(df, n, order)]
        except paging.Overflow:
            fail("ResourceLimitExceeded", "ask for less")

    def _one(self, table: str, key: str, value: str, missing: str) -> dict:
        rows = self._rows(self.t[table].filter(F.col(key) == value), limit=1)
        if not rows:
            fail("InvalidEvidence", missing)
        return rows[0]

    def symbol(self, subject: Ref) -> dict:
        _need(subject, SymbolRef)
        return self._one("symbols", "id", subject.value, "no such symbol")

    def type(self, subject: Ref) -> dict:
        _need(subject, TypeRef)
        return self._one("types", "id", subject.value, "no such type")

    def find_symbols(self, name: str, limit: int = 128, path: str | None = None) -> list[dict]:
        found = self.t["symbols"].filter(F.col("name") == name)
        if path is not None:
            found = found.filter(F.col("file") == self.inspect_file(path)["id"])
        return self._rows(found, limit=limit)

    def inspect_file(self, path: str) -> dict:
        row = self._one("files", "path", path, "no such file")
        return {k: row[k] for k in ("id", "path", "language", "owner", "digest", "adapter")}

    def source_evidence(self, subject: Ref) -> dict:
        if type(subject) is SymbolRef:
            return self.symbol(subject)
        _need(subject, SourceFileRef)
        f = self._one("files", "id", subject.value, "no such file")
        return dict(
            id=f["id"], file=f["id"], owner=f["owner"], name=f["path"], kind="SourceUnit", line=1, body_digest=f["digest"], source=f["module_source"],
            resolution="PartiallyResolved", adapter_coverage=f["coverage"], missing=[*f["missing"], "top_level_effect_inference"],
        )

    def _known(self, subject: Ref) -> None:
        where = TABLE_OF.get(type(subject))
        if not where or self.t[where].filter(F.col("id") == subject.value).limit(1).isEmpty():
            fail("InvalidEvidence", "the subject isn't indexed")

    def dependencies_of(self, subject: Ref) -> list[dict]:
        self._known(subject)
        return self._rows(self.t["edges"].filter(F.col("source") == subject.value))

    def dependents_of(self, subject: Ref) -> list[dict]:
        self._known(subject)
        return self._rows(self.t["edges_reverse"].filter(F.col("target") == subject.value))

    def effects_of(self, subject: Ref) -> list[dict]:
        self.symbol(subject)
        return [{k: v for k, v in e.items() if k != "file"} for e in self._rows(self.t["effects"].filter(F.col("source") == subject.value))]

    def reads_of(self, subject: Ref) -> list[dict]:
        return list(filter(lambda e: e["kind"] in (Effect.READ, Effect.RECEIPT_READ), self.effects_of(subject)))

    def writes_of(self, subject: Ref) -> list[dict]:
        found = self.effects_of(subject)
        return [x for x in found if x["kind"].removeprefix("RECEIPT_").startswith("WRITE")]

    def owners_of(self, subject: Ref) -> dict:
        self._known(subject)
        table = None if type(subject) is SourceFileRef else TABLE_OF[type(subject)]
        files = self.t["files"].select(F.col("id").alias("fid"), "owner")
        if table:
            mine = self.t[table].filter(F.col("id") == subject.value).select(F.col("file").alias("fid"))
            files = files.join(mine, "fid", "left_semi")
        else:
            files = files.filter(F.col("fid") == subject.value)
        own = files.join(self.t["packages"], F.col("owner") == F.col("id")).first()
        where = {v: k for k, v in reversed(self.meta["repository_roots"].items())}
        return dict(repository=own["repository"], package=own["id"], repository_path=where[own["repository"]], manifest=own["manifest"], package_name=own["name"])

    # ---- traversal

    def _traverse(self, refs: list[str], reverse: bool, max_depth: int, max_nodes: int, max_edges: int) -> dict:
        """Breadth first, in the order of ids; each level is one bounded query. Partial if a node or edge
        within the bounds was left out, or a target beyond them was not reached."""
        top = self.limits.result_size
        if not (0 <= max_depth <= self.limits.traversal_depth and 1 <= max_nodes <= top and 1 <= max_edges <= top):
            fail("ResourceLimitExceeded", "traversal bounds")
        table, here, there = ("edges_reverse", "target", "source") if reverse else ("edges", "source", "target")
        seen: dict[str, None] = {}
        edges: dict[str, dict] = {}
        beyond: set[str] = set()
        front, partial = sorted(set(refs)), False
        for depth in range(max_depth + 1):
            front = [n for n in front if n not in seen]
            partial |= len(front) > max_nodes - len(seen)
            front = front[: max_nodes - len(seen)]
            if not front:
                break
            seen |= dict.fromkeys(front)
            order = self.spark.createDataFrame(list(enumerate(front)), "place int, node string")
            room = max_edges - len(edges)
            # a short frontier is a filter that prunes row groups; a level is max_nodes rows at most
            rows_of = self.t[table].filter(F.col(here).isin(front)) if len(front) <= graph.IN_FILTER else self.t[table]
            level = rows_of.join(F.broadcast(order), F.col(here) == F.col("node"))
            rows = [r.asDict(recursive=True) for r in level.orderBy("place", "id").limit(room + 1).collect()]
            partial |= len(rows) > room
            found: dict[str, None] = {}
            for r in rows[:room]:
                edges[r["id"]] = {k: v for k, v in r.items() if k not in ("place", "node")}
                if r[there]:
                    found[r[there]] = None
            if depth == max_depth:
                beyond |= set(found)
            front = list(found)
        partial |= bool(beyond - set(seen))
        return dict(edges=[edges[k] for k in sorted(edges)], subjects=sorted(seen), status=("Complete", "Partial")[partial])

    def transitive_dependencies(self, subject: Ref, max_depth: int = 4, max_nodes: int = 256, max_edges: int = 1024) -> dict:
        return self._from(subject, False, (max_depth, max_nodes, max_edges))

    def transitive_dependents(self, subject: Ref, max_depth: int = 4, max_nodes: int = 256, max_edges: int = 1024) -> dict:
        return self._from(subject, True, (max_depth, max_nodes, max_edges))

    def affected_by(self, changed_refs, max_depth: int = 8, max_nodes: int = 4096, max_edges: int = 4096) -> dict:
        bounds = max_depth, max_nodes, max_edges
        return self._traverse([c.value for c in changed_refs], True, *bounds)

    def _from(self, subject: Ref, reverse: bool, bounds: tuple[int, int, int]) -> dict:
        self._known(subject)
        return self._traverse([subject.value], reverse, *bounds)

    # ---- evidence

    def evidence_revision(self, subject: Ref) -> dict:
        """Digests of all that the answer about a subject rests on."""
        own = self.source_evidence(subject)
        top = self.limits.result_size
        forward = self.transitive_dependencies(subject, self.limits.traversal_depth, top, top)
        users = self.dependents_of(subject)
        ids = sorted({e["source"] for e in users}.union(forward["subjects"]))
        inputs, files = {}, set()
        for table in ("symbols", "types"):
            for row in self._among(table, "id", ids):
                inputs[f"{table}:{row['id']}"] = digest(row)
                files.add(row["file"])
        owners = self._among("files", "id", sorted(files))
        for f in owners:
            manifest = self.meta["packages"].get(f["owner"])
            if manifest:
                inputs[f"manifest:{f['owner']}"] = manifest
        wanted = {m for k, m in inputs.items() if k.startswith("manifest:")}
        beside = {posixpath.join(posixpath.dirname(m), n) for m in wanted for n in LOCKS}
        at = {r["path"]: r for r in self._among("files", "path", sorted(wanted | beside))}
        for k in [k for k in inputs if k.startswith("manifest:")]:
            inputs[k] = at[inputs[k]]["digest"]
        inputs |= {f"lock:{at[p]['id']}": at[p]["digest"] for p in beside if p in at}
        files |= {f["id"] for f in self._among("files", "id", ids)}
        done: set[str] = set()
        todo = files
        while todo:  # imports belong to files: follow them to the end
            done |= todo
            if len(done) > top:
                fail("ResourceLimitExceeded", "module inputs")
            for f in self._among("files", "id", sorted(todo)):
                inputs[f"file:{f['id']}"] = f["digest"]
                inputs[f"adapter:{f['id']}"] = digest(f["adapter"])
            declared = {f: [] for f in todo}
            for e in self._among("edges", "file", sorted(todo), F.col("kind").isin("Module", "Include", "Import")):
                declared[e["file"]].append(e)
            for f, rows in declared.items():
                inputs[f"module_edges:{f}"] = digest(sorted(rows, key=lambda e: e["id"]))
            next_ = {e["target"] for rows in declared.values() for e in rows if e["target"]} - done
            todo = {f["id"] for f in self._among("files", "id", sorted(next_))} if next_ else set()
        if isinstance(subject, SymbolRef):
            effects = digest(self.effects_of(subject))
        else:
            effects = digest({"source": own["body_digest"], "resolution": "Unresolved"})
        hows = {e["resolution"] for e in forward["edges"]}
        parts = {"effects": effects, "reverse": digest(users), "rules": digest(self.meta["rules"])}
        parts["dependencies"] = digest(forward["edges"])
        return parts | {
            "resolution_complete": hows <= {"Resolved"} and not own["missing"], "complete": forward["status"] != "Partial",
            "inputs": inputs, "subject": subject.value,
        }

    def _among(self, table: str, key: str, values: list[str], also=None) -> list[dict]:
        """Rows whose key is one of a bounded list."""
        if not values:
            return []
        own = self.spark.createDataFrame([(v,) for v in values], f"{key} string")
        rows = self.t[table].join(F.broadcast(own), key, "left_semi")
        return self._rows(rows if also is None else rows.filter(also))

    def evidence_digest(self, subject: Ref) -> str:
        revision = self.evidence_revision(subject)
        return digest(revision)

    def build_packet(self, subject: Ref, limits: PacketLimits = PacketLimits(), continuation: dict | None = None) -> dict:
        return packets.build(self, subject, limits, continuation, (), ())

    def request_evidence(self, request: EvidenceRequest, continuation: dict | None = None) -> dict:
        _need(request, EvidenceRequest)
        if not all(isinstance(r, Relation) for r in request.relations) or not all(isinstance(e, Effect) for e in request.effects):
            fail("InvalidEvidence", "selectors are relations and effects")
        r = request
        return packets.build(self, r.subject, r.limits, continuation, r.relations, r.effects)

    def assess(self, subject: Ref, required_effects=(), required_targets=()) -> dict:
        """What of the required evidence is not there. Never a permission."""
        there = {f"effect:{e['kind']}" for e in self.effects_of(subject)} - {"effect:UNKNOWN"}
        there |= {f"target:{e['target']}" for e in self.dependencies_of(subject) if e["resolution"] == "Resolved"}
        asked = [f"effect:{e}" for e in required_effects] + [f"target:{t.value}" for t in required_targets]
        missing = [a for a in asked if a not in there]
        return dict(status="NeedEvidence" if missing else "Observed", missing=missing, evidence_digest=self.evidence_digest(subject), authority=False)

    # ---- state

    def index_status(self) -> dict:
        return dict(format=FORMAT, digest=self.meta["digest"], repository=self.meta["repository"], read_only=True)

    def stats(self) -> dict:
        out = {t: self.t[t].count() for t in snapshot.TABLES if t != "packages"} | self.meta["measurements"]
        per = lambda t, c: {r[0]: r[1] for r in self.t[t].groupBy(c).count().collect()}  # noqa: E731  as many rows as there are kinds
        out["language_distribution"], out["edge_resolution"] = per("files", "language"), per("edges", "resolution")
        out["index_bytes"] = sum(p.stat().st_size for p in self.at.rglob("*") if p.is_file())
        return out

    def doctor(self) -> list[dict]:
        """What the stored state no longer says of the tree; that dynamic dispatch stays open is always said."""
        found = list(self.meta["findings"])
        root = self.meta["root"]
        paths, refused = trees.inventory(root, self.limits)
        found += refused
        if trees.boundaries(root, [p for p, _ in paths], self.meta["repository"]) != self.meta["repository_roots"]:
            found.append(_stale(detail="repository boundaries"))
        live = trees.source_tree(self.spark, root, self.limits).select("path", "language", F.col("digest").alias("now"))
        stored = self.t["files"].select("path", F.col("digest").alias("then"), "adapter")
        both = live.join(stored, "path", "full_outer").filter("now IS NULL OR then IS NULL OR now <> then OR adapter IS NOT NULL")
        stale, differs = [], False
        for r in both.orderBy("path").collect():  # as many rows as files, which the limits bound
            differs |= r["now"] is None or r["then"] is None
            if r["now"] is not None and r["now"] != r["then"]:
                stale.append(_stale(path=r["path"]))
            if r["now"] is not None and r["adapter"] is not None and r["adapter"] != canonical(adapters.provenance(r["language"])):
                stale.append(_stale(path=r["path"], detail="another analyzer"))
        if differs:
            found.append(_stale(detail="inventory"))
        return found + stale + [{"code": "UnsupportedDynamicResolution", "detail": "syntax alone proves no dispatch"}]

    def diff(self, previous: "Index", limit: int = 128, continuation: dict | None = None) -> dict:
        """What changed since previous, a page of symbols at a time; ids that stayed the same count for the page."""
        if not 1 <= limit <= self.limits.result_size:
            fail("ResourceLimitExceeded", "page size")
        pair = [previous.meta["digest"], self.meta["digest"]]
        if continuation and pair != continuation.get("baselines"):
            fail("StaleIndex", "the page belongs to other snapshots")
        after = (continuation or {}).get("after", "")
        if not isinstance(after, str):
            fail("InvalidEvidence", "cursor")
        merged = joins.differences(previous.t["symbols"], self.t["symbols"], "id", "body_digest")
        rows = paging.keyset_page(merged, "id", after, limit + 1).collect()
        page = rows[:limit]
        states = {k: [r["id"] for r in page if r["state"] == k] for k in ("added", "removed", "changed")}
        common = [SymbolRef(r["id"]) for r in page if r["state"] in ("same", "changed")]
        out = {f"{k}_symbols": v for k, v in states.items()}
        out["invalidated_packets"] = [s.value for s in common if self.evidence_digest(s) != previous.evidence_digest(s)]
        out["status"] = "Partial" if len(rows) > limit else "Complete"
        out["continuation"] = {"baselines": pair, "after": page[-1]["id"]} if len(rows) > limit else None
        for name, table in (("changed_dependencies", "edges"), ("changed_effects", "effects")):
            out[name] = _counts(previous.t[table], self.t[table])
        return out


def _counts(old: DataFrame, new: DataFrame) -> dict:
    """Rows that only one side has, by content; a changed row counts on both."""
    row = lambda df: df.select("id", F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    states = joins.differences(row(old), row(new), "id", "h").agg(
        F.count(F.when(F.col("state").isin("added", "changed"), 1)), F.count(F.when(F.col("state").isin("removed", "changed"), 1))
    ).first()
    return {"added": states[0], "removed": states[1]}


def _stale(**what) -> dict:
    return dict(code="StaleIndex", **what)


def _need(value, kind: type) -> None:
    if not isinstance(value, kind):
        fail("InvalidEvidence", f"{kind.__name__} needed")


def _typed(parsed: DataFrame | None, spark: SparkSession) -> DataFrame:
    from .schemas import ANALYSIS

    return parsed if parsed is not None else spark.createDataFrame([], ANALYSIS)


def _raise_typed(why: BaseException) -> None:
    """An executor's typed failure as itself: its text holds the code."""
    import re

    from .model import Code, EvidenceError

    if isinstance(why, EvidenceError) or not isinstance(why, Exception):
        raise why
    hit = re.search(rf"EvidenceError: ({'|'.join(Code)})(?:: ([^\n]*))?|\b(ResourceLimitExceeded): ([^\n\"]*)", str(why))
    if hit:
        raise EvidenceError(hit[1] or hit[3], hit[2] or hit[4] or "") from why
    raise why
