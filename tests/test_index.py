"""One journey through the index: build, ask, page, update, compare, corrupt."""

import json
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seamgraph import cli
from seamgraph.index import Index
from seamgraph.model import Effect, EvidenceError, EvidenceRequest, PacketLimits, Relation, SourceFileRef, SymbolRef, canonical


def code(f, *a, **k):
    with pytest.raises(EvidenceError) as e:
        f(*a, **k)
    return str(e.value.code)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    src = top / "root"
    for d in ("src", "one", "one/.git"):
        (src / d).mkdir(parents=True, exist_ok=True)
    (src / "Cargo.toml").write_text('[package]\nname = "demo"\n')
    (src / "src/lib.rs").write_text("mod child;\npub fn callee() {}\npub fn caller() { callee(); }\n" + "fn long() {\n" + "    step();\n" * 60 + "}\n")
    (src / "src/child.rs").write_text("pub fn inner() {}\nfn with(a: u8) {}\n")
    (src / "one/package.json").write_text('{"name": "one"}')
    (src / "one/.git/HEAD").write_text("x")
    (src / "one/a.ts").write_text('import { target as alias } from "./service";\nexport function go() { return alias(); }\n')
    (src / "one/service.ts").write_text("export function target() { return 1; }\n")
    (src / "notes.md").write_text("# no source\n")
    return top


@pytest.fixture(scope="module")
def index(spark, tree):
    return Index.create(tree / "ix", tree / "root", "repo")


def ref(index, called):
    first = index.find_symbols(called)[0]
    return SymbolRef(first["id"])


def test_questions(index, tree):
    caller, callee, go = (ref(index, n) for n in ("caller", "callee", "go"))
    assert [(e["kind"], e["resolution"], e["target"]) for e in index.dependencies_of(caller)] == [("Call", "Resolved", callee.value)]
    assert caller.value in {e["source"] for e in index.dependents_of(callee)}
    hit = [e for e in index.dependencies_of(go) if e["kind"] == "Call"]
    assert [(e["resolution"], e["target"]) for e in hit] == [("CandidateTargets", ref(index, "target").value)]
    assert index.effects_of(callee)[0]["kind"] == "PURE" and index.effects_of(caller)[0]["kind"] == "UNKNOWN"
    assert index.effects_of(ref(index, "with"))[0]["kind"] == "UNKNOWN"
    assert index.reads_of(callee) == [] and index.writes_of(callee) == []
    assert (index.owners_of(callee)["package_name"], index.owners_of(go)["package_name"], index.owners_of(go)["repository_path"]) == ("demo", "one", "one")
    lib = SourceFileRef(index.inspect_file("src/lib.rs")["id"])
    child = index.inspect_file("src/child.rs")["id"]
    # a module declaration is a symbol, and the source of its own edge
    assert child in {e["target"] for e in index.dependencies_of(ref(index, "child")) if e["kind"] == "Module"}
    walk = index.transitive_dependencies(lib, max_depth=1)
    assert walk["status"] == "Complete" or ref(index, "inner").value not in walk["subjects"]
    assert caller.value in index.affected_by([callee, SymbolRef("none")])["subjects"]
    assert code(index.transitive_dependencies, caller, max_depth=100) == "ResourceLimitExceeded"
    assert index.transitive_dependents(callee, max_nodes=1)["status"] == "Partial"
    assert code(index.find_symbols, "caller", limit=0) == "ResourceLimitExceeded"
    assert code(index.symbol, SymbolRef("none")) == "InvalidEvidence" and code(index.symbol, "x") == "InvalidEvidence"
    assert index.source_evidence(lib)["kind"] == "SourceUnit"
    seen = index.assess(caller, [Effect.READ], [callee])
    assert (seen["status"], seen["missing"], seen["authority"]) == ("NeedEvidence", ["effect:READ"], False)
    assert index.stats()["language_distribution"]["rust"] == 2


def test_pages_reassemble(index):
    long = ref(index, "long")
    whole, text, inputs, cursor = index.symbol(long)["source"], "", [], None
    for _ in range(40):
        page = index.build_packet(long, PacketLimits(max_source_bytes=200, max_revision_inputs=3), cursor)
        assert len(canonical(page)) <= 65536
        text += "".join(s["text"] for s in page["sources"])
        inputs += page["revision_inputs"]
        cursor = page["continuation"]
        if cursor is None:
            break
    assert text == whole and {i["ref"]: i["digest"] for i in inputs} == index.evidence_revision(long)["inputs"]
    only = index.request_evidence(EvidenceRequest(ref(index, "caller"), relations=(Relation.Import,)))
    assert only["dependencies"] == [] and only["requested_relations"] == ["Import"]
    first = index.build_packet(long, PacketLimits(max_source_bytes=200))["continuation"]
    assert code(index.request_evidence, EvidenceRequest(long, relations=(Relation.Call,)), first) == "StaleIndex"


def test_update_equals_a_full_build(spark, index, tree):
    root = tree / "two"
    shutil.copytree(tree / "root", root)
    path = tree / "ix2"
    first = Index.create(path, root, "repo")
    (root / "src/lib.rs").write_text("mod child;\npub fn callee() { }\npub fn caller() { callee(); }\n")
    for at in ("parse", "index", "before_publish"):
        code(Index.update, path, failpoint=at)
        assert Index.open_existing(path, verify=False).meta["digest"] == first.meta["digest"]
    second = Index.update(path)
    assert second.meta["measurements"]["files_analyzed"] == 1
    assert Index.create(tree / "ix3", root, "repo").meta["digest"] == second.meta["digest"]
    assert first.find_symbols("long") and not second.find_symbols("long")  # the old reader keeps its snapshot
    found = second.diff(first, limit=2)
    pages, seen = [found], 0
    while pages[-1]["continuation"]:
        pages.append(second.diff(first, limit=4, continuation=pages[-1]["continuation"]))
    ids = {k: [i for p in pages for i in p[k]] for k in ("added_symbols", "removed_symbols", "changed_symbols", "invalidated_packets")}
    assert ids["removed_symbols"] == [first.find_symbols("long")[0]["id"]] and ref(second, "callee").value in ids["changed_symbols"]
    assert ref(second, "caller").value in ids["invalidated_packets"] and ref(second, "go").value not in ids["invalidated_packets"]
    assert seen == 0 and code(Index.create, path, root, "repo") == "PublicationConflict"
    (root / "src/lib.rs").write_text("fn broken( {")
    assert code(Index.update, path) == "ParseFailure"
    assert {"code": "StaleIndex", "path": "src/lib.rs"} in second.doctor()


def test_effect_rules(spark, index, tree):
    s = index.symbol(ref(index, "caller"))
    rules = {"version": 1, "effects": [{"symbol": s["id"], "source_digest": s["body_digest"], "kind": "EXTERNAL_EFFECT"}]}
    got = Index.create(tree / "ix4", tree / "root", "repo", rules=rules)
    assert [e["kind"] for e in got.effects_of(SymbolRef(s["id"]))] == ["EXTERNAL_EFFECT"]
    rules["effects"][0]["source_digest"] = "0"
    assert code(Index.update, tree / "ix4", rules=rules) == "InvalidEvidence"


def test_corruption_and_unsafe_trees(spark, index, tree, capsys):
    shutil.copytree(tree / "ix", tree / "bad")
    part = next(next((tree / "bad").glob("snap-*/symbols.parquet")).glob("part-*"))
    rows = pq.read_table(part)
    k = rows.schema.get_field_index("body_digest")
    pq.write_table(rows.set_column(k, "body_digest", pa.array(["corrupt"] * len(rows))), part)
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert code(Index.open_existing, tree / "bad") == "CorruptIndex"
    assert code(Index.open_existing, tree / "none") == "MissingIndex"
    (tree / "links").mkdir()
    (tree / "links/a.rs").symlink_to(tree / "root/src/lib.rs")
    assert code(Index.create, tree / "ix5", tree / "links", "repo") == "UnsafePath"
    assert cli.main(["index", "status", str(tree / "ix")]) == 0 and json.loads(capsys.readouterr().out)["digest"] == index.meta["digest"]
    assert cli.main(["query", "symbols", str(tree / "ix"), "caller"]) == 0 and "caller" in capsys.readouterr().out
    assert cli.main(["inspect", "symbol", str(tree / "ix"), "none"]) == 2 and "InvalidEvidence" in capsys.readouterr().out
