"""From a source tree to graph tables: parsing on the executors, resolution and effects as DataFrame programs."""

from __future__ import annotations

import dataclasses
import posixpath
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Effect, ExternalEffectRef, Limits, PackageRef, SourceFileRef, canonical, digest, fail
from ..operators import graph, joins
from ..schemas import ANALYSIS
from ..sources import adapters
from ..sources.inventory import source_tree

_BESIDE = [f".{s}" for s in "rs vue cjs mjs js cts mts tsx ts".split()] + [f"/index.{s}" for s in ("js", "ts")]


@dataclasses.dataclass(frozen=True)
class Place:
    """What the driver knows of a file before it is read."""

    path: str
    language: str
    id: str
    owner: str
    manifest: str | None
    package: str
    repository: str


def places(paths: list[tuple[str, str]], manifests: dict[str, str], roots: dict[str, str], root_ref: str) -> list[Place]:
    """Each file's identity and owner: the deepest manifest above it within its repository boundary."""
    by_dir: dict[str, str] = {}
    for m in sorted(manifests):
        by_dir.setdefault(posixpath.dirname(m) or ".", m)
    out = []
    for path, language in paths:
        above = [p.as_posix() for p in PurePosixPath(path).parents]  # deepest first
        boundary = next(d for d in above if d in roots)
        inside = above[: above.index(boundary) + 1]
        manifest = next((by_dir[d] for d in inside if d in by_dir), None)
        name = manifests.get(manifest, "<root>")
        owner = PackageRef.of(roots[boundary], manifest or "<root>", name).value
        out.append(Place(path, language, SourceFileRef.of(root_ref, path).value, owner, manifest, name, roots[boundary]))
    return out


def candidate_paths(path: str, manifest: str | None, kind: str, name: str, module: str | None) -> list[str] | None:
    """Paths that an import may mean, best first; None for relations that name no module."""
    module, here = module or "", posixpath.dirname(path)
    if kind == "Module":
        base = here if posixpath.basename(path) in ("mod.rs", "lib.rs", "main.rs") else path.removesuffix(".rs")
        stem = f"{base}/{name}"
        return [f"{stem}.rs", f"{stem}/mod.rs"]
    if kind == "Include" or kind == "Import" and module.startswith("."):
        base = posixpath.normpath(posixpath.join(here, module))
        return [base] + [base + s for s in _BESIDE]
    steps = module.split(" as ")[0].split("::")
    if kind == "Import" and len(steps) > 1 and steps[0] == "crate" and "{" not in module:
        top = posixpath.dirname(manifest or "")
        base = posixpath.join(top, "src", *steps[1:-1])
        return [base + s for s in (".rs", "/mod.rs", "/lib.rs")]
    return [] if kind == "Import" else None


def parse(spark: SparkSession, root, limits: Limits, wanted: list[Place]) -> DataFrame:
    """One row per wanted file: its analysis. The files are read and parsed in the tree's partitions."""
    own = spark.createDataFrame([(p.path, p.id, p.owner, p.manifest) for p in wanted], "path string, id string, owner string, manifest string")
    schema = spark.createDataFrame([], ANALYSIS).schema

    def go(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for row in b.to_pylist():
                found = adapters.analyze(row["language"], row["path"], row["content"], row["id"], row["owner"], limits)
                for e in found["edges"]:
                    e["candidates"] = candidate_paths(row["path"], row["manifest"], e["kind"], e["name"], e.get("module"))
                out = {k: row[k] for k in ("id", "path", "language", "owner", "digest")}
                out |= {"adapter": canonical(adapters.provenance(row["language"])), "relations": found.pop("edges"), **found}
                yield pa.RecordBatch.from_pylist([{f.name: out.get(f.name) for f in arrow}], schema=arrow)

    tree = source_tree(spark, root, limits).join(F.broadcast(own), "path")  # the inventory's bound holds for it
    return tree.select("path", "language", "digest", "content", "id", "owner", "manifest").mapInArrow(go, schema)


def symbols_of(analysis: DataFrame) -> DataFrame:
    return analysis.select(F.inline("symbols"))


def types_of(analysis: DataFrame) -> DataFrame:
    return analysis.select(F.inline("types"))


def files_of(analysis: DataFrame) -> DataFrame:
    return analysis.drop("symbols", "types", "relations")


def _edge_id(file: Column, ordinal: Column, target: Column) -> Column:
    """The hash of the canonical JSON list [file, ordinal, target]."""
    return F.sha2(F.concat(F.lit('["'), file, F.lit('",'), ordinal.cast("string"), F.lit(","), F.coalesce(F.concat(F.lit('"'), target, F.lit('"')), F.lit("null")), F.lit("]")), 256)


def resolve(analysis: DataFrame, symbols: DataFrame, limits: Limits, only: DataFrame | None = None) -> DataFrame:
    """Edges of the files in only(node), or of all: each relation once per target, or once without one."""
    mine = analysis if only is None else analysis.join(only.select(F.col("node").alias("id")), "id", "left_semi")
    raw = mine.select(
        F.col("id").alias("file"), (~F.col("language").isin("php") & ((F.col("language") != "vue") | (F.col("syntax_units") == 1))).alias("binds"),
        F.posexplode("relations").alias("ordinal", "r"),
    ).select("file", "binds", "ordinal", "r.*")
    key = ["file", "ordinal"]
    module = F.col("binds") & F.col("kind").isin("Include", "Import", "Module")
    call = F.col("binds") & (F.col("kind") == "Call")
    plain = call & F.col("name").rlike(r"^[^\W\d]\w*$")
    own = call & F.col("name").rlike(r"^[sS]elf[.:]+\w+$")

    # imports: their candidate paths against the files'
    paths = analysis.select("path", F.col("id").alias("hit"))
    listed = raw.filter(module).select(*key, F.explode("candidates").alias("path")).join(paths, "path")
    imported = raw.filter(module).select(*key, "aliases").join(listed.groupBy(*key).agg(F.array_sort(F.collect_set("hit")).alias("found")), key, "left")
    imported = imported.withColumn("found", F.coalesce("found", F.array().cast("array<string>")))

    # plain calls: declarations of that name in the file
    named = symbols.groupBy("file", "name").agg(
        F.sort_array(F.collect_list("id")).alias("found"), F.count("*").alias("n"), F.count(F.when(F.col("qualified") == F.col("name"), 1)).alias("free"),
        F.max(F.size("attributes") > 0).alias("marked"),
    )
    scopes = symbols.select(F.col("id").alias("source"), F.col("qualified").alias("scope"))
    calls = raw.filter(plain).select(*key, "name", "source", "shadowed").join(named, ["file", "name"], "left").join(scopes, "source", "left")
    direct = (F.col("n") == 1) & (F.col("free") == 1) & ~F.col("marked") & ~F.coalesce("shadowed", F.lit(False)) & ~F.coalesce(F.col("scope").contains("::"), F.lit(False))
    local = calls.filter("n IS NOT NULL").select(*key, "found", F.when(direct, "Resolved").otherwise("CandidateTargets").alias("how"))

    # else the latest import before the call that binds the name, whose targets may hold none
    bound = imported.select("file", F.col("ordinal").alias("at"), "found", F.explode("aliases").alias("alias")).select("file", F.col("alias.local").alias("name"), "at", F.col("alias.name").alias("original"), "found")
    open_ = calls.filter("n IS NULL").select(*key, "name")
    latest = open_.join(bound, ["file", "name"]).filter("at < ordinal").groupBy(*key).agg(F.max_by(F.struct("original", "found"), "at").alias("b"))
    through = latest.select(*key, F.col("b.original").alias("name"), F.explode("b.found").alias("there")).join(
        named.select(F.col("file").alias("there"), "name", F.col("found").alias("ids")), ["there", "name"]
    ).groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("found"))
    far = through.select(*key, "found", F.lit("CandidateTargets").alias("how"))

    # calls on self: the enclosing scope's declaration
    to = F.element_at(F.split("name", r"[.:]+"), -1)
    around = F.when(F.col("scope").contains("::"), F.regexp_extract("scope", r"^(.*)::.*$", 1)).otherwise(F.col("scope"))
    selves = raw.filter(own).select(*key, "source", "name").join(scopes, "source").select(*key, to.alias("name"), F.concat(around, F.lit("::"), to).alias("qualified"))
    member = selves.join(symbols.select("file", "name", "qualified", "id"), ["file", "name", "qualified"]).groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("found"))
    member = member.select(*key, "found", F.lit("CandidateTargets").alias("how"))

    known = imported.select(*key, "found", joins.resolution(F.size("found")).alias("how")).unionByName(local).unionByName(far).unionByName(member)
    joined = raw.join(known, key, "left")
    targets = F.coalesce("found", "targets")
    how = F.coalesce("how", F.when(plain | own, "Unresolved").otherwise(F.col("resolution")))
    sized = joined.withColumn("targets", F.when(F.size(targets) <= limits.result_size, targets).otherwise(F.raise_error(F.lit("ResourceLimitExceeded: dispatch targets")).cast("array<string>")))
    out = sized.withColumn("resolution", how).withColumn("target", F.explode_outer("targets"))
    return out.withColumn("id", _edge_id(F.col("file"), F.col("ordinal"), F.col("target"))).select(
        "id", "source", "target", "kind", "resolution", "file", "name", "start", "ordinal", "targets", "syntax_digest", "shadowed", "module",
        "bindings", "type_only", "aliases",
    )


def checked_rules(spark: SparkSession, symbols: DataFrame, rules: dict) -> DataFrame:
    """(symbol, declared): effect rules, each with an exact witness. The rule file is small by contract."""
    rows = rules.get("effects", [])
    if len({r.get("symbol") for r in rows}) < len(rows):
        fail("InvalidEvidence", "a symbol has two effect rules")
    if any(r.get("kind") not in list(Effect) for r in rows):
        fail("InvalidEvidence", "unknown effect")
    own = spark.createDataFrame([(r["symbol"], r.get("source_digest"), r["kind"]) for r in rows], "symbol string, witness string, declared string")
    seen = symbols.select(F.col("id").alias("symbol"), F.col("body_digest").alias("witness"))
    if rows and not own.join(seen, ["symbol", "witness"], "left_anti").isEmpty():
        fail("InvalidEvidence", "an effect rule's witness is missing or stale")
    return own.select("symbol", "declared")


def effects(spark: SparkSession, symbols: DataFrame, edges: DataFrame, rules: dict) -> DataFrame:
    """One effect per symbol that may run: declared by rule, proved pure by an empty body, else unknown."""
    declared = checked_rules(spark, symbols, rules)
    busy = edges.filter(F.col("kind").isin("Macro", "Call")).select(F.col("source").alias("id")).distinct().withColumn("busy", F.lit(True))
    own = symbols.filter("kind <> 'DataDeclaration'").join(busy, "id", "left").join(declared, F.col("id") == F.col("symbol"), "left")
    body = F.when(F.instr("source", "{") > 0, F.regexp_replace("source", r"(?s)^[^{]*\{", "")).otherwise(F.col("source"))
    empty = F.regexp_like(body, F.lit(r"(?s)^\s*\}\s*$"))
    pure = F.col("busy").isNull() & (F.size("attributes") == 0) & (F.col("parameter_count") == 0) & (F.col("kind") == "Function") & empty
    basis = F.when(F.col("declared").isNotNull(), "explicit_source_rule").when(pure, "empty_function_body").otherwise("missing_effect_proof")
    kind = F.coalesce("declared", F.when(pure, "PURE").otherwise("UNKNOWN"))
    outside = F.when(kind == "EXTERNAL_EFFECT", F.sha2(F.to_json(F.array(F.lit(ExternalEffectRef.__name__), F.col("id"))), 256))
    out = own.select(
        F.col("id").alias("source"), F.col("file"), kind.alias("kind"), basis.alias("basis"), F.col("body_digest").alias("source_digest"),
        F.lit(digest(rules)).alias("rule_digest"), F.lit(None).cast("string").alias("store"),
        F.when(kind.isin("EXTERNAL_EFFECT", "PURE"), "NotApplicable").otherwise("Unresolved").alias("store_resolution"), outside.alias("external_effect"),
    )
    record = F.to_json(F.struct(*sorted(c for c in out.columns if c != "file")), {"ignoreNullFields": "false"})
    return out.withColumn("id", F.sha2(record, 256))


def affected_files(old: dict[str, DataFrame], seeds: DataFrame) -> DataFrame:
    """(node, depth): files whose edges may change when seeds do: the reverse closure over file dependencies."""
    where = old["symbols"].select(F.col("id").alias("target"), F.col("file").alias("to")).unionByName(old["files"].select(F.col("id").alias("target"), F.col("id").alias("to")))
    links = old["edges"].join(where, "target").select(F.col("file").alias("source"), F.col("to").alias("target")).filter("source <> target").distinct()
    return graph.reach(links, seeds, None, reverse=True)


def packages_of(spark: SparkSession, all_places: list[Place]) -> DataFrame:
    rows = sorted({(p.owner, p.manifest, p.package, p.repository) for p in all_places}, key=str)
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in ("id", "manifest", "name", "repository")]))
