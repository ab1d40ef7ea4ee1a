"""The registered queries of the core engine: each operator over the driver's tables, with its SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import Limits
from ..operators import digests, enrich, graph, joins, paging
from ..sources import inventory
from . import build
from .projection import SQL_EDGES, SQL_NODES, SQL_OPEN, graph_analysis, graph_edges, graph_nodes, graph_symbols, open_edges, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str):
    def keep(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


# ---- filters and lookups


@_register(f"WITH {SQL_NODES} SELECT id, name, owner, kind FROM g_nodes WHERE name = 'EUROPE'")
def find_by_name(s, d):
    return graph_nodes(s, d).filter("name = 'EUROPE'")


@_register("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey = 17")
def point_lookup(s, d):
    return table(s, d, "part").filter("p_partkey = 17").select("p_partkey", "p_name", "p_brand", "p_size")


@_register("SELECT doc_id, lang, source, n_chars, sha256(text) AS digest FROM documents WHERE doc_id = 5")
def inspect_file(s, d):
    return table(s, d, "documents").filter("doc_id = 5").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("digest"))


@_register(f"WITH {SQL_NODES} SELECT kind, count(*) AS n FROM g_nodes WHERE id IN ('r1', 'n3', 'p9', 'x0') GROUP BY kind")
def subject_existence(s, d):
    wanted = graph.seeds_of(s, ["r1", "n3", "p9", "x0"])
    return graph_nodes(s, d).join(wanted, F.col("id") == F.col("node"), "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


@_register(f"WITH {SQL_EDGES} SELECT source, target, kind FROM g_edges WHERE kind IN ('Import', 'Module') AND target = 'n7'")
def kind_selector(s, d):
    return graph_edges(s, d).filter(F.col("kind").isin("Import", "Module") & (F.col("target") == "n7"))


@_register("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def language_predicate(s, d):
    return table(s, d, "documents").filter(F.col("lang").isin("en", "de")).groupBy("lang").agg(F.count("*").alias("n"))


@_register(r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^\w+ ?\w*[0-9]*5$')")
def name_predicate(s, d):
    return table(s, d, "part").filter(F.col("p_name").rlike(r"^\w+ ?\w*[0-9]*5$")).select("p_partkey", "p_name")


@_register("SELECT doc_id, 'SourceUnit' AS kind, sha256(text) AS body_digest, 1 AS line, 'runtime_semantics,top_level_effect_inference' AS missing FROM documents")
def source_evidence(s, d):
    missing = F.array_join(F.concat(F.array(F.lit("runtime_semantics")), F.array(F.lit("top_level_effect_inference"))), ",")
    return table(s, d, "documents").select("doc_id", F.lit("SourceUnit").alias("kind"), F.sha2("text", 256).alias("body_digest"), F.lit(1).alias("line"), missing.alias("missing"))


# ---- graph


@_register(f"WITH {SQL_EDGES} SELECT source, target, kind FROM g_edges WHERE source = 'c10'")
def dependencies_of(s, d):
    return graph.neighbours(graph_edges(s, d), "c10")


@_register(f"WITH {SQL_EDGES} SELECT source, target, kind FROM g_edges WHERE target = 'n10'")
def dependents_of(s, d):
    return graph.neighbours(graph_edges(s, d), "n10", reverse=True)


def _walk(seeds: str, depth: int, reverse: bool, extra: str = "", edges: str = SQL_EDGES, where: str = "TRUE") -> str:
    here, there = ("target", "source") if reverse else ("source", "target")
    return f"""WITH RECURSIVE {edges},
      w AS (SELECT node, 0 AS depth FROM (VALUES {seeds}) v(node)
            UNION SELECT e.{there}, w.depth + 1 FROM w JOIN g_edges e ON e.{here} = w.node AND {where} WHERE w.depth < {depth}),
      reached AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
      {extra or 'SELECT node, depth FROM reached'}"""


@_register(_walk("('o5')", 4, False))
def transitive_dependencies(s, d):
    return graph.reach(graph_edges(s, d, repeats=True), graph.seeds_of(s, ["o5"]), 4)


@_register(_walk("('r1')", 3, True))
def transitive_dependents(s, d):
    return graph.reach(graph_edges(s, d, repeats=True), graph.seeds_of(s, ["r1"]), 3, reverse=True)


@_register(_walk("('s1'), ('s2'), ('zz')", 2, True))
def affected_by_multi(s, d):
    return graph.reach(graph_edges(s, d, repeats=True), graph.seeds_of(s, ["s2", "s1", "zz", "s1"]), 2, reverse=True)


@_register(_walk("('c3'), ('s3')", 9, False, where="e.kind IN ('Import', 'Module')"))
def module_closure(s, d):
    edges = graph_edges(s, d, repeats=True).filter(F.col("kind").isin("Import", "Module"))
    return graph.reach(edges, graph.seeds_of(s, ["c3", "s3"]), None)


@_register(_walk("('r2')", 9, True, where="e.kind <> 'Property' AND e.kind <> 'TypeReference'"))
def reverse_closure(s, d):
    edges = graph_edges(s, d, repeats=True).filter(~F.col("kind").isin("Property", "TypeReference"))
    return graph.reach(edges, graph.seeds_of(s, ["r2"]), None, reverse=True)


@_register(_walk("('o7')", 2, False, "SELECT e.source, e.target, e.kind FROM g_edges e JOIN reached r ON e.source = r.node"))
def traversal_edge_set(s, d):
    edges = graph_edges(s, d, repeats=True)
    return graph.edges_within(edges, graph.reach(edges, graph.seeds_of(s, ["o7"]), 2)).select("source", "target", "kind").distinct()


@_register(
    _walk("('o7')", 1, False, "SELECT CASE WHEN EXISTS (SELECT 1 FROM g_edges e JOIN reached r ON e.source = r.node WHERE e.target NOT IN (SELECT node FROM reached)) THEN 'Partial' ELSE 'Complete' END AS status, (SELECT count(*) FROM reached) AS subjects")
)
def traversal_status(s, d):
    edges = graph_edges(s, d, repeats=True)
    got = graph.reach(edges, graph.seeds_of(s, ["o7"]), 1)
    beyond = graph.open_ends(edges, got).agg(F.count("*").alias("n"))
    return got.agg(F.count("*").alias("subjects")).select(F.when(beyond.scalar() > 0, "Partial").otherwise("Complete").alias("status"), "subjects")


@_register(
    _walk("('n4')", 1, True, f", {SQL_NODES} SELECT CASE WHEN r.depth = 0 THEN 'symbols:' ELSE 'reverse:' END || g.id AS ref, sha256(to_json([g.name, g.owner])::VARCHAR) AS digest FROM reached r JOIN g_nodes g ON g.id = r.node")
)
def evidence_revision_inputs(s, d):
    got = graph.reach(graph_edges(s, d, repeats=True), graph.seeds_of(s, ["n4"]), 1, reverse=True)
    nodes = graph_nodes(s, d)
    ref = F.concat(F.when(F.col("depth") == 0, "symbols:").otherwise("reverse:"), F.col("id"))
    return got.join(nodes, got.node == nodes.id).select(ref.alias("ref"), F.sha2(F.to_json(F.array("name", "owner")), 256).alias("digest"))


#: Bounds that the walks below run into: the third level is cut after 40 nodes, the edges after 90.
_BOUNDS = dict(max_depth=3, max_nodes=40, max_edges=90, reverse=True, key="source")
_BOUNDED = _walk(
    "('n2')", 3, True,
    """, n AS (SELECT node, depth FROM reached ORDER BY depth, node LIMIT 40),
      m AS (SELECT e.source, e.target, e.kind, n.depth FROM (SELECT * FROM g_edges WHERE kind <> 'Property') e JOIN n ON e.target = n.node),
      k AS (SELECT * FROM m ORDER BY depth, target, source LIMIT 90) {}""",
    where="e.kind <> 'Property'",
)


def _bounded(s, d):
    edges = graph_edges(s, d).filter("kind <> 'Property'")
    return graph.bounded(edges, graph.seeds_of(s, ["n2"]), **_BOUNDS)


@_register(_BOUNDED.format("SELECT node, depth FROM n"))
def bounded_traversal_nodes(s, d):
    return _bounded(s, d)[0]


@_register(_BOUNDED.format("SELECT source, target, kind FROM k"))
def bounded_traversal_edges(s, d):
    return _bounded(s, d)[1]


@_register(
    _BOUNDED.format(
        """SELECT CASE WHEN (SELECT count(*) FROM reached) > 40 OR (SELECT count(*) FROM m) > 90
           OR EXISTS (SELECT 1 FROM k WHERE source NOT IN (SELECT node FROM n)) THEN 'Partial' ELSE 'Complete' END AS status"""
    )
)
def bounded_traversal_status(s, d):
    return _bounded(s, d)[2]


# ---- joins


@_register("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def owners_of(s, d):
    nation, region = table(s, d, "nation"), table(s, d, "region")
    out = table(s, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("s_suppkey", "s_name", "n_name", "r_name")


@_register(
    """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages),
    o AS (SELECT DISTINCT regexp_extract(path, '^([^/]+)/', 1) AS dir FROM p WHERE path LIKE '%/%'
          UNION SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)/', 1) FROM p WHERE regexp_matches(path, '^[^/]+/[^/]+/'))
    SELECT page_id, path, dir, sha256(dir) AS owner FROM (
      SELECT p.*, o.dir, row_number() OVER (PARTITION BY page_id ORDER BY length(o.dir) DESC NULLS LAST) AS k
      FROM p LEFT JOIN o ON starts_with(p.path, o.dir || '/')) WHERE k = 1"""
)
def owner_longest_prefix(s, d):
    p = table(s, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    deep = r"^([^/]+/[^/]+)/"
    dirs = p.filter("path LIKE '%/%'").select(F.regexp_extract("path", "^([^/]+)/", 1).alias("dir")).unionByName(
        p.filter(F.col("path").rlike(deep)).select(F.regexp_extract("path", deep, 1).alias("dir"))
    )
    owners = dirs.distinct().withColumn("owner", F.sha2("dir", 256))
    return joins.longest_prefix(p, "path", owners, "dir", "owner").dropDuplicates(["page_id"])


@_register(
    """SELECT p.event_id, p.user_id, g.event_id AS signup FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') g ON p.user_id = g.user_id AND p.event_id > g.event_id"""
)
def alias_asof(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type")
    buys, joined = (e.filter(F.col("event_type") == k).drop("event_type") for k in ("purchase", "signup"))
    return joins.asof_last(buys, joined.withColumn("signup", F.col("event_id")), "user_id", "event_id", "signup")


@_register(
    """WITH k AS (SELECT p_brand AS file, p_type AS name, count(*) AS n, min(p_partkey) AS one FROM part GROUP BY ALL),
    c AS (SELECT p_partkey AS call, p_brand AS file, CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE p_type END AS name FROM part)
    SELECT call, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN 'Resolved' WHEN n > 1 THEN 'CandidateTargets' ELSE 'Unresolved' END AS resolution,
      CASE WHEN n = 1 THEN one END AS target FROM c LEFT JOIN k USING (file, name)"""
)
def name_resolution_status(s, d):
    p = table(s, d, "part")
    known = p.groupBy(F.col("p_brand").alias("file"), F.col("p_type").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("one"))
    calls = p.select(F.col("p_partkey").alias("call"), F.col("p_brand").alias("file"), F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.col("p_type")).alias("name"))
    n = F.coalesce("n", F.lit(0))
    return calls.join(known, ["file", "name"], "left").select("call", n.alias("candidates"), joins.resolution(n).alias("resolution"), F.when(n == 1, F.col("one")).alias("target"))


@_register(
    """WITH p AS (SELECT *, replace(p_name, ' ', '_') AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ordinal FROM part),
    d AS (SELECT 'p' || p_partkey AS id, p_brand AS file, n || '_' || p_size AS name, p_type = 'STANDARD' AS marked FROM p),
    i AS (SELECT p_brand AS file, ordinal, list_sort(list_distinct(list(b.brand) FILTER (b.brand IS NOT NULL))) AS found
          FROM p LEFT JOIN (SELECT DISTINCT p_brand AS brand FROM part) b ON b.brand IN ('Brand#' || (p_size + 10), 'Brand#' || (p_size + 20)) WHERE p_size <= 10 GROUP BY ALL),
    c AS (SELECT p.p_brand AS file, ordinal, list(d.id) FILTER (d.id IS NOT NULL) AS found, bool_or(d.marked) AS marked
          FROM p LEFT JOIN d ON d.file = p.p_brand AND d.name = n || '_' || (CASE WHEN p_size <= 30 THEN p_size ELSE p_size + 20 END) WHERE p_size > 10 GROUP BY ALL),
    e AS (SELECT file, ordinal, 'Import' AS kind, coalesce(found, []) AS found, CASE len(coalesce(found, [])) WHEN 0 THEN 'Unresolved' WHEN 1 THEN 'Resolved' ELSE 'CandidateTargets' END AS resolution FROM i
      UNION ALL SELECT file, ordinal, 'Call', coalesce(found, []), CASE WHEN len(coalesce(found, [])) = 0 THEN 'Unresolved' WHEN len(found) = 1 AND NOT marked THEN 'Resolved' ELSE 'CandidateTargets' END FROM c)
    SELECT file, ordinal::INT AS ordinal, kind, resolution, t AS target FROM (SELECT *, unnest(CASE WHEN len(found) = 0 THEN [NULL] ELSE found END) AS t FROM e)"""
)
def edge_resolution(s, d):
    """The builder's own resolution of imports and calls over parts as declarations."""
    analysis, symbols = graph_analysis(s, d)
    return build.resolve(analysis, symbols, Limits(result_size=1 << 30)).select("file", "ordinal", "kind", "resolution", "target")


@_register(
    """WITH c AS (SELECT s_suppkey AS call, unnest([s_suppkey, s_suppkey * 2, s_suppkey + 1000000]) AS k FROM supplier),
    j AS (SELECT call, list_sort(list_distinct(list(p_partkey) FILTER (p_partkey IS NOT NULL))) AS t FROM c LEFT JOIN part ON k = p_partkey GROUP BY call)
    SELECT call, coalesce(array_to_string(t, ','), '') AS targets, CASE len(coalesce(t, [])) WHEN 1 THEN 'Resolved' WHEN 0 THEN 'Unresolved' ELSE 'CandidateTargets' END AS resolution FROM j"""
)
def candidate_path_join(s, d):
    calls = table(s, d, "supplier").select(F.col("s_suppkey").alias("call"))
    keys = F.array(F.col("call"), F.col("call") * 2, F.col("call") + 1000000)
    got = joins.candidates(calls, "call", keys, table(s, d, "part"), "p_partkey", "p_partkey")
    return got.withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


@_register(
    """WITH x AS (SELECT event_id, floor(epoch(ts))::BIGINT AS sec FROM events),
    b AS (SELECT min(sec) AS lo FROM x),
    i AS (SELECT o_orderkey AS span, lo + (o_orderkey * 977) % 2000000 AS lo2, lo + (o_orderkey * 977) % 2000000 + 600 + (o_orderkey % 50) * 60 AS hi FROM orders, b)
    SELECT event_id, sec, span FROM (SELECT x.*, i.span, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo2 NULLS LAST, span) AS k
      FROM x LEFT JOIN i ON x.sec >= lo2 AND x.sec < hi) WHERE k = 1"""
)
def interval_containment(s, d):
    x = table(s, d, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    lo = x.agg(F.min("sec").alias("lo")).scalar()
    spans = table(s, d, "orders").select(F.col("o_orderkey").alias("span"), (lo + (F.col("o_orderkey") * 977) % 2000000).alias("lo"))
    spans = spans.withColumn("hi", F.col("lo") + 600 + (F.col("span") % 50) * 60)
    return joins.contained_in(x, "sec", spans, "lo", "hi", "span", 3600)


@_register(
    """SELECT l_orderkey, l_linenumber, l_partkey, p_size FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45) l
    JOIN part ON l_partkey = p_partkey AND p_size <= l_quantity AND p_size >= 40"""
)
def range_equality_join(s, d):
    items = table(s, d, "lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    part = table(s, d, "part").filter("p_size >= 40")
    return items.join(part, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("p_size") <= F.col("l_quantity"))).select("l_orderkey", "l_linenumber", "l_partkey", "p_size")


@_register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def affected_semi_join(s, d):
    changed = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(changed, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@_register(f"WITH {SQL_EDGES}, {SQL_NODES} SELECT source, target, kind FROM g_edges e WHERE NOT EXISTS (SELECT 1 FROM g_nodes n WHERE n.id = e.source)")
def orphan_edges(s, d):
    return joins.orphans(graph_edges(s, d), "source", graph_nodes(s, d), "id")


@_register("SELECT p_partkey, p_brand AS owner FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def orphan_owner(s, d):
    p = table(s, d, "part")
    return joins.orphans(p.select("p_partkey", F.col("p_brand").alias("owner")), "owner", p.filter("p_size = 1"), "p_brand")


@_register(f"WITH {SQL_OPEN} SELECT id, source FROM g_open WHERE resolution = 'Resolved' AND target IS NULL")
def resolved_without_target(s, d):
    return open_edges(s, d).filter("resolution = 'Resolved' AND target IS NULL").select("id", "source")


#: A later version: parts that are small were changed, those of a middling size are gone, large ones have a second form.
_EDITED = "SELECT p_partkey AS id, CASE WHEN p_size < 9 THEN 'edited' ELSE p_type END AS v FROM part WHERE p_size NOT BETWEEN 20 AND 24 UNION ALL SELECT 900000000 + p_partkey, p_type FROM part WHERE p_size > 40"


def _versions(s, d):
    p = table(s, d, "part")
    id_, old = F.col("p_partkey").alias("id"), F.col("p_type").alias("v")
    kept = p.filter(~F.col("p_size").between(20, 24)).select(id_, F.when(F.col("p_size") < 9, "edited").otherwise(F.col("p_type")).alias("v"))
    return p.select(id_, old), kept.unionByName(p.filter("p_size > 40").select((F.col("p_partkey") + 900000000).alias("id"), old))


_STATE = "CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END"


@_register(f"SELECT coalesce(a.id, b.id) AS id, a.v AS before, b.v AS after, {_STATE} AS state FROM (SELECT p_partkey AS id, p_type AS v FROM part) a FULL JOIN ({_EDITED}) b ON a.id = b.id")
def diff_full_outer(s, d):
    return joins.differences(*_versions(s, d), "id", "v")


@_register(f"SELECT count(*) FILTER (st IN ('added', 'changed')) AS added, count(*) FILTER (st IN ('removed', 'changed')) AS removed FROM (SELECT {_STATE} AS st FROM (SELECT p_partkey AS id, p_type AS v FROM part) a FULL JOIN ({_EDITED}) b ON a.id = b.id)")
def diff_counts(s, d):
    got = joins.differences(*_versions(s, d), "id", "v")
    return got.agg(F.count(F.when(F.col("state").isin("added", "changed"), 1)).alias("added"), F.count(F.when(F.col("state").isin("removed", "changed"), 1)).alias("removed"))


@_register(
    """WITH e AS (SELECT 'e' || o_orderkey AS id, 'o' || o_orderkey AS source, 'c' || o_custkey AS target, 'Call' AS kind, 'f' || o_custkey % 10 AS file, o_orderkey::INT AS start, o_orderstatus AS st FROM orders),
    f AS (SELECT source, file, kind, start, target AS old, unnest([target, 'c' || (start % 7), 'c1']) AS target FROM e WHERE st = 'F')
    SELECT id, source, target, NULL AS basis FROM e UNION ALL
    SELECT DISTINCT sha256('["' || source || '","' || file || '","' || kind || '",' || start || ',"' || target || '","compiler_projection"]'), source, target, 'compiler_projection' FROM f WHERE old <> target"""
)
def compiler_target_projection(s, d):
    o = table(s, d, "orders")
    text = lambda c: c.cast("string")
    edges = o.select(
        F.concat(F.lit("e"), text(F.col("o_orderkey"))).alias("id"), F.concat(F.lit("o"), text(F.col("o_orderkey"))).alias("source"),
        F.concat(F.lit("c"), text(F.col("o_custkey"))).alias("target"), F.lit("Call").alias("kind"), F.lit("Resolved").alias("resolution"),
        F.concat(F.lit("f"), text(F.col("o_custkey") % 10)).alias("file"), F.col("o_orderkey").cast("int").alias("start"), "o_orderstatus",
    )
    seen = edges.filter("o_orderstatus = 'F'").select("file", "kind", "start", F.array("target", F.concat(F.lit("c"), text(F.col("start") % 7)), F.lit("c1")).alias("compiler_targets"))
    return enrich.project_targets(edges.drop("o_orderstatus"), seen).select("id", "source", "target", "basis")


# ---- sort, limit, pages


@_register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 128")
def keyset_page(s, d):
    return paging.keyset_page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 128)


@_register(
    """SELECT source, doc_id, position, spent FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS spent FROM (
      SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents) WHERE position BETWEEN 2 AND 9) WHERE spent <= 8192"""
)
def offset_page_budget(s, d):
    return paging.budget_page(table(s, d, "documents"), "source", "doc_id", "n_chars", 2, 8, 8192).select("source", "doc_id", "position", "spent")


#: Pages of 512 bytes: a character belongs to the page in which its last byte's 509th falls.
@_register(
    """WITH c AS (SELECT doc_id, i, ch, strlen(ch) AS n, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (
        SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents WHERE text <> '')),
      p AS (SELECT doc_id, (e - 1) // 509 AS k, min(e - n) AS offset_bytes, string_agg(ch, '' ORDER BY i) AS page, max(e) AS e FROM c GROUP BY ALL)
    SELECT doc_id, offset_bytes::INT AS offset_bytes, sha256(page) AS page, e = max(e) OVER (PARTITION BY doc_id) AS slice_complete FROM p
    UNION ALL SELECT doc_id, 0, sha256(''), true FROM documents WHERE text = ''"""
)
def text_page(s, d):
    got = paging.text_pages(table(s, d, "documents").select("doc_id", "text"), "text", 512)
    return got.select("doc_id", "offset_bytes", F.sha2("page", 256).alias("page"), "slice_complete")


@_register(f"WITH {SQL_NODES} SELECT id, name FROM g_nodes ORDER BY id")
def total_order(s, d):
    return graph_nodes(s, d).select("id", "name").orderBy("id")


# ---- aggregates


@_register(f"WITH {SQL_EDGES} SELECT kind, count(*) AS n FROM g_edges GROUP BY kind")
def stats_by_kind(s, d):
    return graph_edges(s, d).groupBy("kind").agg(F.count("*").alias("n"))


@_register("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_distribution(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@_register(f"WITH {SQL_OPEN} SELECT resolution, count(*) AS n FROM g_open GROUP BY resolution")
def edge_resolution_counts(s, d):
    return open_edges(s, d).groupBy("resolution").agg(F.count("*").alias("n"))


@_register("SELECT DISTINCT source FROM documents")
def distinct_owners(s, d):
    return table(s, d, "documents").select("source").distinct()


@_register("SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS ordinal FROM part")
def occurrence_ordinal(s, d):
    return paging.occurrence(table(s, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], ["p_partkey"])


@_register("SELECT p_brand, arg_min(p_partkey, (p_size, p_partkey)) AS smallest FROM part GROUP BY p_brand")
def smallest_span(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("smallest"))


@_register("SELECT p_brand, arg_max(p_partkey, (length(p_name), p_partkey)) AS deepest FROM part GROUP BY p_brand")
def deepest_match(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(F.length("p_name"), "p_partkey")).alias("deepest"))


@_register("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY source")
def collected_sets(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@_register("SELECT lang AS kind, count(*) AS entries, sum(n_chars)::BIGINT AS total, coalesce(max(n_chars), 0) AS largest FROM documents GROUP BY lang")
def folder_kind_stats(s, d):
    return table(s, d, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("entries"), F.sum("n_chars").alias("total"), F.coalesce(F.max("n_chars"), F.lit(0)).alias("largest"))


@_register("SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes, max(n_chars) AS largest, count(*) <= 30000 AND sum(n_chars) <= 268435456 AND max(n_chars) <= 2097152 AS within FROM documents")
def inventory_bounds(s, d):
    got = table(s, d, "documents").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.max("n_chars").alias("largest"))
    return got.withColumn("within", (F.col("files") <= 30000) & (F.col("bytes") <= 268435456) & (F.col("largest") <= 2097152))


@_register("SELECT p_type, min(p_partkey) AS kept FROM part GROUP BY p_type")
def first_of_each(s, d):
    return table(s, d, "part").groupBy("p_type").agg(F.min("p_partkey").alias("kept"))


# ---- effects

_EFFECTS = {"view": "READ", "click": "RECEIPT_READ", "purchase": "WRITE_CANONICAL", "signup": "RECEIPT_WRITE"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EFFECTS.items()) + " ELSE CASE WHEN value = 0 THEN 'PURE' ELSE 'UNKNOWN' END END"


def _effect(s, d):
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _EFFECTS.items()])
    bare = F.when(F.col("value") == 0, "PURE").otherwise("UNKNOWN")
    return table(s, d, "events").select("event_id", "user_id", F.coalesce(kind, bare).alias("kind"))


@_register(f"SELECT event_id, k AS kind, CASE WHEN k IN ('PURE', 'EXTERNAL_EFFECT') THEN 'NotApplicable' ELSE 'Unresolved' END AS store_resolution FROM (SELECT event_id, {_CASE} AS k FROM events)")
def effect_classifier(s, d):
    return _effect(s, d).select("event_id", "kind", F.when(F.col("kind").isin("PURE", "EXTERNAL_EFFECT"), "NotApplicable").otherwise("Unresolved").alias("store_resolution"))


@_register(f"SELECT event_id, {_CASE} AS kind FROM events WHERE user_id = 7")
def effects_of(s, d):
    return _effect(s, d).filter("user_id = 7").select("event_id", "kind")


@_register(f"SELECT * FROM (SELECT event_id, {_CASE} AS kind FROM events) WHERE kind IN ('READ', 'RECEIPT_READ')")
def reads_of(s, d):
    return _effect(s, d).filter(F.col("kind").isin("READ", "RECEIPT_READ")).select("event_id", "kind")


@_register(f"SELECT * FROM (SELECT event_id, {_CASE} AS kind FROM events) WHERE kind LIKE 'WRITE%' OR kind = 'RECEIPT_WRITE'")
def writes_of(s, d):
    return _effect(s, d).filter(F.col("kind").startswith("WRITE") | (F.col("kind") == "RECEIPT_WRITE")).select("event_id", "kind")


@_register(r"SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(regexp_replace(text, '\b(?:[0-9]{6,}|0x[a-fA-F0-9]+)\b', '#', 'g')) FROM documents WHERE text IS NOT NULL)")
def rule_witness_stale(s, d):
    """Every document as a rule, against the whole version of the table whose numbers are masked."""
    docs = table(s, d, "documents")
    rules = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    seen = docs.select(F.sha2(T.masked(F.col("text")), 256).alias("digest"))
    return joins.orphans(rules, "digest", seen, "digest").select("doc_id")


_RULES = {"effects": [{"symbol": f"s{k}", "kind": kind, "source_digest": hashlib.sha256(f"Supplier#{k:09}".encode()).hexdigest()} for k, kind in ((3, "READ"), (4, "EXTERNAL_EFFECT"), (5, "WRITE_CANONICAL"))]}


@_register(
    """WITH s AS (SELECT 's' || s_suppkey AS source, 'n' || s_nationkey AS file, s_suppkey AS k, s_nationkey AS n FROM supplier WHERE s_nationkey <> 3),
      e AS (SELECT source, file, CASE k WHEN 3 THEN 'READ' WHEN 4 THEN 'EXTERNAL_EFFECT' WHEN 5 THEN 'WRITE_CANONICAL' END AS declared,
        k % 5 = 0 AND k % 10 <> 5 AND n <> 7 AND n NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AS pure FROM s)
    SELECT source, file, coalesce(declared, CASE WHEN pure THEN 'PURE' ELSE 'UNKNOWN' END) AS kind,
      CASE WHEN declared IS NOT NULL THEN 'explicit_source_rule' WHEN pure THEN 'empty_function_body' ELSE 'missing_effect_proof' END AS basis,
      CASE WHEN coalesce(declared, CASE WHEN pure THEN 'PURE' ELSE 'UNKNOWN' END) IN ('PURE', 'EXTERNAL_EFFECT') THEN 'NotApplicable' ELSE 'Unresolved' END AS store_resolution
    FROM e"""
)
def symbol_effects(s, d):
    """The builder's own classifier over suppliers as declarations; a rich customer of the nation calls from them."""
    symbols = graph_symbols(s, d)
    busy = table(s, d, "customer").filter("c_acctbal > 9900").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("file"))
    calls = symbols.join(busy, "file", "left_semi").select(F.col("id").alias("source"), F.lit("Call").alias("kind"))
    return build.effects(s, symbols, calls, _RULES).select("source", "file", "kind", "basis", "store_resolution")


@_register("SELECT source AS symbol, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def rule_duplicates(s, d):
    return table(s, d, "documents").groupBy(F.col("source").alias("symbol")).agg(F.count("*").alias("n")).filter("n > 1")


@_register(f"SELECT 'effect:' || k AS missing FROM (SELECT unnest(['READ', 'WRITE_BACKEND', 'SECURITY_CONSUME']) AS k) EXCEPT SELECT 'effect:' || {_CASE} FROM events WHERE user_id = 7")
def assess_missing(s, d):
    need = s.createDataFrame([("READ",), ("WRITE_BACKEND",), ("SECURITY_CONSUME",)], "kind string")
    return joins.orphans(need, "kind", _effect(s, d).filter("user_id = 7"), "kind").select(F.concat(F.lit("effect:"), "kind").alias("missing"))


# ---- digests and sets


@_register("SELECT p_partkey, sha256(to_json(['SymbolRef', p_name, p_brand])::VARCHAR) AS ref FROM part")
def symbol_ref_digest(s, d):
    return table(s, d, "part").select("p_partkey", digests.ref("SymbolRef", F.col("p_name"), F.col("p_brand")).alias("ref"))


@_register("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@_register(
    """WITH r AS (SELECT p_partkey % 16 AS bucket, sha256(to_json([p_name, p_brand, p_type])::VARCHAR) AS h FROM part),
    b AS (SELECT bucket, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY bucket)
    SELECT sha256(string_agg(h, '' ORDER BY bucket)) AS root FROM b"""
)
def state_digest_root(s, d):
    return digests.state_root(table(s, d, "part"), F.sha2(F.to_json(F.array("p_name", "p_brand", "p_type")), 256), F.col("p_partkey") % 16)


@_register("(SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING' EXCEPT ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 12) UNION ALL (SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 12 EXCEPT ALL SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING')")
def inventory_recheck(s, d):
    c = table(s, d, "customer")
    a, b = (c.filter(f).select("c_custkey", "c_name") for f in ("c_mktsegment <> 'BUILDING'", "c_nationkey < 12"))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@_register("SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def affected_union(s, d):
    a = table(s, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("k"))
    return a.unionByName(table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))).distinct()


# ---- text functions


@_register("SELECT doc_id, len(text) - len(replace(text, chr(10), '')) + 1 AS lines, instr(text, 'token') AS at, CASE WHEN instr(text, 'token') > 0 THEN instr(text, 'token') - len(replace(substring(text, 1, instr(text, 'token')), chr(10), '')) + 1 END AS line FROM documents")
def line_number(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", T.line_count(t).alias("lines"), F.instr(t, "token").alias("at"), T.line_number(t, "token").alias("line"))


@_register(r"SELECT doc_id, regexp_replace(text, '\b(?:[0-9]{6,}|0x[a-fA-F0-9]+)\b', '#', 'g') AS masked FROM documents")
def numeric_mask(s, d):
    return table(s, d, "documents").select("doc_id", T.masked(F.col("text")).alias("masked"))


@_register("SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag")
def html_tags(s, d):
    return table(s, d, "pages").select(F.explode(T.html_tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@_register("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def html_links(s, d):
    return table(s, d, "pages").select("page_id", F.explode(T.html_links(F.col("html"))).alias("link"))


@_register("SELECT page_id, sha256(unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1))) AS script FROM pages")
def script_blocks(s, d):
    return table(s, d, "pages").select("page_id", F.explode(T.script_blocks(F.col("html"))).alias("b")).select("page_id", F.sha2("b", 256).alias("script"))


@_register("SELECT event_id, array_to_string(json_keys(props), ',') AS keys FROM events")
def json_top_level_keys(s, d):
    return table(s, d, "events").select("event_id", F.array_join(T.json_keys(F.col("props")), ",").alias("keys"))


@_register("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def path_algebra(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("page_id", T.dirname(u).alias("dir"), T.basename(u).alias("base"))


_KNOWN = ", ".join(f"('{k}', '{v}')" for k, v in (inventory.BY_NAME | inventory.BY_SUFFIX).items())


@_register(
    f"""WITH k AS (SELECT * FROM (VALUES {_KNOWN}) v(key, language)),
    p AS (SELECT page_id, regexp_extract(url, '([^/]*)/?$', 1) AS name FROM pages)
    SELECT page_id, coalesce(a.language, b.language, 'unsupported') AS language FROM p LEFT JOIN k a ON a.key = p.name LEFT JOIN k b ON b.key = regexp_extract(p.name, '^.+(\\.[^.]+)$', 1)"""
)
def language_classify(s, d):
    return table(s, d, "pages").select("page_id", F.coalesce(inventory.language_column(F.col("url")), F.lit("unsupported")).alias("language"))


@_register("SELECT p_partkey, (p_partkey // 26 % 26 + 1) * 26 + (p_partkey % 26 + 1) AS col FROM part")
def column_decode(s, d):
    ref = F.concat(F.chr((F.floor(F.col("p_partkey") / 26) % 26 + 65).cast("long")), F.chr((F.col("p_partkey") % 26 + 65).cast("long")), F.lit("7"))
    return table(s, d, "part").select("p_partkey", T.column_number(ref).cast("long").alias("col"))
