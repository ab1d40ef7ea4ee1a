"""The driver's tables seen as a property graph: nodes, typed edges, and edges with open targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, key: str):
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _link(df: DataFrame, a: tuple, b: tuple, kind: str) -> DataFrame:
    return df.select(_id(*a).alias("source"), _id(*b).alias("target"), F.lit(kind).alias("kind"))


def graph_edges(spark: SparkSession, d: str, repeats: bool = False) -> DataFrame:
    """(source, target, kind), without repeats; a traversal, which makes what it finds distinct, can do with them."""
    items = table(spark, d, "lineitem")
    once = (lambda df: df) if repeats else DataFrame.distinct
    parts = [
        _link(table(spark, d, "nation"), ("n", "n_nationkey"), ("r", "n_regionkey"), "Module"),
        _link(table(spark, d, "customer"), ("c", "c_custkey"), ("n", "c_nationkey"), "Import"),
        _link(table(spark, d, "supplier"), ("s", "s_suppkey"), ("n", "s_nationkey"), "Import"),
        _link(table(spark, d, "orders"), ("o", "o_orderkey"), ("c", "o_custkey"), "Call"),
        once(_link(items, ("o", "l_orderkey"), ("p", "l_partkey"), "TypeReference")),
        once(_link(items, ("p", "l_partkey"), ("s", "l_suppkey"), "Property")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, owner, kind) of the dimension tables."""

    def of(name: str, letter: str, key: str, label: str, owner, kind: str) -> DataFrame:
        return table(spark, d, name).select(_id(letter, key).alias("id"), F.col(label).alias("name"), owner.alias("owner"), F.lit(kind).alias("kind"))

    return (
        of("region", "r", "r_regionkey", "r_name", F.lit("<root>"), "Module")
        .unionByName(of("nation", "n", "n_nationkey", "n_name", _id("r", "n_regionkey"), "Module"))
        .unionByName(of("customer", "c", "c_custkey", "c_name", _id("n", "c_nationkey"), "Struct"))
        .unionByName(of("supplier", "s", "s_suppkey", "s_name", _id("n", "s_nationkey"), "Struct"))
        .unionByName(of("part", "p", "p_partkey", "p_name", F.col("p_brand"), "Constant"))
    )


def open_edges(spark: SparkSession, d: str) -> DataFrame:
    """(id, source, target, resolution): orders to customers in credit; the others' targets are unknown."""
    good = table(spark, d, "customer").filter("c_acctbal >= 0").select("c_custkey")
    o = table(spark, d, "orders").join(good, F.col("o_custkey") == F.col("c_custkey"), "left")
    known = F.col("c_custkey").isNotNull()
    return o.select(
        _id("o", "o_orderkey").alias("id"), _id("o", "o_orderkey").alias("source"), F.when(known, _id("c", "c_custkey")).alias("target"),
        F.when(known, "Resolved").otherwise("Unresolved").alias("resolution"),
    )


def graph_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as declarations, with the columns that effects are told from: every fifth body is empty, some have
    attributes or parameters, those of nation 3 are data."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, d, "supplier").select(
        _id("s", "s_suppkey").alias("id"), _id("n", "s_nationkey").alias("file"), F.when(nation == 3, "DataDeclaration").otherwise("Function").alias("kind"),
        F.when(k % 5 == 0, F.lit("fn f() { }")).otherwise(F.concat(F.lit("fn f() { "), "s_name", F.lit(" }"))).alias("source"),
        F.when(nation == 7, F.array(F.lit("inline"))).otherwise(F.array().cast("array<string>")).alias("attributes"),
        F.when(k % 10 == 5, 1).otherwise(0).alias("parameter_count"), F.sha2("s_name", 256).alias("body_digest"),
    )


def graph_analysis(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(analysis, symbols) as the builder has them: a brand is a file, each of its parts declares a name and makes one
    relation: an import of one or two brands' paths (small parts), a call of the part's own name (middling ones), or a call
    of a name that few declare."""
    p = table(spark, d, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    sized = lambda n: F.concat(name, F.lit("_"), n.cast("string"))
    file, none = F.col("p_brand"), F.array().cast("array<string>")
    symbols = p.select(
        _id("p", "p_partkey").alias("id"), file.alias("file"), sized(F.col("p_size")).alias("name"), sized(F.col("p_size")).alias("qualified"),
        F.when(F.col("p_type") == "STANDARD", F.array(F.lit("inline"))).otherwise(none).alias("attributes"),
    )
    brand = lambda n: F.concat(F.lit("Brand#"), n.cast("string"))
    small, size = F.col("p_size") <= 10, F.col("p_size")
    relation = F.struct(
        F.col("p_partkey"), F.when(small, "Import").otherwise("Call").alias("kind"), _id("p", "p_partkey").alias("source"),
        F.when(small, F.lit("x")).when(size <= 30, sized(size)).otherwise(sized(size + 20)).alias("name"), F.lit(0).alias("start"),
        F.lit("Unresolved").alias("resolution"), none.alias("targets"), F.lit("").alias("syntax_digest"), F.lit(False).alias("shadowed"),
        F.lit(None).cast("string").alias("module"), none.alias("bindings"), F.lit(False).alias("type_only"),
        F.array().cast("array<struct<name:string,local:string>>").alias("aliases"),
        F.when(small, F.array(brand(size + 10), brand(size + 20))).alias("candidates"),
    )
    analysis = p.groupBy(file.alias("id")).agg(F.sort_array(F.collect_list(relation)).alias("relations"))
    return analysis.select("id", F.col("id").alias("path"), F.lit("rust").alias("language"), F.lit(1).alias("syntax_units"), "relations"), symbols


#: The same three as SQL common tables.
SQL_EDGES = """
g_edges AS (
  SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'Module' AS kind FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'Import' FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'Import' FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'Call' FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'TypeReference' FROM lineitem
  UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'Property' FROM lineitem)
"""
SQL_NODES = """
g_nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, '<root>' AS owner, 'Module' AS kind FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 'Module' FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey, 'Struct' FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey, 'Struct' FROM supplier
  UNION ALL SELECT 'p' || p_partkey, p_name, p_brand, 'Constant' FROM part)
"""
SQL_OPEN = """
g_open AS (
  SELECT 'o' || o_orderkey AS id, 'o' || o_orderkey AS source,
    CASE WHEN c_custkey IS NOT NULL THEN 'c' || c_custkey END AS target,
    CASE WHEN c_custkey IS NOT NULL THEN 'Resolved' ELSE 'Unresolved' END AS resolution
  FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey)
"""
