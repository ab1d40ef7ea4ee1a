import os

import pytest
from pyspark.sql import functions as F
from seamgraph.llm import common as C


def test_durable_needs_a_shared_folder(spark):
    class Far:
        master = "spark://far:7077"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, other=None: other)})
        sparkContext = Far

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(Session)


def test_forgotten_tables_go(spark):
    home = C.shared_dir(spark).removeprefix("file://")
    df = C.durable(spark.range(5), "some")
    at = df._seam_path.removeprefix("file://")
    assert at.startswith(home) and os.path.isdir(at) and df.count() == 5
    C.forget(df, None)
    assert not os.path.exists(at)


def test_operators_leave_only_what_their_results_read(spark, table, words):
    from seamgraph.llm.linededup import line_dedup
    from seamgraph.llm.mixing import mix
    from seamgraph.llm.substring import substring_dedup

    home = f"{C.shared_dir(spark)}/tables-{spark.sparkContext.applicationId}".removeprefix("file://")
    docs = table([" ".join(words * 4)] * 3 + ["a\nb\nc\nd"] * 2)
    for operator in (substring_dedup, line_dedup, mix):
        before = set(os.listdir(home)) if os.path.isdir(home) else set()
        out = operator(docs)
        out.collect()
        left = set(os.listdir(home)) - before
        read = {f.split("/")[-2] for f in out.inputFiles()}
        assert left <= read, (operator, left - read)


def test_met_is_a_join_whatever_the_keys_weigh(spark):
    left = spark.range(5000).select((F.col("id") * F.col("id") % 97).alias("k"), "id").unionByName(spark.range(3000).select(F.lit(5).cast("long").alias("k"), "id"))
    right = left.filter("k < 60").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2)
    for how in ("inner", "left"):
        want = left.join(right, "k", how).select("k", "id", "x")
        for total in (1, 8000, 10**9):
            got = C.met(left, right, ["k"], "n", total, how).select("k", "id", "x")
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
