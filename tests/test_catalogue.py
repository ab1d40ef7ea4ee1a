"""Every core query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from seamgraph.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    found = oracle.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_whole_tables_enter(spark, oracle):
    run = lambda name: catalogue.queries()[name](spark, str(DATA)).collect()
    ids = [r["id"] for r in run("total_order")]
    n = sum(oracle.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("region", "nation", "customer", "supplier", "part"))
    assert ids == sorted(ids) and len(ids) == n > 100
    assert any(r["span"] is not None and r["span"] % 5 for r in run("interval_containment"))
    assert any(r["doc_id"] % 50 for r in run("rule_witness_stale"))
