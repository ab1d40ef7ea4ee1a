import numpy as np

from seamgraph.llm.covertree import Tree, dual, embedding_near_dups, unit


def vectors(seed, n=240, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(n // 2):  # clusters and chains
        x[n // 2 + k] = x[rng.integers(0, n // 2 + k)] + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.2, 0.35])
    return x.astype(np.float32)


def brute(rows, cosine=0.9):
    """(links, least id reachable) for (id, vector or None)."""
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    near = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                near[a].add(b)
                near[b].add(a)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out.append((rows[k][0], len(near[k]), min(rows[m][0] for m in seen)))
    return out


def test_against_brute_force(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors(1))]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, rows[3][1]), (506, rows[3][1][:8]), (507, rows[3][1][:8]), (508, [float("inf")] * 16)]
    rows = rows[::-1]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    for block in (4096, 20):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_near_dups(df, block_rows=block, centres=6, sample=64).collect())
        assert got == sorted(brute(rows))
    assert embedding_near_dups(df.limit(0)).count() == 0


def test_dual_counts_whole_nodes():
    x = unit(np.concatenate([np.eye(8)[[0] * 60] + np.random.default_rng(0).normal(size=(60, 8)) * 0.01, vectors(3, 80, 8)]).astype(float))
    w = np.ones(len(x), np.int64)
    w[5] = 4
    t = Tree(x, w)
    n, _, i, j = dual(t, t, 0.9, True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    assert (n == hit @ w).all() and hit[i, j].all()
    a, b = Tree(x[:50], w[:50]), Tree(x[50:], w[50:])
    na, nb, i, j = dual(a, b, 0.9, False)
    assert (na == hit[:50, 50:] @ w[50:]).all() and (nb == hit[50:, :50] @ w[:50]).all() and hit[i, 50 + j].all()


def test_clusters_leave_most_block_pairs_closed(spark):
    rng = np.random.default_rng(4)
    centres = unit(rng.normal(size=(40, 32)))
    x = centres[rng.integers(0, 40, 2400)] + rng.normal(size=(2400, 32)) * rng.choice([0.004, 0.02, 0.04], 2400)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_near_dups(df, block_rows=64, report=report).collect()}
    u = unit(x)
    near = u @ u.T >= 0.9
    assert [got[k][0] for k in range(2400)] == (near.sum(1) - 1).tolist()
    # of all pairs of blocks few are open, so a vector goes to few blocks
    every = report["blocks"] * (report["blocks"] + 1) // 2
    assert report["vectors"] == 2400 and report["blocks"] >= 40 and report["open"] < every / 8, report


def test_doubles_stay_doubles_and_null_ids(spark):
    a = [1.0, 0.0]
    b = [0.9, float(np.sqrt(1 - 0.81)) * (1 - 1e-9)]  # a cosine just above 0.9 that single precision can't tell
    c = [0.9, float(np.sqrt(1 - 0.81)) * (1 + 1e-9)]
    far = [1e300, 1e299]  # finite, but infinite in single precision
    rows = [(1, a), (2, b), (3, far), (4, [1e-300, 1e-301]), (None, far), (None, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"]) for r in embedding_near_dups(df).collect())
    # the null that links with others is in their component, the other alone
    assert [g[:2] for g in got] == [(0, 0), (0, 4), (1, 4), (2, 4), (3, 4), (4, 4)] and [g[2] for g in got[1:]] == [1] * 5 and got[0][2] is None
    two = spark.createDataFrame([(1, a), (2, c)], "vec_id long, embedding array<double>")
    assert [r["n_links"] for r in embedding_near_dups(two).collect()] == [0, 0]
