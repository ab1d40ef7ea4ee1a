import random

import xxhash

from seamgraph.llm import simhash as H
from seamgraph.llm.components import connected_components


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def groups(fps):
    """Least place in each group of fingerprints linked at three bits or fewer."""
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(fps))]


def test_fingerprints(spark, table, words):
    rng = random.Random(1)
    texts = [None, "", " ", "One", "one TWO", "É é a", "a b c d"] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in H.fingerprints(table(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [fingerprint(t) for t in texts]


def links(spark, fps, cap):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in H.near_groups(df, cell_cap=cap).collect()}
    assert [got[k] for k in range(len(fps))] == groups(fps)


def test_links_are_whole(spark):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    for _ in range(260):  # chains and clusters around what is there
        f = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << bit
        fps.append(f)
    rng.shuffle(fps)
    links(spark, fps, H.CELL_CAP)
    links(spark, fps, 8)  # hot cells are dealt in blocks


def test_coordinates_bound_the_distance():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 2000, dtype=np.uint64) for _ in range(2))
    got = H._manhattan(H._coordinates(a), H._coordinates(b))
    for x, y, d in zip(a.tolist(), b.tolist(), got.tolist()):
        own = sum(abs((x >> k & 3).bit_count() - (y >> k & 3).bit_count()) for k in range(0, 64, 2))
        assert d == own <= (x ^ y).bit_count()


def test_keep_one(spark, table, words):
    rng = random.Random(3)
    base = [" ".join(rng.choices(words, k=80)) for _ in range(5)]
    texts = base + base + [None, "", base[0]]
    docs = table(texts, ids=[*range(20, 25), *range(10, 15), None, None, None])
    kept = H.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, k) for k in range(10, 15)] + [(True, 0)]
    twice = H.keep_one(table([base[0], base[1], base[0]], ids=[5, 5, 9])).collect()
    assert sorted(r["text"] for r in twice) == sorted(base[:2])
    assert H.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(200)] + [(500, 500 + k) for k in range(1, 100)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(80)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long"), "t").collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for n, root in got.items():
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert root == min(seen)
    assert set(got) == {n for n in near if near[n] - {n}}
    assert connected_components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def test_long_texts_cross_the_chunk(spark, table, words):
    rng = random.Random(3)
    for n in (65_535, 65_536, 65_537, 65_538, 131_074):
        text = " ".join(rng.choices(words, k=n))
        assert H.fingerprint(text) & (1 << 64) - 1 == fingerprint(text)


def test_keep_one_with_maps(spark):
    rows = [(2, "a b c d", {"k": 1}), (1, "a b c d", None), (1, "a b c d", None), (None, "a b c d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    assert [r["doc_id"] for r in H.keep_one(docs).collect()] == [1]
