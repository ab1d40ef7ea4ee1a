import random

from seamgraph.llm.mixing import mix, mixed_documents, plan


def shares(sizes):
    """Targets by source: weights 5, 2, 1 in order, at most three times the size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        unit = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else unit * weight[s] for s in order}
        full |= over


def test_targets_and_takes(spark, table, words):
    rng = random.Random(2)
    texts = [None, "", " "] + [" ".join(rng.choices(words, k=rng.randint(1, 50))) for _ in range(300)]
    sources = [rng.choice(["b", "a", "é", "Z", None, "b", "b", "b", "tiny"] if k % 60 else ["tiny"]) for k in range(len(texts))]
    docs = table(texts, sources=sources)
    rows = plan(docs).collect()
    n = [len((t or "").split()) for t in texts]
    sizes = {s: sum(x for x, o in zip(n, sources) if o == s) for s in set(sources)}
    want = shares(sizes)
    for r in rows:
        assert (r["size"], r["source_size"]) == (n[r["doc_id"]], sizes[r["source"]]) and r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] == sum(c["words"] for c in r["copies"])
    for s in sizes:
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - want[s]) < 1 + 1e-6
    again = {r["doc_id"]: r["taken"] for r in plan(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_order_follows_the_schedule(spark, table, words):
    docs = table([" ".join(words) + f" {k}" for k in range(300)], sources=["a"] * 100 + ["b"] * 100 + ["c"] * 100)
    rows = [r for r in mix(docs).collect() if r["position"] is not None]
    assert rows == sorted(rows, key=lambda r: r["position"]) and rows[0]["position"] == 0
    half = max(r["position"] for r in rows) / 2
    early = {s: sum(c["words"] for r in rows if r["source"] == s for c in r["copies"] if c["position"] < half) for s in "abc"}
    late = {s: sum(c["words"] for r in rows if r["source"] == s for c in r["copies"] if c["position"] >= half) for s in "abc"}
    assert early["a"] > 1.2 * late["a"] and late["c"] > 1.2 * early["c"]  # a fades, c grows


def test_stream(spark, table, words):
    docs = table([" ".join(words)] * 4 + ["x y"] * 3 + [None], ids=[1, 1, 2, 3, 4, 5, 6, 7], sources=["a"] * 4 + ["b"] * 3 + ["b"])
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    taken = sum(r["taken"] for r in plan(docs).collect())
    assert sum(len(r["text"].split()) for r in rows) == taken and 7 not in {r["doc_id"] for r in rows}
    assert mixed_documents(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
    assert mix(table([None, ""])).count() == 2


def test_whole_copies(spark, table, words):
    texts = ["\n".join(words) + f"\n{k}" for k in range(3)]
    sizes = dict(a=2 * 21, b=21)
    docs = table(texts, sources=["a", "a", "b"])
    rows, cut = mixed_documents(docs, whole=True).collect(), mixed_documents(docs).collect()
    assert {r["text"] for r in cut} - set(texts) and {r["text"] for r in rows} <= set(texts)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    for s, target in shares(sizes).items():
        taken = sum(len(r["text"].split()) for r in rows if r["source"] == s)
        assert abs(taken - target) <= 21 / 2 + 1 and taken <= 3 * sizes[s]


def test_maps_and_long_texts(spark, words):
    long = " ".join(words * 20_000)
    rows = [(k, long if k == 0 else " ".join(words), "a", {"x": k}, [{"y": 1}]) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>, more array<map<string,int>>")
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mix(docs).collect()}
    assert taken[0][0] == len(words) * 20_000 and sum(t for _, t in taken.values()) == sum(s for s, _ in taken.values())
    out = mixed_documents(docs)
    assert out.columns == docs.columns and {tuple(r["extra"].items()) for r in out.collect()} == {(("x", k),) for k in range(3)}
