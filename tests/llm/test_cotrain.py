import random

from seamgraph.llm.cotrain import cotrain


def test_held_out_accuracy(spark, table, words):
    rng = random.Random(6)
    texts, y = [], []
    for k in range(400):
        good = rng.random() < 0.7
        w = rng.choices(words, k=60)
        texts.append("\n".join(" ".join(w[i : i + 20]) for i in (0, 20, 40)) if good else " ".join(f"{x.upper()}!!" for x in w))
        y.append(int(good))
    texts += [None, "", "same", "same"]
    docs = table(texts)
    labels = spark.createDataFrame([(k, y[k], 0) for k in range(0, 200)] + [(None, 1, 0), (201, None, 0), (202, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotrain(docs, labels, per_round=20).collect()}
    assert len(got) == len(texts)
    right = sum(got[k]["kept"] == bool(y[k]) for k in range(200, 400))
    assert right >= 194 and all(0 <= r["score"] <= 1 for r in got.values())
    assert cotrain(docs.limit(0), labels).count() == 0
    one = cotrain(docs, labels.filter("quality = 1"))
    assert one.filter("kept").count() == len(texts)


def test_against_plain_python(spark, table, words):
    """The whole of one round, step by step: features by string operations, then picks, fits and scores one by one."""
    import collections

    import numpy as np
    from seamgraph.llm import cotrain as C

    rng = random.Random(8)
    texts, y = [], []
    for k in range(120):
        good = k % 3 > 0
        w = rng.choices(words, k=rng.randint(5, 40))
        texts.append("\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) if good else " ".join(f"{x.upper()}!! 7" for x in w))
        y.append(int(good))
    sources = ["good" if v and rng.random() < 0.9 else "bad" for v in y]
    docs = table(texts, sources=sources)
    labels = spark.createDataFrame([(k, y[k]) for k in range(48)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in C.cotrain(docs, labels, rounds=1, per_round=12).collect()}

    def features(text):
        """{slot: value} of the content view."""
        raw = text.encode()
        w = raw.split()
        counts = collections.Counter()
        for word in w:
            h = sum((c + 33 if 65 <= c <= 90 else c + 1) * pow(C._BASE, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)
            h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) % (1 << 64)
            kind = [0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if 33 <= c < 127 else 4 for c in word]
            form = (((kind[0] * 5 + kind[min(1, len(word) - 1)]) * 5 + kind[max(0, len(word) - 2)]) * 5 + kind[-1]) * 16 + min(len(word), 15)
            counts[C._WORDS + (h ^ (h >> 29)) % C._HALF] += 1
            counts[C._WORDS + C._HALF + form * 40503 % C._HALF] += 1
        norm = sum(np.log1p(n) ** 2 for n in counts.values()) ** 0.5
        out = {s: np.log1p(n) / norm for s, n in counts.items()}
        rates, layout, *_ = C.content(text)
        return out | dict(enumerate(rates)) | {int(s): 1.0 for s in layout}

    rows = [[features(t) for t in texts], [dict.fromkeys(C.metadata("en", s, len(t)).tolist(), 1.0) for t, s in zip(texts, sources)]]
    dot = lambda row, w: sum(v * w[s] for s, v in row.items())

    def fit(data, goal, weight):
        w, m, v = np.zeros(C.DIM), np.zeros(C.DIM), np.zeros(C.DIM)
        weight = np.array(weight) / sum(weight)
        for t in range(1, 251):
            g = 1e-4 * w
            for row, target, share in zip(data, goal, weight):
                d = (1 / (1 + np.exp(-np.clip(dot(row, w), -30, 30))) - target) * share
                for s, x in row.items():
                    g[s] += d * x
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return w

    hashes = lambda seed, ids: {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("i", f"xxhash64({seed}, i)").collect()}
    order = hashes("1", range(48))
    known = sorted(range(48), key=lambda i: order[i])
    train = [i for k, i in enumerate(known) if k % C.HOLD < C.HOLD - 1]
    held = [i for k, i in enumerate(known) if k % C.HOLD == C.HOLD - 1]
    data, goal, weight = [[r[i] for i in train] for r in rows], [[y[i] for i in train] for _ in rows], [[1.0] * len(train) for _ in rows]
    share = sum(goal[0]) / len(goal[0])
    w = [fit(*x) for x in zip(data, goal, weight)]
    for view in (0, 1):
        place = hashes(f"0, {view}", range(48, 120))
        picks = []
        for label in (0, 1):
            sure = [i for i in range(48, 120) if (dot(rows[view][i], w[view]) > 1 if label else dot(rows[view][i], w[view]) < -1)]
            picks += [(i, label) for i in sorted(sure, key=lambda i: place[i])[: max(1, round(12 * (share if label else 1 - share)))]]
        for i, label in sorted(picks):
            data[1 - view].append(rows[1 - view][i])
            goal[1 - view].append(label)
            weight[1 - view].append(0.5)
    assert len(data[0]) > len(train) and len(data[1]) > len(train)
    w = [fit(*x) for x in zip(data, goal, weight)]
    fits = [C.calibrate(np.array([dot(rows[v][i], w[v]) for i in held]), np.array([y[i] for i in held], float)) for v in (0, 1)]
    base = sum(y[:48]) / 48
    prior, best = np.log(base / (1 - base)), max(f[2] for f in fits)
    for k in range(120):
        odds = [f[0] * dot(rows[v][k], w[v]) + f[1] for v, f in enumerate(fits)]
        mixed = prior + sum((o - prior) * f[2] / best for o, f in zip(odds, fits))
        assert abs(got[k]["content"] - odds[0]) < 1e-3 and abs(got[k]["metadata"] - odds[1]) < 1e-3
        assert abs(got[k]["score"] - 1 / (1 + np.exp(-mixed))) < 1e-3


def test_words_stay_whole_across_blocks():
    import numpy as np
    from seamgraph.llm import cotrain as C

    word = "a" * 40
    pad = "é " * ((C._BLOCK - 20) // 3)
    text = pad + word + " end " + "b" * (C._BLOCK * 2 + 7) + " tail"
    h, _ = C._hashed(text.encode())
    assert len(h) == len(text.split())
    one = lambda t: C._hashed(t.encode())[0][0]
    n = len(pad.split())
    assert h[n] == one(word) and h[n + 1] == one("end") and h[n + 2] == one("b" * (C._BLOCK * 2 + 7)) and h[n + 3] == one("tail")
    assert np.unique(h).size == 5


def test_a_label_that_repeats_among_documents_counts_once(spark, table, words):
    from seamgraph.llm import cotrain as C

    texts = [" ".join(words), "BAD!! " * 9, "other words"] + [f"copy {k % 2}" for k in range(500)]
    docs = table(texts, ids=[1, 2, 3] + [4] * 500)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    some = C._labelled(C._features(docs), labels, 3)
    assert some.count() == 3 and some.select("_id").distinct().count() == 3
    every = {r["_id"]: (r["_y"], r["_h"]) for r in C._labelled(C._features(docs), labels, 100).collect()}
    assert {k: v[0] for k, v in every.items()} == {1: 1, 2: 0, 3: 1, 4: 0}
    least = C._features(docs).filter("_id = 4").agg({"_h": "min"}).first()[0]
    assert every[4][1] == least
    first, again = (sorted(map(tuple, C.cotrain(d, labels).collect())) for d in (docs, docs.repartition(5)))
    assert first == again and len(first) == len(texts)
