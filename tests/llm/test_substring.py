import random
from collections import Counter

from seamgraph.llm.substring import substring_dedup


def brute(rows, size):
    w = [(t or "").encode().split() for t in rows]
    n = Counter(tuple(x[k : k + size]) for x in w for k in range(len(x) - size + 1))
    out = []
    for x in w:
        gone = set()
        for k in range(len(x) - size + 1):
            if n[tuple(x[k : k + size])] > 1:
                gone |= set(range(k, k + size))
        out.append((len(x), len(gone), b" ".join(v for k, v in enumerate(x) if k not in gone).decode()))
    return out


def check(table, texts, size, ids=None):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup(table(texts, ids), size).collect())
    ids = ids or list(range(len(texts)))
    want = sorted((i is None, i or 0, *b) for i, b in zip(ids, brute(texts, size)))
    assert got == want


def test_against_brute_force(spark, table, words):
    rng = random.Random(4)
    shared = [" ".join(rng.choices(words, k=rng.randint(30, 80))) for _ in range(6)]
    texts = [None, "", "x", " ".join(["same"] * 200), " ".join(["same"] * 90 + ["end"]), "a b " * 60]
    for _ in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared) if rng.random() < 0.6 else "")
        texts.append(rng.choice([" ", "\n", "\t \r\n"]).join(parts))
    base = " ".join(f"w{k}" for k in range(300)).split()
    for k in range(12):  # near copies
        own = list(base)
        own[rng.randrange(300)] = f"edit{k}"
        texts.append(" ".join(own))
    texts += texts[30:34]
    check(table, texts, 35)


def test_small_windows_and_tight_alphabets(spark, table):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 80))) for _ in range(60)]
    check(table, texts, 12)


def test_repeated_rows_null_ids_and_nothing(spark, table):
    long = " ".join(f"w{k}" for k in range(50))
    check(table, [long, long, None, long + " tail", " ".join(f"v{k}" for k in range(60))], 35, ids=[None, None, 7, 7, 7])
    assert substring_dedup(table(["a"]).limit(0)).count() == 0


def test_wide_windows(spark, table):
    """Contexts of more words than a byte can count."""
    shared = [f"w{k % 300}" if k < 300 else "same" for k in range(450)]
    check(table, [" ".join(["a", *shared, "b"]), " ".join(["c", *shared, "d"]), " ".join(shared[:199]), " ".join(shared[:200])], 200)


def test_many_copies_of_one_row_cost_as_many_rows(spark, table):
    from pyspark.sql import functions as F
    from seamgraph.llm import substring as S

    text = " ".join(f"w{k}" for k in range(300))
    docs = table([text] * 1000 + [text + " tail", "head " + text], ids=[None] * 1002)
    assert S._texts(docs).count() == 3
    got = substring_dedup(docs).groupBy("n_words", "n_removed").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(300, 300, 1000), (301, 300, 2)]


def test_long_texts_and_shared_symbols(spark, table):
    """A text longer than a worker parses at a time; long repeats are revealed by shared symbols alone."""
    from seamgraph.llm import substring as S

    rng = random.Random(9)
    long = [f"v{rng.randrange(10**7)}" for _ in range(S.AT_ONCE + 5000)]
    part = long[1000:5000]
    docs = table([" ".join(long), " ".join(["x", *part, "y"])])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect()}
    assert got == {0: (S.AT_ONCE + 5000, 4000), 1: (4002, 4000)}
    state = S._recompressed(S._texts(docs), 35)
    shown = S._revealed(state, 35).selectExpr("aggregate(transform(settled, r -> r.n), 0, (a, b) -> a + b) AS n").collect()
    assert all(r["n"] > 2500 for r in shown)  # of 3,966 windows each; those at the symbols' seams are verified by words
