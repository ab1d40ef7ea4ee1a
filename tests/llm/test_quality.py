import random
from collections import Counter

from seamgraph.llm.quality import quality_filter, quality_rules


def brute(text):
    text = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    n = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for k, t in enumerate(zip(w, w[1:], w[2:])):
        if n[t] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark, table, words):
    rng = random.Random(8)
    texts = [None, "", " \n\t ", "one", "a b a b a b", "  x  y", "é" * 9 + "|#\n" * 3, "z " * 20_000]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "\t", "c ", "#", "漢"]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts += texts[-2:]
    got = {r["doc_id"]: r for r in quality_rules(table(texts)).collect()}
    for k, t in enumerate(texts):
        want = brute(t)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 2 * want[4] > want[0])
        assert not (r["base_failed"] and r["kept"])


def test_junk_goes_and_clean_documents_stay(spark, table, words):
    rng = random.Random(9)
    clean = [" ".join(rng.choices(words, k=400)) for _ in range(80)]
    clean = [c if brute(c)[4] * 2 <= brute(c)[0] else " ".join(f"{w}{k}" for k, w in enumerate(c.split())) for c in clean]
    junk = [" ".join(f"{w}{k}###" for k, w in enumerate(rng.choices(words, k=100))) for _ in range(12)]
    docs = table(clean + junk, langs=[None, "en"] * 46, sources=["a", None] * 46)
    kept = {r["doc_id"] for r in quality_filter(docs).collect()}
    assert kept == set(range(80))
    assert quality_filter(docs).columns == docs.columns
    assert quality_filter(docs.limit(0)).count() == 0 and quality_rules(docs.limit(0)).count() == 0
