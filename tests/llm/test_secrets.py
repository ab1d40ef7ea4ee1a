import random
import re

from seamgraph.llm import secrets as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def entropy_sum(window):
    return sum(S.part(window.count(c)) for c in set(window))


def brute(text):
    text = text or ""
    base = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        c = m[0]
        if len(c) < 20 or any(re.search(p, c) for p in S.ALLOWED):
            continue
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", c) else "base64"
        hits = [k for k in range(len(c) - 19) if entropy_sum(c[k : k + 20]) <= S.most_sum(S.LEAST[kind])]
        if hits:
            a, b = m.start() + hits[0], m.start() + hits[-1] + 20
            if not any(x[0] <= a and b <= x[2] for x in base):
                more.append((a, 3, b, f"entropy_{kind}"))
    return sorted(base), sorted(base + more)


def test_against_brute_force(spark, table):
    rng = random.Random(3)
    signs = 'abcdef0123456789ABCDEFGHXYZ+/_=-."\' :\n漢é'
    parts = ["password", "Token", "api_key", "APIKEY", "secret=", "passwd :", "'", '"', ":", "=", "password=token: abcdefghijklmnopq", "word", "\U0001f600"]

    def piece():
        k = rng.randrange(5)
        if k == 0:
            return "AKIA" + "".join(rng.choices("ABC12", k=rng.randint(5, 20)))
        if k == 1:
            return "".join(rng.choices("abcdef0123456789", k=rng.randint(10, 50)))
        if k == 2:
            return "".join(rng.choices(S.ALPHABET, k=rng.randint(10, 60)))
        return rng.choice(parts)

    texts = [None, "", " ", "x" * 50_000, "ab12" * 5_000] + ["".join(rng.choices(signs, k=rng.randint(0, 200))) for _ in range(150)]
    texts += [" ".join(piece() for _ in range(20)) for _ in range(150)]
    texts += texts[-3:]
    got = {r["doc_id"]: r for r in S.secret_scan(table(texts)).collect()}
    assert len(got) == len(texts)
    found = 0
    for k, t in enumerate(texts):
        base, every = brute(t)
        assert [tuple(x) for x in got[k]["base"]] == base, t
        assert [tuple(x) for x in got[k]["found"]] == every, t
        found += len(every) - len(base)
    assert found > 20


def test_empty_table(spark, table):
    assert S.secret_scan(table(["a"]).limit(0)).count() == 0


def test_many_matches_in_one_text(spark, table):
    text = " ".join(f"token={k:012}ab {k:016x}" for k in range(4000))
    row = S.secret_scan(table([text])).first()
    base, every = brute(text)
    assert [tuple(x) for x in row["base"]] == base and [tuple(x) for x in row["found"]] == every and len(base) == 8000
