"""The pipeline on a small table against the stages' brute-force versions, one on top of the other."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_linededup import brute as without_lines  # noqa: E402
from seamgraph.llm.mixing import plan  # noqa: E402
from tests.llm.test_mixing import shares  # noqa: E402
from tests.llm.test_simhash import fingerprint, groups  # noqa: E402


def test_stages(spark, table, words, tmp_path):
    rng = random.Random(1)
    line = lambda: " ".join(f"{w}{rng.randrange(99)}" for w in rng.choices(words, k=20))
    shared = [line() for _ in range(4)]
    texts = []
    for k in range(60):
        own = [line() for _ in range(4)] + (shared if k % 5 == 0 else [])
        texts.append("\n".join(own))
    texts += texts[10:14] + ["too short", None, "", "### " * 80]
    table(texts).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["quality rules"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in clean.collect()) == list(range(64))
    cut = stages["line dedup"](spark, clean, str(tmp_path))
    rows = {r["doc_id"]: r for r in cut.collect()}
    want, _ = without_lines(texts[:64])
    assert [rows[k]["text"] for k in range(64)] == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values()) and cut.columns == docs.columns
    one = stages["SimHash near-dedup"](spark, cut, str(tmp_path))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups([fingerprint(t) for t in want])))
    left = sorted(r["doc_id"] for r in one.collect())
    mixed = stages["source mixing"](spark, one, str(tmp_path))
    assert mixed.columns == docs.columns
    # copies by brute force: the stream of a source, in the plan's order, is repeated until the target is taken; the last
    # copy is whole where that is nearer
    size = {k: len(want[k].split()) for k in left}
    source = {k: f"src{k % 3}" for k in left}
    target = shares({s: sum(size[k] for k in left if source[k] == s) for s in set(source.values())})
    placed = {r["doc_id"]: r for r in plan(one).collect()}
    copies = {}
    for s in target:
        own = sorted((k for k in left if source[k] == s), key=lambda k: placed[k]["copies"][0]["position"] if placed[k]["copies"] else float("inf"))
        total, room = sum(size[k] for k in own), int(target[s] + 1e-9)
        full, rest = divmod(room, total)
        for k in own:
            part = max(0, min(size[k], rest))
            rest -= size[k]
            copies[k] = full + (part * 2 >= size[k] and part > 0) if size[k] else 0
    stream = [r["doc_id"] for r in mixed.collect()]
    assert {k: stream.count(k) for k in left} == copies
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {(k, want[k]) for k in left}
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(stream)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows:
        ids = library.encode(want[r["doc_id"]])
        digest = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (r["ids"], r["n_tokens"], r["decoded_sha256"]) == (ids, len(ids), digest)


def test_nothing_and_extra_columns(spark, table, tmp_path):
    docs = table(["a b c"]).selectExpr("*", "map('k', 1) AS extra")
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs.write.parquet(str(tmp_path / "short" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "short")).count() == 0  # too short for the rules
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
