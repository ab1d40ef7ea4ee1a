import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def words():
    return WORDS


@pytest.fixture
def table(spark):
    """Documents from texts (doc_id by place), with the table's other columns and one that clashes."""

    def make(texts, ids=None, langs=None, sources=None):
        n = len(texts)
        rows = [
            (ids[k] if ids else k, texts[k], langs[k] if langs else "en", sources[k] if sources else f"src{k % 3}", len(texts[k] or ""), "x") for k in range(n)
        ]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")

    return make
