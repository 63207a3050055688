import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, label int, kept boolean, class string"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    long = " ".join(f"w{i % 977} the q{i % 31}" for i in range(12_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    texts = [
        (1, base), (2, base.upper()), (3, base.replace("omega", "end")), (4, ""), (5, None), (6, long), (7, long + " tail"), (8, "one two"),
        (9, "one two"), (10, "!!! ???"), (11, "   \n\t "), (None, base), (None, None), (12, "日本語 текст 😀 naïve"), (13, "one two"), (13, "one two"),
        (13, base), (14, "all rights reserved, licensed under CC BY 4.0"),
    ]
    rows = [(i, t, None if i == 3 else "en", None if i in (3, 8) else f"s{(i or 0) % 3}", None if t is None else len(t), 9, "x", 1, True, "c") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture
def texts():
    return plain_texts
