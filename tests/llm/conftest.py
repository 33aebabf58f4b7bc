import pytest

TEXT = "the quick brown fox jumps over the lazy dog and runs into the dark wood before night"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, tied and repeated texts."""
    return [(1, TEXT), (1, TEXT), (2, TEXT.upper()), (3, None), (4, ""), (5, "  \n\t "), (6, LONG), (7, "Ümläut Straße 東京 🎉 the"), (8, "one"), (9, "1234 !! ##"), (None, TEXT + " again"), (10, TEXT + " again")]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same with a lang, and columns whose names operators use inside."""
    rows = [(i, t, "en" if t and i != 7 else None, "s", len(t or ""), "x", 0.5, 1, [1]) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, score double, n_tokens int, terms array<int>").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf001(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.fixture(scope="session")
def sf01(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ids(rows, column="doc_id"):
    return sorted((r[column] for r in rows), key=lambda x: (x is None, x))
