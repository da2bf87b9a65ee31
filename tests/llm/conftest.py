import pytest

CLASHING = "score double, fp long, votes string, block int, word string, sequence_id long, component_id long, label int, `range` int, tail string"

LONG = " ".join(f"word{i % 9973} {'abc' * (i % 5)}" for i in range(40_000))
TEXTS = [
    "The cat sat on the mat. The cat sat on the mat again, and nobody minded it at all.",
    "The cat sat on the mat. The cat sat on the mat again, and nobody minded it at all.",
    None,
    "",
    "   \n\t ",
    "a",
    "<|endoftext|> Don't  panic!\n\n> quoted\n© 2020",
    "Ünïcödé ΣΑΣ İstanbul 北京 é 　x\x1cy  z ",
    "###\n###\n$$$ *** &&& |||",
    LONG,
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing names."""
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, "src", len(t or "") if i % 3 else None) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (7, "another text with the same id", None, None, -5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = [f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ")]
    return docs.selectExpr("*", *extra).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, edge):
    return spark.createDataFrame([], edge.schema)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def multiset(rows):
    return sorted(map(tuple, rows), key=repr)
