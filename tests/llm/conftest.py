import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} x{i % 13}" for i in range(20000))
#: Texts that operators must bear: null, empty, white space only, very long, without spaces, repeats, marks.
TEXTS = [
    None, "", " ", " \t\n ", "a", "a b", "The same text of several words here.", "The same text of several words here.", LONG, LONG, "x" * 30000,
    "tabs\tand  double  spaces \n\n lines", "emoji 😀 and ünïcödé ñandú", "日本 語 テキスト", "zero\x00byte", "mail a.b@c.de, 10.0.0.1 and +1 (017) 555-7713", "<|endoftext|> inside <s> text </s>", "  leading and trailing  ", "ALL CAPS!! ALL CAPS!!",
]
CLASHES = ("_key", "_text", "_size", "_turn", "_null", "_range", "_toxic", "row", "key", "sha", "target", "position", "size", "kept", "fp", "score", "label", "spans", "w0", "ids")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Odd texts, null ids and sources, a repeated row, and extra columns with names that operators use themselves."""
    rows = [(i, t, "en" if i % 3 else None, [None, "b", "a", "é"][i % 4], len(t) if t else None) for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "no id here", None, None, None), (100, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).coalesce(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(labels):
    return labels.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
