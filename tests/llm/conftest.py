import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again"), (2, ""), (3, None), (4, "   \n\t  "), (5, "one"),
    (6, "The quick brown fox jumps over the lazy dog again and again"), (6, "The quick brown fox jumps over the lazy dog again and again"),
    (None, "no id here at all, but five words"), (7, "x" * 30_000), (8, "Ünïcode ΑΣ ΑΣ. İ é nb  two  spaces\n\nlines <|endoftext|> 'S 12³ 中文字 🙂"),
    (9, " ".join(f"w{i % 977}" for i in range(20_000))), (10, "Mail a.b@example.com or +1 (705) 555-5569, card 4400896270136251, 1.43.173.185."),
]


@pytest.fixture(autouse=True)
def pii_key(spark):
    """The session's key is the tests' own; without one a session draws it at random, and no test could tell what is written."""
    spark.conf.set("spark.pairlens.pii.key", "a key of tests")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use inside."""
    rows = [(i, t, "en", "src", None if t is None else len(t), "x", 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string, n_tokens int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
