import pytest

#: Nulls, empty and blank texts, ties, repeated rows, null ids and sources, a word without spaces, special strings.
ROWS = [
    (1, "The cat sat on the mat and looked at the moon.", "en", "b"),
    (2, "The cat  sat on\tthe mat and looked at the moon.", "en", "b"),
    (3, "the cat sat on the mat and looked at the moon!", "en", "a"),
    (3, "the cat sat on the mat and looked at the moon!", "en", "a"),
    (4, None, None, None),
    (5, "", "en", None),
    (6, " \t\n", "de", "a"),
    (7, "1234 5678 !!! ???", "de", "b"),
    (8, "Der Hund läuft über die Straße und bellt den Mond an.", "de", ""),
    (None, "Le chat est assis sur le tapis et regarde la lune.", "fr", "é"),
    (None, "Le chat est assis sur le tapis et regarde la lune.", "fr", "é"),
    (9, "El perro corre por la calle y ladra a la luna <|endoftext|> ▁ fin", "es", "b"),
    (10, "x" * 5000, None, "a"),
    (11, "It's O'Neil's — they'll've ÀÉÎ 漢字 \U0001F600 12½ Σας İ", "en", "a"),
    (12, "one", "en", "a"),
    (13, "one two", "en", "a"),
    (14, "ONE", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity, and extra columns whose names clash with common internal ones."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).select(
        "*", F.lit(1).alias("id"), F.lit("x").alias("key"), F.lit(2).alias("row"), F.lit(3).alias("n"), F.lit("y").alias("sha"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
