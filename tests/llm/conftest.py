import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHES = ["key", "node", "sig", "h", "k", "stripe", "at", "mask", "_row", "_go", "line_no", "windows", "text_hash", "best", "n"]

EN = "The house of the old man stands near the river and there are many trees in the garden where children play all day long"
DE = "Der alte Mann wohnt in dem Haus am Fluss und im Garten stehen viele Bäume unter denen die Kinder den ganzen Tag spielen"
FR = "La maison du vieil homme est près de la rivière et il y a beaucoup d'arbres dans le jardin où les enfants jouent toute la journée"
ES = "La casa del hombre viejo está cerca del río y hay muchos árboles en el jardín donde los niños juegan durante todo el día"


def edge_rows():
    """Nulls in any column, empty and long texts, repeated rows, equal texts and one id with two texts."""
    long = " ".join(f"word{i}" for i in range(20_000))
    return [
        (1, EN, "en", "a", 10), (2, None, "en", "a", None), (3, "", "en", "b", 0), (None, EN, "en", "a", 10), (None, None, None, None, None), (4, EN, None, None, 10),
        (5, DE, "de", "b", 5), (5, DE, "de", "b", 5), (6, FR, "fr", None, 5), (6, ES, "es", "c", 5), (7, long, "en", "c", len(long)), (8, " \n\t ", "en", "a", 4), (9, "\n\n", "en", "a", 2), (10, "x", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), DOCS)
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
