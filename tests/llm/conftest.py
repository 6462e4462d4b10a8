import random

import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone bridge castle window garden silver yellow market number seven people water mountain letter paper".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Texts that tend to break things: null, empty, white space, repeats, odd characters, long ones."""
    long_one = prose(4000, 1)
    passage = prose(60, 2)
    texts = [
        None, "", " \t\n", "one", "Two Words", "Two Words", prose(80, 3), prose(80, 3), prose(20, 4) + " " + passage + " " + prose(20, 5),
        passage + " " + prose(30, 6), long_one, long_one.upper(), "x" * 30000, "\u00e9t\u00e9 na\u00efve \u65e5\u672c\u8a9e \U0001f600 <|endoftext|> \u00a0 \x85 \x1c done",
        prose(34, 7), prose(35, 7), "a b a b " * 40, "1.2.3.4 me@example.org +49 30 1234567 4111 1111 1111 1111",
    ]
    return texts


@pytest.fixture(scope="session")
def documents(spark: SparkSession, awkward):
    """The awkward texts as documents, one row twice, and one without id."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(awkward)]
    rows += [rows[6], (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def tables(spark, tmp_path):
    """Write DataFrames as the tables of a folder."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
