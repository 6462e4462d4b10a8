import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codetally import Hierarchy  # noqa: E402

HEALTH = ["86100", "86101", "86102", "86210", "86220", "86230", "86900"]
PAIRS = (
    [("A", "01110"), ("A", "01420"), ("B", "05100")]
    + [("C", f"{d}100") for d in range(20, 30)]
    + [("K", "66210"), ("K", "66220"), ("K", "66290"), ("K", "66300")]
    + [("P", "85100"), ("P", "85590")]
    + [("Q", code) for code in HEALTH]
)


# Started on import: test modules build column expressions at module level.
SESSION = (
    SparkSession.builder.master("local[4]")
    .config("spark.sql.shuffle.partitions", "2")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def hierarchy(spark):
    return Hierarchy(spark.createDataFrame(PAIRS, "section string, code string"))


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column expression on a list of texts, in order."""

    def run(inputs, expression, column_type="string"):
        rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {column_type}")
        return [r.y for r in rows.select("i", expression.alias("y")).orderBy("i").collect()]

    return run
