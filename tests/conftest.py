import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parcelscope.session import session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def ships(spark):
    from parcelscope.sources.sample import shipments

    return shipments(spark, SF_DIR)


@pytest.fixture
def column(spark):
    """Values of a column function over a list of texts."""

    def run(function, values, kind="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(at, value) for at, value in enumerate(values)], f"at int, v {kind}")
        found = rows.select("at", function(F.col("v")).alias("found")).orderBy("at").collect()
        return [row["found"] for row in found]

    return run
