import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from askloom.session import get_spark

    s = get_spark(
        "tests", "local[8]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column expression over one string."""
    from pyspark.sql import functions as F

    def run(value, expr):
        return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]

    return run
