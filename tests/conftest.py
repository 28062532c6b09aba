import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        # Hundreds of queries over kept tables run in this one session: their plans' texts would fill the driver's memory
        .config("spark.sql.maxPlanStringLength", "4000").config("spark.sql.debug.maxToStringFields", "5").config("spark.sql.ui.retainedExecutions", "5").config("spark.executorEnv.PYTHONPATH", str(Path(__file__).resolve().parents[1])).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def given_back():
    """What a test kept is given back, so that later plans are not compared with it."""
    yield
    from termweave.operators import retrieval

    retrieval.release()
