import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TOY = [(1, 4), (2, 0), (2, 1), (3, 0), (4, 2), (4, 3), (4, 5), (6, 2)]
MULTI = [(1, 4), (7, 0), (2, 1), (3, 0), (4, 2), (8, 3), (4, 5), (6, 2), (7, 3), (8, 9), (9, 0)]
