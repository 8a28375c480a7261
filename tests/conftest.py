import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def engine(spark, tmp_path):
    from ferrule import Engine

    e = Engine.open(spark, f"file://{tmp_path}/db")
    yield e
    e.close()


@pytest.fixture
def moons(engine):
    engine.execute("CREATE TABLE moons (id INT, days INT, name VARCHAR)")
    engine.execute("INSERT INTO moons VALUES (1, 9, 'ariel'), (2, 3, 'dione'), (3, 14, 'oberon'), (4, 8, 'titania')")
    return engine
