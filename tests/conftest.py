import os

import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def plain(value):
    """A value as text that is alike for both engines."""
    import math

    if value is None or (isinstance(value, float) and math.isnan(value)) or type(value).__name__ in ("NAType", "NaTType"):
        return "null"
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return "[" + ",".join(map(plain, value)) + "]"
    if type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype") or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))
