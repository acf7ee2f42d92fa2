import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH", ""))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(f"file://{shared}/rdd")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column, or a function of column x, over one row of named strings."""
    from pyspark.sql import functions as F

    def run(expression, **columns):
        expression = expression(F.col("x")) if callable(expression) else expression
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()] or [F.lit(1)])
        return row.select(expression.alias("v")).first()["v"]

    return run
