import os
import tempfile

import pytest

os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-")
    one = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", folder).config("spark.local.dir", folder).config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    one.sparkContext.setLogLevel("ERROR")
    yield one
    one.stop()
