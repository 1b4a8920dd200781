import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[*]")
        .appName("farewise-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # Tests set their own checkpoint folder only where the session names none.
    from farewise.session import checkpoint_dir

    if checkpoint_dir(session) is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="farewise-ckpt-"))
    yield session


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="farewise-test-")
