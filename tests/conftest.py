import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from codeloom.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Make a files table from {path: content}."""
    def make(contents, project="p"):
        from codeloom.functions import paths
        from pyspark.sql import functions as F

        rows = [(project, path, len(text.encode()), text) for path, text in contents.items()]
        df = spark.createDataFrame(rows, "project string, path string, size long, content string")
        return df.withColumn("ext", paths.extension(F.col("path")))

    return make
