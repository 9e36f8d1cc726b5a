import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from editwake.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("editwake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", os.environ.get("TEST_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


# Two revisions in the form of a diff file; the second is of the next day.
FIRST = "501\t7\t3\t'Sandbox'\t1014649222\tu'tidy up'\tTrue\tNone\tu'Editor One'\t12:1:u'Hello\\nworld [[a'\t30:-1:u'bye'"
SECOND = "502\t8\t0\tu'Other page'\t1014749333\tu'na\\u00efve'\tFalse\t42\tu'Editor Two'\t0:1:u'worldly Hell, oh'"


@pytest.fixture(scope="session")
def lines(spark):
    return spark.createDataFrame([(FIRST, None, "f", 0, 0), (SECOND, None, "f", 0, 1)], "value string, modified timestamp, file string, block long, line long")


@pytest.fixture(scope="session")
def revisions(lines):
    from editwake.sources.diff_files import parse_revisions

    return parse_revisions(lines)


def column(df, name=None):
    """The values of a column, sorted."""
    return sorted(row[name or 0] for row in df.collect())
