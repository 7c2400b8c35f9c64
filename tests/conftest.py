import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rinkflow.session import GROUP_ROWS_CONF, SMALL_ROWS_CONF, local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def tight(spark):
    """Limits so low that every group is hot and no side is small."""
    spark.conf.set(GROUP_ROWS_CONF, "7")
    spark.conf.set(SMALL_ROWS_CONF, "3")
    yield spark
    spark.conf.unset(GROUP_ROWS_CONF)
    spark.conf.unset(SMALL_ROWS_CONF)


@pytest.fixture
def hot_only(spark):
    """Every group is hot, sides may still be small."""
    spark.conf.set(GROUP_ROWS_CONF, "7")
    yield spark
    spark.conf.unset(GROUP_ROWS_CONF)
