import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    session = build_session("tidemark-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def blocks(spark):
    """Force every ordered scan to cut its large groups into blocks."""
    spark.conf.set("spark.tidemark.scanBlocks", "5")
    yield 5
    spark.conf.unset("spark.tidemark.scanBlocks")
