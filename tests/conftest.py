import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from corpusloom.session import build_session, ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Table (id, text) from a list of texts."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "id bigint, text string")

    return make


@pytest.fixture
def evaluate(texts):
    """Values of a column expression over a list of texts, in order."""

    def run(values, expression):
        rows = texts(values).select("id", expression.alias("out")).collect()
        return [row.out for row in sorted(rows, key=lambda r: r.id)]

    return run
