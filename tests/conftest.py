"""One local session for all tests."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

TESTS = Path(__file__).parent
os.environ["PYTHONPATH"] = f"{TESTS.parent}{os.pathsep}{TESTS}"  # for functions defined in tests

from compare import SMALL

from queuemill.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "queuemill-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from queuemill.plans.views import Tables

    return Tables(spark, SMALL)
