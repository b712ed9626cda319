"""One local session for all tests; small order chunks so that keys cross chunk limits."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetcast.operators.ordered import CHUNKS_CONF  # noqa: E402
from fleetcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "fleetcast-tests",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def chunks(spark):
    """Force three order chunks (without it AQE puts such small inputs in one)."""
    spark.conf.set(CHUNKS_CONF, "3")
    yield
    spark.conf.unset(CHUNKS_CONF)
