import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sensorframe.session import build_session, release  # noqa: E402

ZERO = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def at(seconds: float) -> datetime:
    return ZERO + timedelta(seconds=seconds)


def seconds(moment: datetime) -> float:
    return (moment - ZERO).total_seconds()


@pytest.fixture(scope="session")
def series(spark):
    """Samples ``(stream, time, v, _pos)`` from ``{stream: [(second, value), ...]}``."""

    def build(**streams):
        rows = [
            (name, at(t), None if v is None else float(v), i)
            for name, points in streams.items()
            for i, (t, v) in enumerate(points)
        ]
        return spark.createDataFrame(rows, "stream string, time timestamp_ntz, v double, _pos bigint")

    return build
