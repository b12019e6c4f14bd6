import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from fleetwatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "fleetwatch-tests", "local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def hot_limit(spark):
    """Make groups hot at a few rows, for one test."""

    def use(rows: int) -> None:
        spark.conf.set("spark.fleetwatch.hotRows", str(rows))

    yield use
    spark.conf.unset("spark.fleetwatch.hotRows")


@pytest.fixture
def no_broadcast(monkeypatch):
    """Make every table too big to broadcast, for one test."""
    monkeypatch.setattr("fleetwatch.operators.skew.BROADCAST_ROWS", 0)
