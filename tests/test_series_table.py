import uuid

import pytest
from data import planted, tuples
from pyspark.sql import functions as F

from fleetwatch.operators import series
from fleetwatch.operators.detector import Detector
from fleetwatch.sources.series_table import read_series_table, write_series_table


@pytest.fixture
def table(spark, tmp_path):
    """A function that stores samples in a new table."""
    def stored(samples, buckets=3):
        name = f"t_{uuid.uuid4().hex}"
        write_series_table(samples, name, buckets=buckets, path=str(tmp_path / name))
        return read_series_table(spark, name)

    return stored


def _figures(rows, scope="full"):
    """Plan of the three figure tables together, as the detector writes them."""
    detector = Detector(series.scoped(rows, scope))
    frames = [detector._pod_figures(), detector._bucket_levels(), detector._high_stretches()]
    union = frames[0].select("pod")
    for frame in frames[1:]:
        union = union.unionAll(frame.select("pod"))
    union.collect()
    return union._jdf.queryExecution().executedPlan().toString()


def _nodes(plan, kind):
    """Nodes of the plan that ran, without the plan as it first was."""
    ran = plan.split("== Initial Plan ==")[0]
    return [line for line in ran.splitlines() if line.lstrip(" :+-*()0123456789").startswith(kind)]


def test_figures_need_no_exchange_and_no_sort(spark, table):
    samples = planted(spark, 120)
    plan = _figures(table(samples))
    assert not _nodes(plan, "Exchange ") and not _nodes(plan, "Sort ")
    assert _nodes(plan, "Window ") and "Bucketed: true" in plan
    plain = _figures(samples)
    assert _nodes(plain, "Exchange ") and _nodes(plain, "Sort ")


def test_windowed_figures_need_no_more_sorts(spark, table):
    """Numbering, smoothing and stretches go by one order: of a table none is sorted, of other samples each branch once."""
    samples = planted(spark, 600)
    plan = _figures(table(samples), "window")
    assert not [line for line in _nodes(plan, "Exchange ") if "pod#" in line]  # the windows of the services are few rows
    assert not _nodes(plan, "Sort ")
    assert len(_nodes(_figures(samples, "window"), "Sort ")) <= 3


@pytest.mark.parametrize("scope", ["full", "window"])
def test_same_findings(spark, table, scope):
    samples = planted(spark, 600)
    columns = ["service", "pod", "rule", "path"]
    expected = tuples(Detector(series.scoped(samples, scope)).findings(), *columns)
    assert expected
    assert tuples(Detector(series.scoped(table(samples), scope)).findings(), *columns) == expected


def test_hot_series(spark, table, hot_limit):
    samples = planted(spark, 120)
    columns = ["service", "pod", "rule", "path"]
    expected = tuples(Detector(series.scoped(samples, "full")).findings(), *columns)
    hot_limit(50)
    assert tuples(Detector(series.scoped(table(samples), "full")).findings(), *columns) == expected


def test_rows_without_a_place_are_left_out(spark, table):
    samples = planted(spark, 20)
    one = samples.limit(1)
    odd = one.withColumn("pod", F.lit(None).cast("string")).unionByName(one.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")))
    assert table(samples.unionByName(odd)).count() == samples.count()
    assert table(samples.limit(0)).count() == 0


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("fleetwatch.sources.series_table.BUCKET_ROWS", 20)
    samples = planted(spark, 20)
    name = f"t_{uuid.uuid4().hex}"
    write_series_table(samples, name, path=str(tmp_path / name))
    found = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {name}").select("col_name", "data_type").collect()}
    assert int(found["Num Buckets"]) == max(8, -(-samples.count() // 20))
