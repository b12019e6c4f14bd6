import datetime as dt
import re

import pytest
from data import SAMPLE_CSV, START, frame, points, tuples

from fleetwatch.operators import charts, series
from fleetwatch.sources.samples import read_samples

MICRO = dt.timedelta(microseconds=1)
HOURS = dt.timedelta(hours=1)


@pytest.fixture
def sample(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(SAMPLE_CSV)
    return read_samples(spark, str(path))


def test_sample_statistics(sample):
    rows = {r.pod: (r.mean, r.max, r.min, r.std) for r in series.group_stats(sample).collect()}
    assert rows["checkout-a"] == pytest.approx((36.5, 42.5, 30.5, 6.0), abs=1e-6)
    assert rows["checkout-b"] == pytest.approx((37.5, 44.5, 31.5, 6.557439), abs=1e-6)
    assert rows["search-a"] == pytest.approx((68.2, 73.2, 61.2, 6.244998), abs=1e-6)
    assert rows["search-b"] == pytest.approx((69.2, 76.2, 62.2, 7.0), abs=1e-6)


def test_sample_window_and_rows(sample):
    end = START + dt.timedelta(minutes=4)
    assert tuples(series.service_window(sample)) == [("checkout", START, end), ("search", START, end)]
    rows = series.scoped(sample).rows
    assert rows.count() == 8
    assert {r.timestamp for r in rows.collect()} == {START, end}
    assert [t for _, t, _ in tuples(charts.chart_ticks(series.service_window(sample)))] == [START, START]


def at(spark, offsets, pod="p"):
    return frame(spark, [("s", pod, "n", START + o if o is not None else None, float(i), i) for i, o in enumerate(offsets)])


def test_span_of_exactly_eight_hours_is_kept(spark):
    assert tuples(series.service_window(at(spark, [0 * HOURS, 8 * HOURS]))) == [("s", START, START + 8 * HOURS)]


def test_longer_span_is_cut_to_eight_hours(spark):
    start, end = tuples(series.service_window(at(spark, [0 * HOURS, 8 * HOURS + MICRO])), "window_start", "window_end")[0]
    assert (start, end) == (START + MICRO, START + 8 * HOURS + MICRO)  # 0.64 of a microsecond, rounded
    start, end = tuples(series.service_window(at(spark, [0 * HOURS, 18 * HOURS])), "window_start", "window_end")[0]
    assert start == START + dt.timedelta(microseconds=round(0.6394267984578837 * 10 * 3.6e9))
    assert end - start == 8 * HOURS


def test_window_covers_all_pods_of_a_service_and_keeps_both_ends(spark):
    one = at(spark, [0 * HOURS, 1 * HOURS], "a").unionByName(at(spark, [2 * HOURS, None], "b"))
    cut = series.window_cut(one, series.window_bounds(series.profile(one)))
    assert {r.timestamp for r in cut.collect()} == {START, START + HOURS, START + 2 * HOURS}


def test_missing_keys_are_dropped_and_missing_times_are_counted(spark):
    rows = [("s", None, "n", START, 1.0, 0), (None, "p", "n", START, 1.0, 1), ("s", "p", None, START, 1.0, 2),
            ("s", "p", "n", None, 5.0, 3), ("s", "p", "n", START, None, 4)]
    assert tuples(series.group_sizes(frame(spark, rows))) == [("s", "p", "n", 2, 1, START, START)]


def test_single_value_has_no_deviation(spark):
    assert series.group_stats(points(spark, {"p": [3.0]})).first()["std"] is None


@pytest.mark.parametrize("count,every", [(1, 2), (2, 2), (5, 2), (6, 2), (7, 3)])
def test_downsampling_keeps_the_first_of_each(spark, count, every):
    kept = series.downsampled(points(spark, {"p": [float(i) for i in range(count)]}), every)
    assert [r.cpuusage for r in kept.orderBy("timestamp").collect()] == [float(i) for i in range(0, count, every)]


def test_downsampling_breaks_ties_by_sequence(spark):
    rows = [("s", "p", "n", START, float(i), i) for i in (3, 1, 2, 0)]
    assert sorted(r.seq for r in series.downsampled(frame(spark, rows)).collect()) == [0, 2]


def test_pod_without_rows_in_the_window_is_kept(spark):
    busy = points(spark, {"a": [float(i % 7) for i in range(20)]}, step_minutes=60)
    late = frame(spark, [("s", "b", "n", START, 1.0, 99)])
    samples = busy.unionByName(late)
    stats = {r.pod: r for r in series.window_stats(series.scoped(samples)).collect()}
    assert stats["b"].n_rows == 0 and stats["b"]["mean"] is None
    assert stats["a"].n_rows > 0


def test_full_scope(spark):
    samples = points(spark, {"a": [1.0] * 30}, step_minutes=60)
    assert series.scoped(samples, "full").rows.count() == 30
    with pytest.raises(ValueError, match="Unknown scope"):
        series.scoped(samples, "half")


def test_session_time_zone_does_not_matter(spark):
    """The night a clock is moved forward has no half past two there, but samples do."""
    night = dt.datetime(2024, 3, 10)
    rows = [("s", "p", "n", night + dt.timedelta(minutes=15 * i), 1.0, i) for i in range(17)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        windows = series.service_window(frame(spark, rows))
        labels = [r.tick_label for r in charts.chart_ticks(windows).orderBy("tick").collect()]
        hours = series.service_range(frame(spark, rows)).first().span_hours
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert labels == [f"2024-03-10 {i // 4:02d}:{i % 4 * 15:02d}" for i in range(17)]
    assert hours == 4.0


def test_chart_names(sample):
    row = charts.chart_meta(series.service_window(sample)).filter("service = 'checkout'").first()
    assert row.title == "CPU Usage Over Time - checkout\n(8-hour window with downsampled data)"
    assert (row.object_name, row.object_key) == ("cpu_usage_checkout", "output/anomalies/cpu_usage_checkout")


def test_window_needs_one_shuffle_after_the_cut(spark):
    """The cut happens where the rows lie; one shuffle and one sort place and thin out the rows."""
    samples = points(spark, {"a": [1.0] * 5, "b": [2.0] * 5})
    plan = series.scoped(samples).rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(service#\d+, pod#\d+, node#\d+", plan)) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1 and "BroadcastHashJoin" in plan
