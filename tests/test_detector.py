import pytest
from data import SAMPLE_CSV, frame, planted, points, tuples
from pyspark.sql import functions as F

from fleetwatch.operators.answers import all_normal, anomalies
from fleetwatch.operators.detector import Detector, Thresholds
from fleetwatch.operators.series import scoped
from fleetwatch.sources.samples import read_samples


def flagged(scored):
    return {r.pod for r in scored.filter("flagged").collect()}


@pytest.fixture(scope="module")
def detector(spark):
    return Detector(scoped(planted(spark), "full"), limits=Thresholds(shape_minutes=15))


def test_planted_anomalies(detector):
    assert flagged(detector.level()) == {"shifted", "high"}
    assert flagged(detector.axis()) >= {"shifted", "high"}
    assert flagged(detector.flat()) == {"flat"}
    assert flagged(detector.high()) == {"high"}
    assert flagged(detector.shape()) == {"inverted"}
    found = {r.pod for r in anomalies(detector.findings()).collect()}
    assert found == {"flat", "shifted", "high", "inverted"}


def test_spike_is_smoothed_away(detector):
    assert detector.smoothed.filter("pod = 'spike'").agg(F.max("smooth")).first()[0] < 46


def test_planted_anomalies_after_downsampling(spark):
    found = anomalies(Detector(scoped(planted(spark)), limits=Thresholds(shape_minutes=15)).findings())
    pods = {r.pod for r in found.collect()}
    assert {"flat", "shifted", "high", "inverted"} <= pods and "spike" not in pods
    assert not any(p.startswith("ok-") for p in pods)


def test_row_order_does_not_matter(spark):
    samples = planted(spark, 120)
    shuffled = samples.repartition(7).orderBy(F.xxhash64("seq"))
    limits = Thresholds(shape_minutes=10)
    rounded = [
        tuples(Detector(scoped(s, "full"), limits=limits).findings().withColumn("score", F.round("score", 6)))
        for s in (samples, shuffled)
    ]
    assert rounded[0] == rounded[1]


def test_sample_is_all_normal(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(SAMPLE_CSV)
    found = anomalies(Detector(scoped(read_samples(spark, str(path)))).findings())
    assert tuples(found) == [] and all_normal(found).first()[0] is True


def test_constant_and_missing_values_do_not_fail(spark):
    samples = points(spark, {"a": [5.0] * 12, "b": [5.0] * 12, "c": [None] * 12, "d": [5.0]})
    found = Detector(scoped(samples, "full"), limits=Thresholds(shape_minutes=1)).findings()
    assert tuples(found) == []


def test_short_high_load_is_ignored(spark):
    low, busy = [20.0 + i % 3 for i in range(90)], [20.0 + i % 3 for i in range(90)]
    for i in range(10, 40):       # 30 values, 29 minutes from first to last
        busy[i] = 95.0 + i % 3
    series = {f"p{i}": low for i in range(4)} | {"busy": busy}
    assert flagged(Detector(scoped(points(spark, series), "full")).high()) == set()
    busy[40] = 95.0
    busy[41] = 96.0
    assert flagged(Detector(scoped(points(spark, series), "full")).high()) == {"busy"}


def test_high_service_is_not_flagged(spark):
    series = {f"p{i}": [90.0 + j % 4 for j in range(60)] for i in range(4)}
    assert flagged(Detector(scoped(points(spark, series), "full")).high()) == set()


def test_smoothing_at_the_ends(spark):
    got = Detector(scoped(points(spark, {"p": [90.0, 1.0, 2.0, 1.0, 2.0, 1.0]}), "full")).smoothed
    # first surroundings: 90, 1, 2 with median 2 and deviations 88, 1, 0
    assert [r.smooth for r in got.orderBy("timestamp").collect()] == [2.0, 1.0, 2.0, 1.0, 2.0, 1.0]


def test_no_rows(spark):
    assert tuples(Detector(scoped(frame(spark, []), "full")).findings()) == []


def test_a_gap_in_time_ends_a_stretch(spark):
    series = {"calm": [20.0] * 60, "other": [21.0] * 60, "sparse": [20.0] * 29 + [95.0, 95.0, 95.0] + [20.0] * 28}
    apart = points(spark, series, step_minutes=660.0)
    scores = {r.pod: (r.score, r.flagged) for r in Detector(scoped(apart, "full")).high().collect()}
    assert scores["sparse"] == (0.0, False)
    wider = Thresholds(high_gap_minutes=700)
    scores = {r.pod: (r.score, r.flagged) for r in Detector(scoped(apart, "full"), limits=wider).high().collect()}
    assert scores["sparse"] == (1320.0, True)


@pytest.mark.parametrize("scope", ["full", "window"])
def test_many_samples_are_spread_by_their_number(spark, monkeypatch, hot_limit, scope):
    """A task orders few series, however few bytes Spark's shuffle has; findings stay as they are, hot series or not."""
    samples = planted(spark, 240)

    def found():
        return sorted(map(str, tuples(Detector(scoped(samples, scope), limits=Thresholds(shape_minutes=15)).findings().withColumn("score", F.round("score", 6)))))

    plain = found()
    assert plain
    total = samples.count()
    monkeypatch.setattr("fleetwatch.operators.series.FEW_ROWS", 100)
    monkeypatch.setattr("fleetwatch.operators.series.TASK_ROWS", total // 20)
    assert scoped(samples, scope).rows.rdd.getNumPartitions() >= 20
    assert scoped(samples, scope, in_order=True).rows.rdd.getNumPartitions() < 20
    assert found() == plain
    hot_limit(100)
    assert scoped(samples, scope).hot.parts >= 20 and found() == plain
