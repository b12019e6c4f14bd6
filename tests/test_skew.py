"""Hot groups give the same results as ordinary ones, and as plain Python."""

import datetime as dt
import random
import statistics

import pytest
from data import START, frame, tuples
from pyspark.sql import functions as F

from fleetwatch.operators import series, texts
from fleetwatch.operators.detector import Detector
from fleetwatch.operators.ordering import positions, running_totals
from fleetwatch.operators.quantiles import group_medians
from fleetwatch.operators.skew import SLICE, cut_into_slices, find_hot, join_table
from fleetwatch.session import materialise


def skewed(spark, rows=900, seed=1):
    """A third of all rows in one pod, a tenth of these at one instant; some without time."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        pod = "p0" if i % 3 == 0 else f"p{rng.randint(1, 12)}"
        minute = 77 if pod == "p0" and rng.random() < 0.1 else rng.randint(0, 1200)
        ts = None if rng.random() < 0.03 else START + dt.timedelta(minutes=minute, microseconds=rng.randint(0, 3))
        out.append(("s" if pod != "p5" else "t", pod, "n", ts, round(rng.random() * 30, 1), i * (1 << 33) + rng.randint(0, 9)))
    return frame(spark, out)


KEYS = ["service", "pod", "node"]


def test_only_big_groups_are_hot(spark):
    df = skewed(spark)
    assert tuples(find_hot(df, KEYS, 100).table.df) == [("s", "p0", "n")]
    assert find_hot(df, KEYS, 1000).table is None


@pytest.mark.parametrize("limit", [20, 5, 1])
def test_positions(spark, limit):
    df = skewed(spark)
    got = positions(df, KEYS, ["timestamp", "seq"], find_hot(df, KEYS, limit)).collect()
    groups = {}
    for row in df.collect():
        groups.setdefault((row.service, row.pod, row.node), []).append(row)
    want = {
        r.seq: i
        for rows in groups.values()
        for i, r in enumerate(sorted(rows, key=lambda r: (r.timestamp is None, r.timestamp or START, r.seq)), 1)
    }
    assert {r.seq: r.pos for r in got} == want


def test_slices_rise_with_the_order_and_are_small(spark):
    df = skewed(spark).filter("pod = 'p0'")
    sliced = cut_into_slices(df, KEYS, ["timestamp", "seq"], 10)
    assert sliced.groupBy(SLICE).count().agg(F.max("count")).first()[0] <= 10
    rows = sorted(sliced.collect(), key=lambda r: (r.timestamp is None, r.timestamp or START, r.seq))
    numbers = [r[SLICE] for r in rows]
    assert numbers == sorted(numbers)


@pytest.mark.parametrize("tail", [0, 60])
def test_slices_follow_text_order(spark, tail):
    """Also where texts are longer than the measures reach: then they are not cut by later columns."""
    rng = random.Random(3)
    names = ["pre-" * 4 + "".join(rng.choice("abé€z-") for _ in range(rng.randint(0, 9))) + "x" * tail for _ in range(200)]
    rows = [("s", name, i) for i, name in enumerate(names)]
    df = spark.createDataFrame(rows, "service string, pod string, seq bigint")
    got = positions(df, ["service"], ["pod", "seq"], find_hot(df, ["service"], 7)).collect()
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1].encode(), r[2])), 1)}
    assert {r.seq: r.pos for r in got} == want


def test_running_totals(spark):
    df = skewed(spark).filter("timestamp IS NOT NULL").withColumn("w", F.col("seq") % 7)
    totals = {"upto": F.col("w")}
    order = ["timestamp", "seq"]
    plain = running_totals(df, ["service"], order, totals, find_hot(df, ["service"], 10_000))
    sliced = running_totals(df, ["service"], order, totals, find_hot(df, ["service"], 15))
    assert tuples(plain) == tuples(sliced)


@pytest.mark.parametrize("limit,hashed", [(10_000, True), (10_000, False), (40, True), (4, False)])
def test_medians(spark, monkeypatch, limit, hashed):
    if not hashed:
        monkeypatch.setattr("fleetwatch.operators.quantiles.PERCENTILE_ROWS", 0)
    df = skewed(spark).withColumn("cpuusage", F.when(F.col("seq") % 17 != 0, F.col("cpuusage")))
    got = group_medians(df, KEYS, {"cpuusage": "middle"}, find_hot(df, KEYS, limit), (F.count(F.lit(1)).alias("n"),))
    values = {}
    for r in df.collect():
        values.setdefault(r.pod, []).append(r.cpuusage)
    for row in got.collect():
        assert row.n == len(values[row.pod])
        assert row.middle == pytest.approx(statistics.median(v for v in values[row.pod] if v is not None))


def test_join_beyond_the_broadcast_bounds(spark, no_broadcast):
    df = skewed(spark)
    table = materialise(df.groupBy("service").agg(F.max("seq").alias("top")))
    joined = join_table(df, table, ["service"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().optimizedPlan().toString()
    tops = {r.service: r.top for r in table.df.collect()}
    assert tuples(joined, "seq", "top") == sorted(((r.seq, tops[r.service]) for r in df.collect()), key=repr)
    assert join_table(df.filter("false"), table, ["service"], how="left").count() == 0


def test_detector_with_hot_pods(spark, hot_limit, no_broadcast):
    samples = skewed(spark, 600).filter("timestamp IS NOT NULL")

    def results():
        detector = Detector(series.scoped(samples, "full"))
        rules = [detector.level(), detector.flat(), detector.high(), detector.shape()]
        return [tuples(r.withColumn("score", F.round("score", 6))) for r in rules]

    plain = results()
    hot_limit(60)
    assert results() == plain


def test_texts_with_hot_services(spark, hot_limit):
    samples = skewed(spark, 300)

    def result():
        return tuples(texts.service_texts(series.scoped(samples, hours=4), part_values=13))

    plain = result()
    hot_limit(9)
    assert result() == plain


def test_scratch_folder_is_the_one_the_session_names(spark):
    from fleetwatch.session import scratch_root

    named = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark)
    assert root.endswith(spark.sparkContext.applicationId)
    if named:
        assert root.startswith(named)


def test_slices_of_texts_with_a_long_common_beginning(spark):
    rows = [("s", "long-" * 40 + str(i), i) for i in range(100)]
    df = spark.createDataFrame(rows, "service string, pod string, seq bigint")
    sliced = cut_into_slices(df, ["service"], ["pod", "seq"], 10)
    assert sliced.groupBy(SLICE).count().agg(F.max("count")).first()[0] <= 10
    ordered = [r[SLICE] for r in sorted(sliced.collect(), key=lambda r: r.pod)]
    assert ordered == sorted(ordered)
