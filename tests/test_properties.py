"""Properties that hold for any samples. Each example is one Spark run over many random pods."""

import datetime as dt
import math
from collections import Counter

from data import START, frame, points
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from fleetwatch.operators.detector import Detector
from fleetwatch.operators.series import profile, scoped, service_window, window_bounds, window_cut

few = settings(
    max_examples=3, deadline=None, phases=[Phase.generate], derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)

moments = st.lists(
    st.tuples(st.sampled_from("ab"), st.integers(0, 4), st.integers(0, 20 * 3600 * 1_000_000)), min_size=1, max_size=80
)


def samples_at(spark, rows):
    return frame(spark, [
        (service, f"p{pod}", "n", START + dt.timedelta(microseconds=at), float(i % 13), i)
        for i, (service, pod, at) in enumerate(rows)
    ])


@few
@given(rows=moments)
def test_windows_and_downsampling(spark, rows):
    samples = samples_at(spark, rows)
    ends = {}
    for service, _, at in rows:
        low, high = ends.get(service, (at, at))
        ends[service] = (min(low, at), max(high, at))
    for row in service_window(samples).collect():
        low, high = (START + dt.timedelta(microseconds=t) for t in ends[row.service])
        length = row.window_end - row.window_start
        assert length == min(high - low, dt.timedelta(hours=8))
        assert low <= row.window_start and row.window_end <= high

    profiled = profile(samples)
    inside = Counter((r.service, r.pod) for r in window_cut(samples, window_bounds(profiled)).collect())
    kept = Counter((r.service, r.pod) for r in scoped(samples, profiled=profiled).rows.collect())
    assert kept == Counter({k: math.ceil(n / 2) for k, n in inside.items()})


@few
@given(
    curve=st.lists(st.integers(20, 40), min_size=20, max_size=40), where=st.integers(5, 14), height=st.integers(30, 60)
)
def test_one_spike_does_not_make_a_level(spark, curve, where, height):
    steady = [float(20 + i % 4) for i in range(len(curve))]
    calm = {f"p{i}": [v + i for v in steady] for i in range(5)}
    spiky = dict(calm, p2=[v + height if i == where else v for i, v in enumerate(calm["p2"])])

    both = points(spark, calm, "calm").unionByName(points(spark, spiky, "spiky"))
    rows = Detector(scoped(both, "full")).level().collect()
    flags = {(r.service, r.pod): r.flagged for r in rows}
    assert len(flags) == 10 and not any(flags.values())
