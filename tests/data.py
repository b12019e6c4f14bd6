"""Small inputs for tests."""

from __future__ import annotations

import datetime as dt
import math

SCHEMA = "service string, pod string, node string, timestamp timestamp_ntz, cpuusage double, seq bigint"
START = dt.datetime(2023, 5, 17, 6, 0)

SAMPLE_CSV = """service,pod,node,timestamp,cpuusage
search,search-a,rack-7,2023-05-17 06:00:00,61.2
search,search-b,rack-9,2023-05-17 06:00:00,62.2
checkout,checkout-a,rack-7,2023-05-17 06:00:00,30.5
checkout,checkout-b,rack-9,2023-05-17 06:00:00,31.5
search,search-a,rack-7,2023-05-17 06:02:00,70.2
search,search-b,rack-9,2023-05-17 06:02:00,69.2
checkout,checkout-a,rack-7,2023-05-17 06:02:00,36.5
checkout,checkout-b,rack-9,2023-05-17 06:02:00,36.5
search,search-a,rack-7,2023-05-17 06:04:00,73.2
search,search-b,rack-9,2023-05-17 06:04:00,76.2
checkout,checkout-a,rack-7,2023-05-17 06:04:00,42.5
checkout,checkout-b,rack-9,2023-05-17 06:04:00,44.5
"""


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def points(spark, series, service="s", step_minutes=1.0):
    """``{pod: [values]}`` as samples, one per step."""
    rows, seq = [], 0
    for pod, values in series.items():
        for i, value in enumerate(values):
            rows.append((service, pod, "n", START + dt.timedelta(minutes=i * step_minutes), value, seq))
            seq += 1
    return frame(spark, rows)


def planted(spark, minutes=600):
    """Ten healthy pods, and one each that is flat, shifted, high for long, upside down, and spiky."""

    def curve(i, phase=0.0):
        return 35 + 10 * math.sin(2 * math.pi * i / minutes + phase)

    def noise(i, pod):
        return 0.3 * math.sin(i * 12.9898 + pod * 78.233)

    series = {f"ok-{p}": [curve(i) + noise(i, p) for i in range(minutes)] for p in range(10)}
    series["flat"] = [35.0] * minutes
    series["shifted"] = [curve(i) + 25 + noise(i, 11) for i in range(minutes)]
    series["high"] = [92 + noise(i, 12) if i < minutes * 2 // 3 else curve(i) for i in range(minutes)]
    series["inverted"] = [70 - curve(i) + noise(i, 13) for i in range(minutes)]
    series["spike"] = [curve(i) + noise(i, 14) + (45 if i == 300 else 0) for i in range(minutes)]
    return points(spark, series)


def tuples(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
