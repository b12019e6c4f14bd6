import json

from data import SAMPLE_CSV, planted, tuples

from fleetwatch.operators.detector import Thresholds
from fleetwatch.streaming.watch import watch

HEAD = "cpuusage,service,pod,node,timestamp\n"


def planted_csv(spark):
    rows = planted(spark, 120).collect()
    return HEAD + "".join(f"{r.cpuusage},{r.service},{r.pod},{r.node},{r.timestamp}\n" for r in rows)


def run(spark, tmp_path):
    query = watch(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), limits=Thresholds(shape_minutes=5)
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def statuses(spark, tmp_path):
    rows = spark.read.json(str(tmp_path / "out" / "status")).collect()
    return {r.source_file.rsplit("/", 1)[1]: (r.statusCode, json.loads(r.body)) for r in rows}


def test_each_file_is_analysed_once_and_on_its_own(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "calm.csv").write_text(SAMPLE_CSV)
    (tmp_path / "in" / "busy.csv").write_text(planted_csv(spark))
    (tmp_path / "in" / "notes.txt").write_text("no samples")
    run(spark, tmp_path)
    first = statuses(spark, tmp_path)
    assert set(first) == {"calm.csv", "busy.csv"}
    assert first["calm.csv"][1]["all_normal"] is True and first["busy.csv"][1]["all_normal"] is False
    found = spark.read.parquet(str(tmp_path / "out" / "anomalies"))
    assert {"flat", "shifted", "high"} <= {r.pod for r in found.collect()}
    assert {r.source_file.rsplit("/", 1)[1] for r in found.collect()} == {"busy.csv"}
    charts = spark.read.parquet(str(tmp_path / "out" / "charts"))
    assert {s for (s,) in tuples(charts.select("service").distinct())} == {"s"}

    run(spark, tmp_path)  # nothing new
    assert statuses(spark, tmp_path) == first

    # files that cannot be read get a status of their own and do not stop the others
    (tmp_path / "in" / "a b.csv").write_text(SAMPLE_CSV)
    (tmp_path / "in" / "columns.csv").write_text("service,pod\ns,p\n")
    (tmp_path / "in" / "empty.csv").write_text("")  # Spark does not deliver files without content
    (tmp_path / "in" / "times.csv").write_text(HEAD + "1,s,p,n,yesterday\n")
    run(spark, tmp_path)
    later = {k: v for k, v in statuses(spark, tmp_path).items() if k not in first}
    assert {k: v[0] for k, v in later.items()} == {"a%20b.csv": 200, "columns.csv": 500, "times.csv": 500}
    assert "Missing required columns" in later["columns.csv"][1]["error"]
