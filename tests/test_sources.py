import datetime as dt

import pytest
from data import SAMPLE_CSV, frame, points, tuples
from pyspark.sql import functions as F

from fleetwatch.fixed_values import NULL_TOKENS
from fleetwatch.sources import samples as smp
from fleetwatch.sources.images import base64_text, read_images
from fleetwatch.sources.logs import default_stream, log_catalog, log_stream_events
from fleetwatch.sources.notifications import notification_keys


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_reads_by_name_in_any_order_with_extra_columns(spark, tmp_path):
    path = write(tmp_path, "a.csv", "cpuusage,zone,node,timestamp,pod,service\n1.5,z,n,2024-01-01 10:00:00,p,s\n")
    row = smp.read_samples(spark, path).first()
    assert (row.service, row.pod, row.node, row.timestamp, row.cpuusage) == ("s", "p", "n", dt.datetime(2024, 1, 1, 10), 1.5)


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="CSV file not found"):
        smp.read_samples(spark, str(tmp_path / "none.csv"))


def test_empty_file(spark, tmp_path):
    with pytest.raises(ValueError, match="The CSV file is empty"):
        smp.read_samples(spark, write(tmp_path, "a.csv", ""))


def test_header_only(spark, tmp_path):
    assert smp.read_samples(spark, write(tmp_path, "a.csv", SAMPLE_CSV.splitlines()[0] + "\n")).count() == 0


def test_missing_columns_are_listed(spark, tmp_path):
    with pytest.raises(ValueError, match=r"Missing required columns: \['node', 'cpuusage'\]"):
        smp.read_samples(spark, write(tmp_path, "a.csv", "service,pod,timestamp\ns,p,2024-01-01\n"))


def test_other_metric_column(spark, tmp_path):
    path = write(tmp_path, "a.csv", "service,pod,node,timestamp,memory\ns,p,n,2024-01-01,7\n")
    assert smp.read_samples(spark, path, metric_col="memory").first().cpuusage == 7.0


def test_short_row_is_filled_and_long_row_fails(spark, tmp_path):
    head = "service,pod,node,timestamp,cpuusage\n"
    short = smp.read_samples(spark, write(tmp_path, "short.csv", head + "s,p,n,2024-01-01 10:00:00\n"))
    assert short.first().cpuusage is None
    long = smp.read_samples(spark, write(tmp_path, "long.csv", head + "s,p,n,2024-01-01 10:00:00,1,2\n"))
    with pytest.raises(Exception, match="Error parsing CSV file"):
        long.collect()


def test_files_with_different_headers_are_not_mixed_up(spark, tmp_path):
    write(tmp_path, "a.csv", "service,pod,node,timestamp,cpuusage\ns,p,n,2024-01-01,1\n")
    write(tmp_path, "b.csv", "pod,service,node,timestamp,cpuusage\np,s,n,2024-01-01,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        smp.read_samples(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("bad", ["s,p,n,yesterday,1", "s,p,n,2024-01-01,much"])
def test_unreadable_values_fail(spark, tmp_path, bad):
    path = write(tmp_path, "a.csv", f"service,pod,node,timestamp,cpuusage\n{bad}\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        smp.read_samples(spark, path).collect()


def test_missing_value_tokens(spark):
    rows = [("s", "p", "n", "2024-01-01", t) for t in NULL_TOKENS] + [("s", t, "n", t, "1") for t in NULL_TOKENS]
    raw = spark.createDataFrame(rows, "service string, pod string, node string, timestamp string, cpuusage string")
    typed = smp.typed_samples(raw)
    assert typed.filter("cpuusage IS NULL").count() == len(NULL_TOKENS) == 19
    assert typed.filter("pod IS NULL AND timestamp IS NULL").count() == len(NULL_TOKENS)


def test_nan_becomes_null(spark):
    assert smp.typed_samples(points(spark, {"p": [float("nan"), 2.0]})).filter("cpuusage IS NULL").count() == 1


def test_identical_rows_get_the_same_order_number(spark, tmp_path):
    row = "s,p,n,2024-01-01 10:00:00,1\n"
    path = write(tmp_path, "a.csv", "service,pod,node,timestamp,cpuusage\n" + row + row + row.replace(",1", ",2"))
    assert smp.read_samples(spark, path).select("seq").distinct().count() == 2


def test_range_check(spark):
    samples = points(spark, {"p": [0.0, 100.0, 100.1, -0.1, None]})
    assert smp.out_of_range(samples).count() == 3
    with pytest.raises(Exception, match="between 0 and 100"):
        smp.require_range(samples).collect()
    assert smp.require_range(samples.filter("cpuusage BETWEEN 0 AND 100")).count() == 2


def test_column_mapping(spark):
    table = spark.createDataFrame(
        [("s", "p", "cpu", "n", dt.datetime(2024, 1, 1), 3.0)],
        "`服务名称` string, `Pod Name` string, METRIC string, `Host` string, `Time` timestamp_ntz, `CPU Usage` double",
    )
    row = smp.upload_samples(table).first()
    assert (row.metric, row.service, row.pod, row.node, row.cpuusage) == ("cpu", "s", "p", "n", 3.0)


def test_column_mapping_reports_what_is_missing(spark):
    table = spark.createDataFrame([("s", "p")], "service string, pod string")
    with pytest.raises(ValueError, match="metric, node, timestamp, cpu_usage; columns present: service, pod"):
        smp.upload_samples(table)


def test_preview(spark):
    assert [r.seq for r in smp.preview(points(spark, {"p": [1.0] * 9}), ["seq"]).collect()] == [0, 1, 2, 3, 4]


LOGS = "region string, log_group string, log_stream string, event_time timestamp_ntz, seq bigint, message string"


def logs(spark, regions):
    rows = [(r, g, f"st-{s}", dt.datetime(2024, 1, 1), i, "m") for i, r in enumerate(regions) for g in "ba" for s in (2, 1)]
    return spark.createDataFrame(rows, LOGS)


def test_default_stream(spark):
    assert tuples(default_stream(logs(spark, ["ap", "us-east-1"]))) == [("us-east-1", "a", "st-1")]
    assert tuples(default_stream(logs(spark, ["eu", "ap"]))) == [("ap", "a", "st-1")]


def test_picked_stream(spark):
    picked = log_stream_events(logs(spark, ["eu", "ap"]), region="eu", log_group="b")
    assert tuples(log_catalog(picked)) == [("eu", "b", "st-1")]
    assert log_stream_events(logs(spark, ["eu"]), "eu", "b", "st-2").count() == 1


def test_notifications(spark):
    record = '{"s3":{"bucket":{"name":"b%d"},"object":{"key":"k%d.csv"}}}'
    notice = '{"Records":[' + record % (1, 1) + "," + record % (2, 2) + "]}"
    df = spark.createDataFrame([(notice,), ('{"Records":[]}',)], "body string")
    assert tuples(notification_keys(df)) == [("b1", "k1.csv"), (None, None)]
    assert tuples(notification_keys(df, every_record=True)) == [("b1", "k1.csv"), ("b2", "k2.csv")]


def test_images(spark, tmp_path):
    import base64

    content = bytes(range(256)) * 3
    (tmp_path / "a.jpg").write_bytes(content)
    (tmp_path / "b.txt").write_bytes(b"x")
    images = read_images(spark, str(tmp_path))
    assert images.count() == 1
    assert images.select(base64_text("content")).first()[0] == base64.b64encode(content).decode()
    assert images.select(F.length("content")).first()[0] == 768


def test_spellings_of_a_time(spark):
    from pyspark.sql import functions as F

    from fleetwatch.sources.samples import time_of

    same = ["2024-01-02 10:00:00", "2024/01/02 10:00:00", "01/02/2024 10:00", "20240102 1000", "2024-01-02 18:00:00+08:00", "2024-01-02T10:00:00Z"]
    rows = spark.createDataFrame([(t,) for t in same], "t string").select(time_of(F.col("t")).alias("at")).distinct().collect()
    assert [str(r.at) for r in rows] == ["2024-01-02 10:00:00"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("soon",)], "t string").select(time_of(F.col("t"))).collect()
