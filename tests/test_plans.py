import json

import pytest
from data import SAMPLE_CSV, planted, points, tuples
from pyspark.sql import functions as F

from fleetwatch.operators import texts
from fleetwatch.operators.answers import answers_of, named_pods, only_known
from fleetwatch.operators.detector import Thresholds
from fleetwatch.operators.inference import infer, read_responses, write_requests
from fleetwatch.operators.requests import image_requests, text_requests
from fleetwatch.operators.series import scoped
from fleetwatch.plans.arrival import announced_path, run_notice
from fleetwatch.plans.batch import analyse, run_files
from fleetwatch.plans.log_review import review_streams
from fleetwatch.plans.upload import analyse_upload
from fleetwatch.sinks.tables import write_charts
from fleetwatch.sources.images import read_images

LIMITS = Thresholds(shape_minutes=15)


def answer(*pods):
    tags = "".join(f"<pod{i}>{p}</pod{i}>" for i, p in enumerate(pods, 1))
    return f"<result>{tags or '无异常'}</result>"


@pytest.fixture
def sample_path(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sample.csv").write_text(SAMPLE_CSV)
    return str(tmp_path / "in" / "sample.csv")


def test_sample_run_is_all_normal(spark, sample_path, tmp_path):
    out = str(tmp_path / "out")
    report = run_files(spark, sample_path, out)
    assert report.all_normal.first()[0] is True
    assert report.series.count() == 8 and report.ticks.count() == 2 and report.meta.count() == 2
    assert [r.message for r in report.lines.collect()] == ["所有服务均无异常"]
    status = spark.read.json(f"{out}/status").first()
    assert status.statusCode == 200
    assert json.loads(status.body) == {"message": "Analysis completed successfully", "all_normal": True}


def test_notice_without_a_file_leaves_a_status(spark, tmp_path):
    with pytest.raises(Exception):
        run_notice(spark, "{}", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "status")).first().statusCode == 500


def test_failed_run_leaves_a_status_and_raises(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        run_files(spark, str(tmp_path / "none.csv"), out)
    status = spark.read.json(f"{out}/status").first()
    assert status.statusCode == 500 and "CSV file not found" in json.loads(status.body)["error"]


def test_rules_run_writes_charts_of_abnormal_services_only(spark, tmp_path):
    out = str(tmp_path / "out")
    calm = points(spark, {f"c{i}": [30.0 + (j * 7 + i) % 5 for j in range(60)] for i in range(6)}, service="calm")
    report = analyse(planted(spark).unionByName(calm), scope="full", limits=LIMITS)
    assert "s" in {r.service for r in report.anomalies.df.collect()}
    report.write(out)
    written = {r.service for r in spark.read.parquet(f"{out}/charts").select("service").distinct().collect()}
    assert written == {r.service for r in report.anomalies.df.collect()}


def test_charts_of_other_services_stay(spark, tmp_path):
    out = str(tmp_path / "charts")
    for service, value in (("a", 1), ("b", 2), ("a", 3)):
        write_charts(spark.createDataFrame([(service, value)], "service string, value int"), out)
    assert tuples(spark.read.parquet(out), "service", "value") == [("a", 3), ("b", 2)]


def test_model_run(spark, sample_path, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "cpu_usage_search.jpg").write_bytes(b"picture")

    of_picture = answer("search-a-rack-7", "ghost")
    of_checkout, of_search = answer("checkout-b", "checkout-b"), answer()

    def make():
        def reply(body):
            if '"image"' in body:
                return of_picture
            return of_checkout if "Pod: checkout-b" in body else of_search

        return lambda bodies: [reply(b) for b in bodies]

    def names(**options):
        report = run_files(spark, sample_path, str(tmp_path / "out"), image_folder=str(tmp_path / "img"), make_model=make, **options)
        return tuples(report.anomalies.df)

    assert names() == [("checkout", "checkout-b"), ("search", "ghost"), ("search", "search-a-rack-7")]
    assert names(known_only=True) == [("checkout", "checkout-b"), ("search", "search-a-rack-7")]


def test_notice_run(spark, sample_path, tmp_path):
    folder, key = sample_path.rsplit("/", 1)
    notice = json.dumps({"Records": [{"s3": {"bucket": {"name": folder}, "object": {"key": key}}}]})
    assert announced_path(spark, notice, "{bucket}/{key}") == sample_path
    report = run_notice(spark, notice, str(tmp_path / "out"), address="{bucket}/{key}")
    assert report.all_normal.first()[0] is True
    with pytest.raises(ValueError, match="names no file"):
        announced_path(spark, '{"Records":[]}')


def test_stats_and_values_text(spark, sample_path):
    from fleetwatch.sources.samples import read_samples

    samples = read_samples(spark, sample_path)
    row = texts.service_texts(scoped(samples)).filter("service = 'search'").first()
    assert row.stats_text.startswith(
        "Statistics:\nPod: search-a\nNode: rack-7\nMean: 67.20, Max: 73.20, Min: 61.20, Std: 8.49\n\nPod: search-b\n"
    )
    assert row.values_text == (
        "Raw Data:\nPod: search-a\nNode: rack-7\nData:\n0    61.2\n1    73.2\n\n"
        "Pod: search-b\nNode: rack-9\nData:\n0    62.2\n1    76.2\n\n"
    )


def test_texts_of_a_pod_without_rows(spark):
    samples = points(spark, {"a": [1.0, 2.0]}).unionByName(points(spark, {"b": [1.0]}).selectExpr(
        "service", "pod", "node", "CAST(NULL AS timestamp_ntz) AS timestamp", "cpuusage", "seq + 10 AS seq"))
    row = texts.service_texts(scoped(samples)).first()
    assert "Pod: b\nNode: n\nMean: nan, Max: nan, Min: nan, Std: nan\n\n" in row.stats_text
    assert row.values_text.endswith("Pod: b\nNode: n\nData:\nSeries([], )\n\n")
    assert (row.part, row.n_pods) == (0, 2)


def test_parts_hold_every_value_once(spark):
    samples = points(spark, {f"p{i}": [float(j) for j in range(i * 3)] for i in range(1, 8)})
    parts = texts.service_texts(scoped(samples, "full"), part_values=5).collect()
    lines = [line for r in parts for line in r.values_text.splitlines() if line[:1].isdigit()]
    assert len(lines) == samples.count() and len(parts) > 5
    assert all(sum(line[:1].isdigit() for line in r.values_text.splitlines()) < 10 for r in parts)


def test_requests_through_files(spark, tmp_path):
    samples = points(spark, {"a": [1.0, 2.0], "b": [3.0, 4.0]})
    requests = text_requests(texts.service_texts(scoped(samples)))
    write_requests(requests, str(tmp_path / "requests"))
    sent = [json.loads(line) for f in (tmp_path / "requests").glob("*.json") for line in f.read_text().splitlines()]
    assert [(r["service"], r["part"], r["path"]) for r in sent] == [("s", 0, "text")]
    (tmp_path / "responses").mkdir()
    reply = {"service": "s", "part": 0, "path": "text", "body": json.dumps({"content": [{"text": answer(" b ")}]})}
    (tmp_path / "responses" / "r.json").write_text(json.dumps(reply))
    named = named_pods(answers_of(read_responses(spark, str(tmp_path / "responses"))))
    assert tuples(named) == [("s", "text", "b")]
    assert tuples(only_known(named, samples), "pod") == [("b",)]


def test_wrong_number_of_answers_fails(spark):
    requests = spark.createDataFrame([("s", 0, "text", "{}")], "service string, part bigint, path string, body string")
    with pytest.raises(Exception, match="0 answers to 1 requests"):
        infer(requests, lambda: lambda bodies: []).collect()


def test_image_request_names_the_service(spark, tmp_path):
    (tmp_path / "cpu_usage_a.b_c.jpg").write_bytes(b"x")
    assert image_requests(read_images(spark, str(tmp_path))).first().service == "a.b_c"


def test_upload(spark):
    table = planted(spark, 300).selectExpr(
        "service AS `Service`", "pod AS `Pod Name`", "node AS host", "'cpu' AS metric", "timestamp AS time", "cpuusage AS value"
    )
    other = table.withColumn("metric", F.lit("calm")).withColumn("value", F.col("value") * 0 + F.second("time") % 2 + F.minute("time") % 9)
    result = analyse_upload(table.unionByName(other), scope="full", limits=LIMITS)
    assert {r.pod for r in result.findings.filter("metric = 'cpu'").collect()} == {"flat", "shifted", "high", "inverted"}
    said = {(r.group, r.analysis) for r in result.analysis_results.collect()}
    assert ("s / cpu", "flat-n: flat") in said
    assert result.visualization_data.count() == 2 * 15 * 300


def test_log_review(spark):
    rows = [("r", "g", f"s{i % 2}", i, f"m{i}") for i in range(6)]
    logs = spark.createDataFrame(rows, "region string, log_group string, log_stream string, seq bigint, message string")
    logs = logs.withColumn("event_time", F.lit("2024-01-01").cast("timestamp_ntz"))

    def make():
        import json

        return lambda bodies: [json.loads(b)["messages"][0]["content"][0]["text"].split("\n\n", 1)[1] for b in bodies]

    assert tuples(review_streams(logs, make), "log_stream", "answer") == [("s0", "m0\nm2\nm4\n")]
    both = review_streams(logs, make, every_stream=True, part_bytes=6)
    assert tuples(both, "log_stream", "part", "answer") == [
        ("s0", 0, "m0\nm2\n"), ("s0", 1, "m4\n"), ("s1", 0, "m1\nm3\n"), ("s1", 1, "m5\n"),
    ]
