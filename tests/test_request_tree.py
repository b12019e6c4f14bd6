import json

import pytest
from data import planted, points, tuples
from pyspark.sql import functions as F

from fleetwatch.operators.answers import anomalies, named_pods
from fleetwatch.operators.inference import asked_and_kept, infer_kept
from fleetwatch.operators.request_tree import asked_once, judged_services, merged_answers
from fleetwatch.operators.series import scoped
from fleetwatch.operators.texts import ServiceTexts
from fleetwatch.plans.batch import analyse
from fleetwatch.plans.log_review import review_tree
from fleetwatch.plans.registered_files import counting_model, peer_model

REQUESTS = "service string, part bigint, path string, body string"


def _logs(spark):
    rows = [("r", "g", f"s{i % 3}" if i < 90 else "s0", i, f"m{i}") for i in range(200)]
    logs = spark.createDataFrame(rows, "region string, log_group string, log_stream string, seq bigint, message string")
    return logs.withColumn("event_time", F.lit("2024-01-01").cast("timestamp_ntz"))


@pytest.mark.parametrize("part_bytes,fan_in", [(10**6, 16), (200, 16), (8, 2), (8, 3)])
def test_review_is_the_same_in_any_parts(spark, part_bytes, fan_in):
    found = review_tree(_logs(spark), counting_model, part_bytes, every_stream=True, fan_in=fan_in)
    assert tuples(found, "log_stream", "answer") == [("s0", "140"), ("s1", "30"), ("s2", "30")]


def test_one_picked_stream_is_reviewed(spark):
    assert tuples(review_tree(_logs(spark), counting_model, 20, region="r", log_group="g", log_stream="s1"), "answer") == [("30",)]


def test_merging_needs_two_answers(spark):
    with pytest.raises(ValueError, match="At least two"):
        merged_answers(spark.createDataFrame([], "k string, part bigint, path string, answer string"), ["k"], lambda r: r, fan_in=1)


def test_answers_are_merged_in_order_and_null_answers_are_empty(spark):
    rows = [("a", p, "log", None if p == 3 else str(p)) for p in range(7)] + [("b", 0, "log", "b0")]
    answers = spark.createDataFrame(rows, "k string, part bigint, path string, answer string")

    def ask(requests):
        text = F.get_json_object("body", "$.messages[0].content[0].text")
        said = F.regexp_replace(F.element_at(F.split(text, "\n\n", 2), 2), "\n", ",")
        return requests.select("k", "part", "path", said.alias("answer"))

    assert tuples(merged_answers(answers, ["k"], ask, fan_in=4), "k", "answer") == [("a", "0,1,2,,,4,5,6,,"), ("b", "b0")]


@pytest.fixture(scope="module")
def rows(spark):
    return scoped(planted(spark, 40), "full")


def _judged(rows, part_values, model=peer_model, **options):
    return anomalies(named_pods(judged_services(ServiceTexts(rows, part_values=part_values), asked_once(model), **options)))


def test_pods_named_do_not_depend_on_parts(rows):
    whole = tuples(_judged(rows, 10**6))
    assert whole and all(tuples(_judged(rows, n)) == whole for n in (200, 90, 7))


def test_every_pod_named_ends(rows):
    def all_of_them():
        import re

        return lambda bodies: [
            "<result>" + "".join(f"<pod1>{p}</pod1>" for p in set(re.findall(r"Pod: (.*?)\\nNode: .*?\\nMean", b))) + "</result>" for b in bodies
        ]

    pods = {r["pod"] for r in rows.series.df.collect()}
    assert {p for _, p in tuples(_judged(rows, 50, all_of_them))} == pods


def test_names_of_no_pod_stand_as_answered(rows):
    ghost = lambda: lambda bodies: ["<result><pod1>ghost</pod1></result>"] * len(bodies)
    for part_values in (50, 10**6):
        assert tuples(_judged(rows, part_values, ghost), "pod") == [("ghost",)]


def test_most_rounds(rows):
    asked = judged_services(ServiceTexts(rows, part_values=50), asked_once(peer_model), most_rounds=1)
    assert asked.select("part").distinct().count() > 1


def test_analyse_with_a_model_and_groups_of_more_columns(spark, tmp_path):
    samples = planted(spark, 30).withColumn("source_file", F.lit("f"))
    images = spark.createDataFrame([("f", "/x/cpu_usage_s.jpg", bytearray(b"x"))], "source_file string, path string, content binary")

    def model():
        return lambda bodies: [f"<result><pod1>{'seen' if 'image' in b else 'read'}</pod1></result>" for b in bodies]

    report = analyse(samples, "full", by=("source_file", "service"), make_model=model, images=images)
    assert tuples(report.anomalies.df) == [("f", "s", "read"), ("f", "s", "seen")]


def test_answers_are_kept_and_only_open_requests_asked(spark, tmp_path):
    rows = [(f"s{i % 4}", i, "text", f"body {i % 6}") for i in range(12)] + [("s0", 0, "text", "body 0")]
    requests = spark.createDataFrame(rows, REQUESTS)

    def first():
        def model(bodies):
            if any(b.endswith(("2", "5")) for b in bodies):
                raise OSError("away")
            return [f"first {b}" for b in bodies]

        return model

    store = str(tmp_path / "answers")
    once = infer_kept(requests, first, store, rounds=3, batch_rows=4).collect()
    assert len(once) == 13
    assert {r["part"] for r in once if r["answer"] is None} == {2, 5, 8, 11}
    assert all((r["error"] == "OSError: away") == (r["answer"] is None) for r in once)
    with pytest.raises(RuntimeError, match="4 requests have no answer yet, such as: OSError: away"):
        asked_and_kept(first, store)(requests)
    twice = infer_kept(requests, lambda: lambda bodies: [f"second {b}" for b in bodies], store).collect()
    assert {r["part"] for r in twice if r["answer"].startswith("second")} == {2, 5, 8, 11}
    assert all(r["error"] is None for r in twice)
    kept = asked_and_kept(lambda: lambda bodies: 1 / 0, store)(requests)
    assert sorted(map(str, kept.select("part", "answer").collect())) == sorted(str(r) for r in spark.createDataFrame([(r["part"], r["answer"]) for r in twice], "part bigint, answer string").collect())


def test_wrong_number_of_answers_is_kept_as_error(spark, tmp_path):
    requests = spark.createDataFrame([("s", 0, "text", "a"), ("s", 1, "text", "b")], REQUESTS)
    made = infer_kept(requests, lambda: lambda bodies: [], str(tmp_path / "x")).collect()
    assert {r["error"] for r in made} == {"ValueError: The model gave 0 answers to 1 requests"}
    assert infer_kept(requests.filter("false"), lambda: lambda bodies: [], str(tmp_path / "y")).count() == 0


def test_kept_answers_in_a_plan(spark, tmp_path):
    samples = points(spark, {"a": [1.0, 2.0], "b": [3.0, 4.0]})
    model = lambda: lambda bodies: ["<result><pod1>b</pod1></result>" for b in map(json.loads, bodies) if b]
    report = analyse(samples, "full", ask=asked_and_kept(model, str(tmp_path / "answers")))
    assert tuples(report.anomalies.df, "pod") == [("b",)]
