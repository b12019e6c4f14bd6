import json

from data import SAMPLE_CSV, tuples

from fleetwatch.streaming.notices import watch_notices


def _notice(path, **version):
    bucket, key = str(path).rsplit("/", 1)
    return json.dumps({"Records": [{"s3": {"bucket": {"name": bucket}, "object": {"key": key, **version}}}]})


def _run(spark, home, name, *notices):
    (home / "notices").mkdir(exist_ok=True)
    (home / "notices" / name).write_text("\n".join(notices) + "\n")
    query = watch_notices(spark, str(home / "notices"), str(home / "out"), str(home / "state"), "{bucket}/{key}", tries=2)
    query.awaitTermination(300)
    assert query.exception() is None


def _statuses(spark, home):
    rows = spark.read.json(str(home / "out" / "status")).collect()
    return sorted((r["batch"], (r["source_file"] or "none").rsplit("/", 1)[1 if r["source_file"] else 0], r["statusCode"]) for r in rows)


def test_each_version_is_analysed_once(spark, tmp_path):
    calm, empty, late = tmp_path / "calm.csv", tmp_path / "empty.csv", tmp_path / "late.csv"
    calm.write_text(SAMPLE_CSV)
    empty.write_text("")
    first = [_notice(calm, eTag="1"), _notice(empty, eTag="1"), _notice(late, eTag="1"), '{"Records":[]}', "no notice"]
    _run(spark, tmp_path, "0", *first)
    done = [(0, "calm.csv", 200), (0, "empty.csv", 500), (0, "none", 500)]
    assert _statuses(spark, tmp_path) == done
    assert tuples(spark.read.parquet(str(tmp_path / "out" / "files")), "state", "tries") == [("done", 1), ("done", 1), ("waiting", 1)]

    # the same notices again, one new version, and the late file has come
    late.write_text(SAMPLE_CSV)
    _run(spark, tmp_path, "1", _notice(calm, eTag="1"), _notice(calm, eTag="2"), _notice(empty, eTag="1"))
    done += [(1, "calm.csv", 200), (1, "late.csv", 200)]
    assert _statuses(spark, tmp_path) == done

    # notices without a version: the file's time and length are its version
    _run(spark, tmp_path, "2", _notice(calm))
    _run(spark, tmp_path, "3", _notice(calm), _notice(tmp_path / "never.csv"))
    calm.write_text(SAMPLE_CSV + "\n")
    _run(spark, tmp_path, "4", _notice(calm))
    done += [(2, "calm.csv", 200), (4, "calm.csv", 200), (4, "never.csv", 500)]
    assert _statuses(spark, tmp_path) == done
