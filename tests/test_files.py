import pytest
from data import SAMPLE_CSV, tuples
from pyspark.sql import functions as F

from fleetwatch.operators.series import scoped
from fleetwatch.operators.texts import service_texts
from fleetwatch.plans import registered_files
from fleetwatch.sources.logs import read_log_json, read_log_store, stored_stream_events, write_log_store
from fleetwatch.sources.samples import SEQ, file_preview, read_checked, read_csv, read_samples

HEAD = "cpuusage,service,pod,node,timestamp\n"


@pytest.fixture
def sample_path(tmp_path):
    (tmp_path / "samples.csv").write_text(SAMPLE_CSV)
    return str(tmp_path / "samples.csv")


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _write(tmp_path, sizes):
    rows = []
    for name, n in sizes.items():
        own = [f"{i % 90}.5,s{i % 3},p{i % 4},n,2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}" for i in range(len(rows), len(rows) + n)]
        (tmp_path / name).write_text(HEAD + "\n".join(own) + "\n")
        rows += own
    return rows


def test_rows_are_numbered_in_file_order(spark, tmp_path, small_blocks):
    rows = _write(tmp_path, {"a.csv": 300, "b.csv": 1, "c.csv": 120, "d.csv": 0})
    found = read_csv(spark, str(tmp_path), row_number="at")
    assert found.rdd.getNumPartitions() > 5
    numbered = {r["at"]: ",".join([r["cpuusage"], r["service"], r["pod"], r["node"], r["timestamp"]]) for r in found.collect()}
    assert numbered == dict(enumerate(rows))
    assert [r[SEQ] for r in read_samples(spark, str(tmp_path), row_numbers=True).orderBy(SEQ).collect()] == list(range(421))


def test_preview_shows_the_first_rows_as_they_stand(spark, tmp_path, small_blocks):
    rows = _write(tmp_path, {"b.csv": 300, "a.csv": 2})
    first = [",".join(r) for r in file_preview(spark, str(tmp_path)).collect()]
    assert first == rows[300:302] + rows[:3]
    assert [",".join(r) for r in file_preview(spark, str(tmp_path / "b.csv"), 3).collect()] == rows[:3]


def test_values_under_their_row_numbers(spark, sample_path):
    row = service_texts(scoped(read_samples(spark, sample_path, row_numbers=True)), row_numbers=True).filter("service = 'search'").first()
    lines = SAMPLE_CSV.splitlines()[1:]
    at = {pod: [i for i, line in enumerate(lines) if f",{pod}," in f",{line},"] for pod in ("search-a", "search-b")}
    for pod, places in at.items():
        shown = row.values_text.split(f"Pod: {pod}\n")[1].split("Data:\n")[1].split("\n\n")[0].splitlines()
        assert [int(x.split()[0]) for x in shown] == [places[0], places[2]]  # every other point is kept


def test_refused_rows_name_file_row_and_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEAD + "1,s,p,n,2024-01-01 00:00:00\nmuch,s,p,n,2024-01-01 00:01:00\n3,s,p,n,yesterday\n4,s,p,n,2024-01-01 00:03:00,more\n5,s,p\nNA,NA,p,n,NA\n"
    )
    (tmp_path / "b.csv").write_text(HEAD + "7,s,p,n,2024-01-01T00:05:00Z\n")
    good, refused = read_checked(spark, str(tmp_path))
    assert tuples(refused.df, "seq", "time_text", "value_text", "reason") == [
        (1, "2024-01-01 00:01:00", "much", "cpuusage"), (2, "yesterday", "3", "timestamp"), (3, "2024-01-01 00:03:00", "4", "too many fields"),
    ]
    assert {r["source_file"].rsplit("/", 1)[1] for r in refused.df.collect()} == {"a.csv"}
    assert sorted((r["seq"], r["service"], r["cpuusage"], str(r["timestamp"])) for r in good.df.filter("service IS NOT NULL").collect()) == [
        (0, "s", 1.0, "2024-01-01 00:00:00"), (4, "s", 5.0, "None"), (6, "s", 7.0, "2024-01-01 00:05:00"),
    ]
    assert (good.rows, refused.rows) == (4, 3)
    with pytest.raises(Exception):
        read_samples(spark, str(tmp_path)).collect()


def test_nothing_refused(spark, sample_path):
    good, refused = read_checked(spark, sample_path)
    assert (good.rows, refused.rows, refused.df.count()) == (12, 0, 0)


def _lines(tmp_path):
    rows = [
        f'{{"region":"{r}","log_group":"{g}","log_stream":"{s}","event_time":"2024-01-01T00:00:0{i}","seq":{i},"message":"m {r} {g} {s}"}}'
        for i, (r, g, s) in enumerate([("us-east-1", "b", "y"), ("us-east-1", "b", "x"), ("eu", "a", "x"), ("us-east-1", "c", "a"), ("us-east-1", "b", "x")])
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.json").write_text("\n".join(rows))
    return str(tmp_path / "in")


def test_log_store_reads_picked_folders_only(spark, tmp_path):
    store = str(tmp_path / "store")
    write_log_store(read_log_json(spark, _lines(tmp_path)), store)
    write_log_store(read_log_json(spark, _lines_more(tmp_path)), store)
    assert read_log_store(spark, store).count() == 6
    picked = stored_stream_events(spark, store, region="us-east-1", log_group="b")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan and "us-east-1" in plan.split("PartitionFilters", 1)[1].split("]")[0]
    default = stored_stream_events(spark, store)
    assert tuples(default, "log_group", "log_stream", "seq") == [("b", "x", 1), ("b", "x", 4)]


def _lines_more(tmp_path):
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "l.json").write_text('{"region":"eu","log_group":"a","log_stream":"z","seq":9}')
    return str(tmp_path / "more")


def test_lines_that_are_no_events_fail(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"region": "eu"\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_log_json(spark, str(tmp_path / "bad.json")).collect()


def test_empty_store(spark, tmp_path):
    store = str(tmp_path / "store")
    write_log_store(spark.createDataFrame([], "region string, log_group string, log_stream string, event_time timestamp_ntz, seq bigint, message string"), store)
    assert stored_stream_events(spark, store).count() == 0


def test_announced_files_hold_few_samples(spark, tmp_path, monkeypatch):
    """A type with many events has several files, each announced; a task writes no more than one file's samples."""
    rows = [(i, f"2024-01-0{1 + i % 9} 00:{i % 60:02d}:00", i % 40, "view" if i % 10 else "click", float(i % 7), "{}") for i in range(600)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    made = []
    monkeypatch.setattr(registered_files, "_new_folder", lambda _: made.append(f"{tmp_path}/home{len(made)}") or made[-1])
    monkeypatch.setattr(registered_files, "NOTICED_ROWS", 150)
    found = tuples(registered_files.file_queries()["noticed_files"](spark, str(tmp_path)))
    assert sorted(found) == [("click", 200, 1), ("empty", 500, 2), ("view", 200, 1)]
    files = spark.read.option("header", True).csv(f"{made[0]}/in/type=*").groupBy(F.input_file_name().alias("file")).count().collect()
    assert sum(r["count"] for r in files) == 600 and max(r["count"] for r in files) <= 300 and len(files) >= 4
    statuses = spark.read.json(f"{made[0]}/out/status").filter("statusCode = 200")
    assert statuses.count() == len(files) == statuses.select("source_file").distinct().count()
