import json

from data import planted, tuples
from pyspark.sql import functions as F

from fleetwatch.operators import series, texts
from fleetwatch.plans.batch import analyse
from fleetwatch.plans.upload import analyse_upload
from fleetwatch.sources.sample_store import read_sample_store, write_sample_store
from fleetwatch.streaming.watch import watch


def _samples(spark):
    """Services of one long day each, months apart."""
    rows = spark.range(3 * 1440).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("service"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("pod"),
        F.lit("n").alias("node"), F.col("id"), (F.col("id") % 3).alias("k"),
    )
    start = F.element_at(F.array(*[F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-04-05", "2024-08-05")]), (F.col("k") + 1).cast("int"))
    time = F.timestamp_add("MINUTE", (F.col("id") * 2).cast("int"), start)  # six days
    return rows.select("service", "pod", "node", time.alias("timestamp"), (F.col("id") % 90).cast("double").alias("cpuusage"), F.col("id").alias("seq"))


def _files_read(df):
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "FileSourceScanExec" and "sample_day" in node.toString():
            found += node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_store_gives_each_service_its_own_days(spark, tmp_path):
    samples = _samples(spark)
    store = str(tmp_path / "store")
    write_sample_store(samples.filter("seq % 2 = 0"), store)
    write_sample_store(samples.filter("seq % 2 = 1"), store)
    stored = read_sample_store(spark, store)
    bounds = series.window_bounds(series.profile(samples), 8)
    cut = series.window_cut(stored, bounds)
    assert "dynamicpruning" in cut._jdf.queryExecution().toString().lower()
    columns = ["service", "pod", "timestamp", "cpuusage", "seq"]
    assert tuples(cut, *columns) == tuples(series.window_cut(samples, bounds), *columns)
    assert 0 < _files_read(cut) <= 2 * 2 * 3  # two writes, two days a window, three services; the store has 18 days
    assert len(stored.inputFiles()) >= 2 * 18


def test_analysis_of_a_store(spark, tmp_path):
    samples = planted(spark, 120)
    write_sample_store(samples.unionByName(samples.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))), str(tmp_path / "store"))
    stored = read_sample_store(spark, str(tmp_path / "store"))
    assert tuples(analyse(stored, "full").anomalies.df) == tuples(analyse(samples, "full").anomalies.df)
    assert tuples(analyse(stored).series.select("label", "timestamp", "value")) == tuples(analyse(samples).series.select("label", "timestamp", "value"))


def test_store_beyond_broadcast(spark, tmp_path, no_broadcast):
    samples = _samples(spark).filter("seq < 600")
    write_sample_store(samples, str(tmp_path / "store"))
    bounds = series.window_bounds(series.profile(samples), 8)
    cut = series.window_cut(read_sample_store(spark, str(tmp_path / "store")), bounds)
    assert tuples(cut, "service", "seq") == tuples(series.window_cut(samples, bounds), "service", "seq")


def test_store_without_samples(spark, tmp_path):
    write_sample_store(_samples(spark).limit(0), str(tmp_path / "store"))
    stored = read_sample_store(spark, str(tmp_path / "store"))
    assert series.window_cut(stored, series.window_bounds(series.profile(stored))).count() == 0


def test_log_text_of_few_but_long_lines(spark):
    rows = [("r", "g", f"s{i % 2}", i, str(i) * (200 if i % 2 else 1)) for i in range(60)]
    logs = spark.createDataFrame(rows, "region string, log_group string, log_stream string, seq bigint, message string")
    logs = logs.withColumn("event_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    plain = tuples(texts.log_text(logs, 500), "log_stream", "part", "n_events", "text")
    spark.conf.set("spark.fleetwatch.hotBytes", "1000")
    try:
        assert tuples(texts.log_text(logs, 500), "log_stream", "part", "n_events", "text") == plain
    finally:
        spark.conf.unset("spark.fleetwatch.hotBytes")


def test_upload_is_written(spark, tmp_path):
    table = planted(spark, 60).selectExpr(
        "service AS `Service`", "pod AS `Pod Name`", "node AS host", "'cpu' AS metric", "timestamp AS time", "cpuusage AS value"
    )
    result = analyse_upload(table, scope="full")
    result.write(str(tmp_path / "out"))
    charts = spark.read.parquet(str(tmp_path / "out" / "visualization_data"))
    assert charts.count() == 15 * 60 and (tmp_path / "out" / "visualization_data" / "service=s" / "metric=cpu").is_dir()
    assert spark.read.json(str(tmp_path / "out" / "analysis_results")).count() == result.analysis_results.count()


def test_pictures_belong_to_the_file_they_came_with(spark, tmp_path):
    head = "service,pod,node,timestamp,cpuusage\n"
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        (tmp_path / "in" / f"{name}.csv").write_text(head + "".join(f"s,p{i},n,2024-01-01 00:0{i}:00,{i}\n" for i in range(5)))
    (tmp_path / "pictures" / "two").mkdir(parents=True)
    (tmp_path / "pictures" / "two" / "cpu_usage_s.jpg").write_bytes(b"x")

    def model():
        return lambda bodies: ["<result><pod1>seen</pod1></result>" if '"image"' in b else "<result>无异常</result>" for b in bodies]

    query = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), image_folder=str(tmp_path / "pictures"), make_model=model)
    query.awaitTermination(300)
    assert query.exception() is None
    rows = spark.read.json(str(tmp_path / "out" / "status")).collect()
    said = {r["source_file"].rsplit("/", 1)[1]: json.loads(r["body"])["all_normal"] for r in rows}
    assert said == {"one.csv": True, "two.csv": False}
    found = spark.read.parquet(str(tmp_path / "out" / "anomalies"))
    assert tuples(found, "service", "pod") == [("s", "seen")]
