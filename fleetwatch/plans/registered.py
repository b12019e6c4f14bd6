"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.functions.text import all_tags, first_tag
from fleetwatch.operators import answers as ans
from fleetwatch.operators import charts, series, texts
from fleetwatch.operators.detector import Detector
from fleetwatch.operators.inference import infer
from fleetwatch.operators.requests import image_requests, log_requests, prompts, text_requests
from fleetwatch.plans.batch import analyse
from fleetwatch.plans.registered_files import file_queries
from fleetwatch.plans.upload import analyse_upload
from fleetwatch.sinks.tables import results_json
from fleetwatch.sources import logs as log_source
from fleetwatch.sources import samples as smp
from fleetwatch.sources import tables as tab
from fleetwatch.sources.images import base64_text
from fleetwatch.sources.notifications import notification_keys

Query = Callable[[SparkSession, str], DataFrame]

WEEK = 168       # the test data is thin: most analyses look at a week
DIGITS = 6
SMALL_PART = 50  # values per text part, for the queries that show parts


def rounded(df: DataFrame) -> DataFrame:
    """Engines add up doubles in different orders: compare six digits."""
    return df.withColumns(
        {f.name: F.round(f.name, DIGITS) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return tab.read_table(spark, folder, "events")


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return tab.event_samples(_events(spark, folder))


def _logs(spark: SparkSession, folder: str) -> DataFrame:
    return tab.event_logs(_events(spark, folder))


def on_samples(compute: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: rounded(compute(_samples(spark, folder)))


def on_events(derive: Callable[[DataFrame], DataFrame], compute: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: rounded(compute(derive(_events(spark, folder))))


def on_logs(compute: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: compute(_logs(spark, folder))


def on_pages(compute: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: compute(tab.read_table(spark, folder, "pages"))


def _cut(samples: DataFrame, hours: float) -> DataFrame:
    return series.window_cut(samples, series.window_bounds(series.profile(samples), hours))


def _rows(samples: DataFrame, hours: float) -> DataFrame:
    return series.scoped(samples, hours=hours).rows


def _detector(samples: DataFrame, scope: str) -> Detector:
    return Detector(series.scoped(samples, scope, WEEK))


def _found(samples: DataFrame, scope: str = "window") -> DataFrame:
    return ans.anomalies(_detector(samples, scope).findings())


def _smoothed(samples: DataFrame, scope: str) -> DataFrame:
    return _detector(samples, scope).smoothed.select("service", "pod", "node", "seq", "cpuusage", "smooth")


def _texts(samples: DataFrame, part_values: int = texts.PART_VALUES) -> DataFrame:
    return texts.service_texts(series.scoped(samples, hours=WEEK), part_values=part_values)


def _anomalous_series(samples: DataFrame) -> DataFrame:
    """As reports do it: only the samples of abnormal services are cut and placed."""
    return analyse(samples, hours=WEEK).anomalous_series


def _joined_pods(samples: DataFrame, part_pods: int = texts.PART_PODS) -> DataFrame:
    listed = texts.pods_per_service(samples, part_pods=part_pods)
    return listed.withColumn("pods", F.to_json("pods"))


def _missing_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("service").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("pod", "timestamp", "cpuusage")],
    )


def _parsed(answers: DataFrame) -> DataFrame:
    return ans.parsed_answers(answers).withColumn("pods", F.array_join("pods", "|"))


def _answer_names(answers: DataFrame) -> DataFrame:
    names = answers.select("answer_id", F.posexplode(all_tags("answer")).alias("nth", "pod"))
    return names.withColumn("nth", F.col("nth").cast("bigint"))


def _page_headings(pages: DataFrame) -> DataFrame:
    found = all_tags("html", r"(?s)<h\d+>(.*?)</h\d+>")
    return pages.select("page_id", F.posexplode(found).alias("nth", "heading")).withColumn("nth", F.col("nth").cast("bigint"))


def _page_images(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.concat(F.lit("/charts/cpu_usage_page-"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )


def _stub_answers(samples: DataFrame) -> DataFrame:
    def name_first_pod():
        """A stand-in for a model: names the first pod of the text."""
        import re

        def model(bodies: list[str]) -> list[str]:
            first = [re.search(r"Pod: (.*?)\\n", body) for body in bodies]
            return [f"<result><pod1>{m.group(1)}</pod1></result>" if m else "<result>无异常</result>" for m in first]

        return model

    answers = infer(text_requests(_texts(samples, SMALL_PART)), name_first_pod)
    return answers.select("service", "part", F.explode(all_tags("answer")).alias("pod"))


def _flagship(samples: DataFrame) -> DataFrame:
    """Statistics of every pod, with what the rules say about it."""
    found = _detector(samples, "window").findings()
    verdicts = found.groupBy("service", "pod", "node").agg(
        F.count(F.lit(1)).alias("n_rules"), F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules")
    )
    return (
        series.group_stats(samples).join(verdicts, ["service", "pod", "node"], "left")
        .withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))
    )


def all_queries() -> dict[str, Query]:
    found = {
        # sources and checks
        "log_stream_events": on_logs(log_source.log_stream_events),
        "log_catalog": on_logs(log_source.log_catalog),
        "notification_keys": on_events(tab.event_notifications, notification_keys),
        "notification_keys_every_record": on_events(
            tab.event_notifications, lambda n: notification_keys(n, every_record=True)
        ),
        "response_text": on_events(tab.event_responses, ans.answers_of),
        "column_mapping": on_events(tab.event_upload, smp.upload_samples),
        "typed_samples": on_events(tab.event_texts, smp.typed_samples),
        "null_tokens": on_events(tab.event_texts, lambda t: _missing_counts(smp.typed_samples(t))),
        "out_of_range": on_samples(smp.out_of_range),
        "preview": on_samples(lambda s: smp.preview(s, ["seq"])),
        # grouping and statistics
        "group_sizes": on_samples(series.group_sizes),
        "group_stats": on_samples(series.group_stats),
        "service_range": on_samples(series.service_range),
        "pods_per_service": on_samples(_joined_pods),
        "pods_per_service_parts": on_samples(lambda s: _joined_pods(s, 4)),
        # texts
        "stats_text": on_samples(lambda s: _texts(s).select("service", "part", "n_pods", "stats_text")),
        "values_text": on_samples(lambda s: _texts(s).select("service", "part", "values_text")),
        "service_texts_parts": on_samples(lambda s: _texts(s, SMALL_PART)),
        "log_text": on_logs(texts.log_text),
        "log_text_parts": on_logs(lambda e: texts.log_text(e, 200)),
        # requests and answers
        "prompt": on_samples(lambda s: prompts(_texts(s))),
        "requests": on_samples(lambda s: text_requests(_texts(s))),
        "image_requests": on_pages(lambda p: image_requests(_page_images(p))),
        "log_requests": on_logs(lambda e: log_requests(texts.log_text(e))),
        "b64_payload": on_pages(
            lambda p: _page_images(p).select("path", base64_text("content").alias("payload"))
        ),
        "stub_inference": on_samples(_stub_answers),
        "tag_first": on_events(tab.event_answers, lambda a: a.select("answer_id", first_tag("answer").alias("result"))),
        "tag_first_pages": on_pages(
            lambda p: p.select("page_id", first_tag("html", r"(?s)<title>(.*?)</title>").alias("title"))
        ),
        "tag_all": on_events(tab.event_answers, _answer_names),
        "tag_all_pages": on_pages(_page_headings),
        "answers_flagged": on_events(tab.event_answers, _parsed),
        "answer_anomalies": on_events(tab.event_answers, lambda a: ans.anomalies(ans.named_pods(a))),
        "known_answer_anomalies": lambda spark, folder: ans.anomalies(
            ans.only_known(ans.named_pods(tab.event_answers(_events(spark, folder))), series.profile(_samples(spark, folder)).df)
        ),
        # detector
        "anomalies": on_samples(_found),
        "anomalies_full": on_samples(lambda s: _found(s, "full")),
        "findings": on_samples(lambda s: _detector(s, "window").findings()),
        "findings_full": on_samples(lambda s: _detector(s, "full").findings()),
        "all_normal": on_samples(lambda s: ans.all_normal(_found(s))),
        "report_lines": on_samples(lambda s: ans.report_lines(_found(s))),
        "report_lines_flat": on_samples(
            lambda s: ans.report_lines(ans.anomalies(_detector(s, "full").findings().filter("rule = 'flat'")))
        ),
        "status": on_samples(lambda s: ans.status(_found(s))),
        "anomalous_series": on_samples(_anomalous_series),
        "flagged_pods": on_samples(_flagship),
        "upload_analysis": on_events(tab.event_upload, lambda u: analyse_upload(u, hours=WEEK).findings),
        "upload_chart_data": on_events(tab.event_upload, lambda u: analyse_upload(u, hours=WEEK).visualization_data),
        "results_json": on_events(
            tab.event_upload, lambda u: results_json(analyse_upload(u, hours=WEEK).analysis_results)
        ),
    }
    # common window, for eight hours and for a week
    for suffix, hours in (("", 8), ("_168h", WEEK)):
        found |= {
            f"service_window{suffix}": on_samples(lambda s, h=hours: series.service_window(s, h)),
            f"window_cut{suffix}": on_samples(lambda s, h=hours: _cut(s, h)),
            f"downsampled{suffix}": on_samples(lambda s, h=hours: _rows(s, h)),
            f"window_stats{suffix}": on_samples(lambda s, h=hours: series.window_stats(series.scoped(s, hours=h))),
            f"chart_series{suffix}": on_samples(lambda s, h=hours: charts.chart_series(_rows(s, h))),
            f"chart_ticks{suffix}": on_samples(lambda s, h=hours: charts.chart_ticks(series.service_window(s, h))),
            f"chart_meta{suffix}": on_samples(lambda s, h=hours: charts.chart_meta(series.service_window(s, h), h)),
        }
    found |= file_queries()
    # detector rules, on the windowed and on all rows
    for suffix, scope in (("", "window"), ("_full", "full")):
        found[f"despiked{suffix}"] = on_samples(lambda s, c=scope: _smoothed(s, c))
        for rule in ("level", "axis", "flat", "high", "shape"):
            found[f"detect_{rule}{suffix}"] = on_samples(lambda s, c=scope, r=rule: getattr(_detector(s, c), r)())
    return found
