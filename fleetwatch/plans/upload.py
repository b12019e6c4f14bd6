"""Analysis of an uploaded table, per service and metric."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.fixed_values import NO_ANOMALY, WINDOW_HOURS
from fleetwatch.operators.charts import chart_series, series_label
from fleetwatch.operators.detector import Detector, Thresholds
from fleetwatch.operators.series import scoped
from fleetwatch.sinks.tables import write_charts, write_json
from fleetwatch.sources.samples import FIELD_ALIASES, upload_samples

GROUP = ("service", "metric")


@dataclass(frozen=True)
class UploadResult:
    visualization_data: DataFrame
    findings: DataFrame
    analysis_results: DataFrame

    def write(self, folder: str) -> None:
        """Chart rows in a folder for each service and metric, results as JSON lines."""
        write_charts(self.visualization_data, f"{folder}/visualization_data", GROUP)
        write_json(self.analysis_results, f"{folder}/analysis_results")


def analyse_upload(
    table: DataFrame,
    scope: str = "window",
    hours: float = WINDOW_HOURS,
    limits: Thresholds = Thresholds(),
    aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES,
) -> UploadResult:
    """Chart rows, findings, and one ``{group, analysis}`` row per finding, or one per group without any."""
    samples = upload_samples(table, aliases).dropna(subset=["metric"])
    rows = scoped(samples, scope, hours, by=GROUP)
    findings = Detector(rows, GROUP, limits).findings()
    said = findings.select(*GROUP, F.concat(series_label(), F.lit(": "), F.col("rule")).alias("analysis"))
    groups = rows.series.df.select(*GROUP).distinct()
    results = groups.join(said, list(GROUP), "left").select(
        F.concat_ws(" / ", *GROUP).alias("group"), F.coalesce("analysis", F.lit(NO_ANOMALY)).alias("analysis")
    )
    return UploadResult(chart_series(rows.rows, GROUP), findings, results)
