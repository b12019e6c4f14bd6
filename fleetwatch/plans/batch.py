"""One run over a set of samples: window, charts, analysis, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetwatch.fixed_values import METRIC_COLUMN, WINDOW_HOURS
from fleetwatch.operators.answers import all_normal, anomalies, failed_status, named_pods, only_known, report_lines, status
from fleetwatch.operators.charts import anomalous_series, chart_meta, chart_series, chart_ticks
from fleetwatch.operators.detector import Detector, Thresholds
from fleetwatch.operators.inference import Model
from fleetwatch.operators.request_tree import Ask, asked_once, judged_services
from fleetwatch.operators.requests import image_requests
from fleetwatch.operators.series import BY, Scoped, profile, scoped, window_bounds
from fleetwatch.operators.texts import ServiceTexts
from fleetwatch.session import Table, materialise
from fleetwatch.sinks.tables import write_charts, write_json, write_report
from fleetwatch.sources.images import read_images
from fleetwatch.sources.samples import read_samples


@dataclass(frozen=True)
class Report:
    by: tuple[str, ...]
    anomalies: Table      # by, pod
    found: DataFrame      # what each path or rule said
    series: DataFrame     # chart lines of all services
    ticks: DataFrame
    meta: DataFrame
    lines_of: Callable[[Table], DataFrame]  # chart lines of the services of a table

    @property
    def all_normal(self) -> DataFrame:
        return all_normal(self.anomalies.df)

    @property
    def lines(self) -> DataFrame:
        return report_lines(self.anomalies.df, self.by)

    @property
    def status(self) -> DataFrame:
        return status(self.anomalies.df)

    @property
    def anomalous_series(self) -> DataFrame:
        """Lines of the abnormal services; only their samples are cut and placed."""
        return self.lines_of(materialise(self.anomalies.df.select(*self.by).distinct()))

    def write(self, folder: str) -> None:
        write_report(self.anomalies.df, f"{folder}/anomalies", [*self.by, "pod"])
        write_charts(self.anomalous_series, f"{folder}/charts", self.by)
        write_json(self.status, f"{folder}/status")


def analyse(
    samples: DataFrame,
    scope: str = "window",
    hours: float = WINDOW_HOURS,
    by: Sequence[str] = BY,
    limits: Thresholds = Thresholds(),
    make_model: Callable[[], Model] | None = None,
    images: DataFrame | None = None,
    known_only: bool = False,
    ask: Ask | None = None,
    row_numbers: bool = False,
) -> Report:
    """Find the abnormal pods: by the rules, or, where a model (or a way to ask one) is given, by asking it.

    Charts always show the windowed and downsampled rows; ``scope`` says which rows are
    analysed. With ``row_numbers`` a model sees values under their sequence numbers.
    """
    profiled = profile(samples, by)
    windows = window_bounds(profiled, hours, by).df
    shown = scoped(samples, "window", hours, by=by, profiled=profiled)
    rows = shown if scope == "window" else scoped(samples, scope, by=by, profiled=profiled)
    if make_model is not None and ask is None:
        ask = asked_once(make_model)
    if ask is None:
        found = materialise(Detector(rows, by, limits).findings()).df
    else:
        found = _asked(rows, by, ask, images, row_numbers)
        if known_only:
            found = only_known(found, profiled.df, by)

    def lines_of(services: Table) -> DataFrame:
        # windows come from the profile, so other services' samples are not needed for them
        theirs = anomalous_series(samples, services, by)
        return chart_series(scoped(theirs, "window", hours, by=by, profiled=profiled).rows, by)

    return Report(
        lines_of=lines_of,
        by=tuple(by),
        anomalies=materialise(anomalies(found, by)),
        found=found,
        series=chart_series(shown.rows, by),
        ticks=chart_ticks(windows, by=by),
        meta=chart_meta(windows, hours, by),
    )


def _asked(rows: Scoped, by: Sequence[str], ask: Ask, images: DataFrame | None, row_numbers: bool) -> DataFrame:
    """Pods that answers name. Services of any size are judged by one request in the end, and each picture by one."""
    named = named_pods(judged_services(ServiceTexts(rows, by, row_numbers=row_numbers), ask, by), by)
    return named if images is None else named.unionByName(named_pods(ask(image_requests(images, by)), by))


def run_files(
    spark: SparkSession,
    path: str,
    out: str,
    metric_col: str = METRIC_COLUMN,
    image_folder: str | None = None,
    row_numbers: bool = False,
    **options,
) -> Report:
    """Read sample files, analyse them, write the report. A failed run leaves its status and raises.

    ``row_numbers`` reads the files once more to number their rows: values shown to a model have them, ties follow them.
    """
    try:
        images = read_images(spark, image_folder) if image_folder else None
        samples = read_samples(spark, path, metric_col, row_numbers)
        report = analyse(samples, images=images, row_numbers=row_numbers, **options)
        report.write(out)
    except Exception as error:
        write_json(failed_status(spark, error), f"{out}/status")
        raise
    return report
