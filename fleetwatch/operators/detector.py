"""Built-in detector: which pods stand apart from their peers.

Rules: a level away from the peers (``level``, and ``axis`` relative to the range of the
chart), a dead flat line (``flat``), high load for a long time (``high``), and a shape
unlike the peers' (``shape``). Short spikes and dips are smoothed away first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetwatch.functions.times import MICROS_PER_MINUTE, bucket_number, micros_between
from fleetwatch.operators.ordering import running_totals, with_neighbours
from fleetwatch.operators.quantiles import group_medians
from fleetwatch.operators.series import BY, ORDER, VALUE, Scoped, series_keys
from fleetwatch.operators.skew import HotGroups, derived, find_hot, join_table
from fleetwatch.session import Table, materialise, materialise_kinds

MAD_SCALE = 1.4826  # turns a median absolute deviation into a standard deviation, for normal noise


@dataclass(frozen=True)
class Thresholds:
    spike_reach: int = 2
    spike_cut: float = 3.0
    level_cut: float = 3.5
    level_floor: float = 0.05
    axis_cut: float = 0.25
    flat_share: float = 0.05
    flat_rows: int = 5
    high_value: float = 80.0
    high_minutes: int = 30
    high_gap_minutes: int = 15  # a longer time without a sample ends a stretch
    shape_cut: float = 0.3
    shape_buckets: int = 8
    shape_minutes: int = 60


def _middle(values: Sequence[Column]) -> Column:
    """Median of a few columns, nulls left out."""
    ordered = F.sort_array(F.array(*values))  # nulls first
    missing = sum((v.isNull().cast("int") for v in values), F.lit(0))
    last = missing + F.lit(len(values) - 1)   # first plus last position of the values
    return F.get(ordered, F.shiftright(last, 1)) * 0.5 + F.get(ordered, F.shiftright(last + 1, 1)) * 0.5


def despiked(rows: DataFrame, by: Sequence[str], limits: Thresholds, hot: HotGroups) -> DataFrame:
    """Rows have a time and a sequence number. Add ``smooth``: the value, or the median of its surroundings where it sticks out of them; and ``since``: microseconds from the sample before."""
    reach = limits.spike_reach

    def smooth(part: DataFrame, around: WindowSpec) -> DataFrame:
        near = [F.lag(VALUE, -i).over(around) if i else F.col(VALUE) for i in range(-reach, reach + 1)]
        part = part.withColumns({f"__v{i}": c for i, c in enumerate(near)})
        part = part.withColumn("since", micros_between(F.lag("timestamp").over(around), "timestamp"))
        near = [F.col(f"__v{i}") for i in range(2 * reach + 1)]
        part = part.withColumn("__centre", _middle(near))
        part = part.withColumn("__gap", _middle([F.abs(c - F.col("__centre")) for c in near]))
        sticks_out = F.abs(F.col(VALUE) - F.col("__centre")) > limits.spike_cut * MAD_SCALE * F.col("__gap")
        return part.withColumn("smooth", F.when(sticks_out, F.col("__centre")).otherwise(F.col(VALUE))).drop(
            "__centre", "__gap", *[f"__v{i}" for i in range(2 * reach + 1)]
        )

    return with_neighbours(rows, series_keys(by), ORDER, max(reach, 1), smooth, hot, no_nulls=True)


class Detector:
    """The rules over one set of scoped samples.

    Smoothed rows are read by three aggregations that share one shuffle of the samples;
    everything after them works on one row per pod, or per pod and time bucket.
    """

    def __init__(self, scoped: Scoped, by: Sequence[str] = BY, limits: Thresholds = Thresholds()):
        self.by = list(by)
        self.keys = series_keys(by)
        self.limits = limits
        self.hot = scoped.hot
        self._tables: dict[str, Table] = {}
        self.rows = scoped.rows.filter(F.col("timestamp").isNotNull() & F.col(VALUE).isNotNull())

    @cached_property
    def smoothed(self) -> DataFrame:
        rows = despiked(self.rows.select(*self.keys, *ORDER, VALUE), self.by, self.limits, self.hot)
        # hot groups are counted several times further on: do not smooth them anew each time
        return rows if self.hot.table is None else materialise(rows).df

    def _pod_figures(self) -> DataFrame:
        return group_medians(
            self.smoothed, self.keys, {"smooth": "middle"}, self.hot,
            others=(
                F.min("smooth").alias("low"),
                F.max("smooth").alias("top"),
                F.stddev_samp("smooth").alias("spread"),
                F.count(F.lit(1)).alias("n"),
            ),
        )

    def _bucket_levels(self) -> DataFrame:
        bucket = bucket_number("timestamp", self.limits.shape_minutes)
        return self.smoothed.groupBy(*self.keys, bucket.alias("bucket")).agg(F.avg("smooth").alias("pod_level"))

    def _high_stretches(self) -> DataFrame:
        """Length of the longest unbroken stretch of high values of each pod that has any. A low value or a gap in time ends a stretch."""
        is_high = F.col("smooth") >= self.limits.high_value
        near = F.coalesce("since", F.lit(0)) <= self.limits.high_gap_minutes * MICROS_PER_MINUTE
        marks = running_totals(self.smoothed, self.keys, ORDER, {"__stretch": (~(is_high & near)).cast("bigint")}, self.hot, no_nulls=True)
        stretches = (
            marks.filter(is_high)
            .groupBy(*self.keys, "__stretch")
            .agg(micros_between(F.min("timestamp"), F.max("timestamp")).alias("__length"))
        )
        return stretches.groupBy(*self.keys).agg(F.max("__length").alias("longest"))

    def _measure(self, *kinds: str) -> None:
        """Write the figures of these kinds in one job: one scan, one shuffle of the samples."""
        make = {"pods": self._pod_figures, "buckets": self._bucket_levels, "stretches": self._high_stretches}
        wanted = {kind: make[kind]() for kind in kinds if kind not in self._tables}
        if wanted:
            self._tables |= materialise_kinds(wanted)

    def _table(self, kind: str) -> Table:
        self._measure(kind)
        return self._tables[kind]

    @property
    def pods(self) -> Table:
        """One row per pod: median, range, spread and number of its smoothed values."""
        return self._table("pods")

    @property
    def buckets(self) -> Table:
        """Mean of each pod in each time bucket."""
        return self._table("buckets")

    @property
    def stretches(self) -> Table:
        """One row per pod with high values: length of the longest stretch of them."""
        return self._table("stretches")

    @cached_property
    def _judged(self) -> DataFrame:
        """One row per pod with its own figures and those of its service."""
        hot = find_hot(self.pods.df, self.by, at_most=self.pods.rows)
        services = group_medians(
            self.pods.df, self.by, {"middle": "service_middle", "spread": "service_spread"}, hot,
            others=(F.min("low").alias("service_low"), F.max("top").alias("service_top")),
        )
        placed = join_table(self.pods.df, derived(services, self.pods), self.by)
        placed = placed.withColumn("away", F.abs(F.col("middle") - F.col("service_middle")))
        gaps = group_medians(placed, self.by, {"away": "service_gap"}, hot)
        return join_table(placed, derived(gaps, self.pods), self.by).withColumn(
            "service_range", F.col("service_top") - F.col("service_low")
        )

    def _level(self) -> tuple[Column, Column]:
        scale = F.greatest(MAD_SCALE * F.col("service_gap"), self.limits.level_floor * F.col("service_range"))
        score = (F.col("middle") - F.col("service_middle")) / F.nullif(scale, F.lit(0.0))
        return score, F.abs(score) > self.limits.level_cut

    def _axis(self) -> tuple[Column, Column]:
        score = F.col("away") / F.nullif(F.col("service_range"), F.lit(0.0))
        return score, score > self.limits.axis_cut

    def _flat(self) -> tuple[Column, Column]:
        score = F.col("spread") / F.nullif(F.col("service_spread"), F.lit(0.0))
        is_flat = F.col("spread") < self.limits.flat_share * F.col("service_spread")
        return score, is_flat & (F.col("n") >= self.limits.flat_rows)

    def _high(self) -> tuple[Column, Column]:
        score = F.coalesce("longest", F.lit(0)) / F.lit(float(MICROS_PER_MINUTE))
        is_long = F.col("longest").isNotNull() & (score >= self.limits.high_minutes)
        return score, is_long & (F.col("service_middle") < self.limits.high_value)

    def level(self) -> DataFrame:
        """Distance of the pod's median from the service's, in robust standard deviations."""
        return self._scored(self._judged, *self._level())

    def axis(self) -> DataFrame:
        """Distance of the pod's median from the service's, as a share of the chart's vertical range."""
        return self._scored(self._judged, *self._axis())

    def flat(self) -> DataFrame:
        """Spread of the pod as a share of the median spread of its service."""
        return self._scored(self._judged, *self._flat())

    def high(self) -> DataFrame:
        """Minutes of the longest unbroken stretch of high values, where the service itself is not high."""
        self._measure("pods", "stretches")
        return self._scored(self._with_stretches(), *self._high())

    def _with_stretches(self) -> DataFrame:
        return self._judged.join(self.stretches.df, self.keys, "left")

    def shape(self) -> DataFrame:
        """Correlation of the pod with the median line of its service."""
        on = [*self.by, "bucket"]
        hot = find_hot(self.buckets.df, on, at_most=self.buckets.rows)
        line = derived(group_medians(self.buckets.df, on, {"pod_level": "line"}, hot), self.buckets)
        both = join_table(self.buckets.df, line, on).groupBy(*self.keys).agg(
            F.covar_pop("pod_level", "line").alias("__together"),
            F.stddev_pop("pod_level").alias("__one"),
            F.stddev_pop("line").alias("__two"),
            F.count(F.lit(1)).alias("n"),
        )
        # a line that does not move has no shape; rounding noise must not give it one
        moves = F.when((F.col("__one") > 1e-9) & (F.col("__two") > 1e-9), F.col("__one") * F.col("__two"))
        score = F.col("__together") / moves
        return self._scored(both, score, (score < self.limits.shape_cut) & (F.col("n") >= self.limits.shape_buckets))

    def _scored(self, df: DataFrame, score: Column, flagged: Column) -> DataFrame:
        return df.select(*self.keys, score.alias("score"), F.coalesce(flagged, F.lit(False)).alias("flagged"))

    def findings(self) -> DataFrame:
        """Every rule that flags a pod, with the path (text or chart) it belongs to."""
        self._measure("pods", "buckets", "stretches")
        rules = {"level": ("text", self._level()), "axis": ("chart", self._axis()),
                 "flat": ("text", self._flat()), "high": ("text", self._high())}
        verdicts = F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.lit(path).alias("path"), score.alias("score"), flagged.alias("flagged"))
            for rule, (path, (score, flagged)) in rules.items()
        ])
        by_figures = self._with_stretches().select(*self.keys, F.inline(verdicts)).filter("flagged").drop("flagged")
        by_shape = self.shape().filter("flagged").select(
            *self.keys, F.lit("shape").alias("rule"), F.lit("text").alias("path"), "score"
        )
        return by_figures.unionByName(by_shape)
