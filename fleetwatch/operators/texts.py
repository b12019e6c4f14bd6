"""Texts about a service or a log stream, in parts of bounded size.

One row holds one part. A service or stream that fits one part has exactly one row with
its whole text; a bigger one has several, and its parts in order are its whole text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.fixed_values import (
    NO_VALUES, POD_HEAD, STATS_HEADING, STATS_LINE, VALUES_END, VALUES_HEAD, VALUES_HEADING,
)
from fleetwatch.functions.text import PEERS_LINE, fill, two_decimals
from fleetwatch.operators.ordering import positions, running_totals
from fleetwatch.operators.series import BY, MEMBER, ORDER, VALUE, Scoped, profile, series_keys, window_stats
from fleetwatch.operators.skew import derived, find_hot, join_table
from fleetwatch.session import Table, materialise_kinds
from fleetwatch.sources.logs import STREAM_KEYS

PART_VALUES = 20_000
PART_PODS = 10_000
PART_BYTES = 1024 * 1024


def _joined(text: str, order: Sequence[str], where: str = "true"):
    """Texts of a group put together in order."""
    return F.expr(f"listagg({text}, '') WITHIN GROUP (ORDER BY {', '.join(order)}) FILTER (WHERE {where})")


def pods_per_service(samples: DataFrame, by: Sequence[str] = BY, part_pods: int = PART_PODS) -> DataFrame:
    """The pods of each service, in key order."""
    profiled = profile(samples, by)
    members = profiled.df.select(*series_keys(by))
    placed = positions(members, by, MEMBER, find_hot(members, by, at_most=profiled.rows))
    part = F.floor((F.col("pos") - 1) / part_pods).cast("bigint")
    return placed.groupBy(*by, part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_pods"), F.sort_array(F.collect_list(F.struct(*MEMBER))).alias("pods")
    )


def _pod_blocks(rows: Scoped, by: Sequence[str], part_values: int, row_numbers: bool) -> DataFrame:
    """Values text per pod, and per ``part_values`` values where a pod has more; none of pods without rows.

    Values are numbered from 0 in each pod, or by the place of their row in the files.
    """
    keys = series_keys(by)
    placed = positions(rows.rows, keys, ORDER, rows.hot, no_nulls=rows.timed)
    chunk = F.floor((F.col("pos") - 1) / part_values).cast("bigint")
    line = F.concat(
        F.when(F.pmod(F.col("pos") - 1, F.lit(part_values)) > 0, "\n").otherwise(""),
        (F.col("seq") if row_numbers else F.col("pos") - 1).cast("string"), F.lit("    "),
        F.coalesce(F.col(VALUE).cast("string"), F.lit("NaN")),
    )
    return (
        placed.select(*keys, "pos", chunk.alias("chunk"), line.alias("line"))
        .groupBy(*keys, "chunk")
        .agg(F.count(F.lit(1)).alias("n"), _joined("line", ["pos"]).alias("lines"))
    )


class ServiceTexts:
    """What is said about each pod of each service, written once, and laid out in parts for all pods or some."""

    def __init__(self, rows: Scoped, by: Sequence[str] = BY, part_values: int = PART_VALUES, row_numbers: bool = False):
        made = materialise_kinds({"blocks": _pod_blocks(rows, by, part_values, row_numbers), "stats": window_stats(rows, by)})
        self.by, self.part_values = tuple(by), part_values
        self.stats = made["stats"]
        # pods without rows have one block; series with very many blocks stay where they are
        one = [F.lit(0).cast("bigint").alias("chunk"), F.lit(1).cast("bigint").alias("n"), F.lit(NO_VALUES).alias("lines")]
        without = self.stats.df.filter("n_rows = 0").select(*series_keys(by), *one)
        self.blocks = Table(made["blocks"].df.unionByName(without), made["blocks"].rows + self.stats.rows, made["blocks"].bytes + self.stats.bytes)

    def pods(self) -> DataFrame:
        return self.stats.df.select(*series_keys(self.by))

    def parts(self, pods: Table | None = None) -> DataFrame:
        """Statistics text and values text of each part; of ``pods`` (keys of series) only, where given.

        Parts are laid out on block sizes alone; the long texts move once, to their part. Where not all pods of a
        service are in one part, the text begins with what all of them together are like.
        """
        by, keys = self.by, series_keys(self.by)
        blocks = self.blocks
        if pods is not None:
            blocks = Table(join_table(blocks.df, pods, keys), blocks.rows, blocks.bytes)
        sizes = blocks.df.select(*keys, "chunk", "n")
        upto = running_totals(sizes, by, [*MEMBER, "chunk"], {"upto": F.col("n")}, find_hot(sizes, by, at_most=blocks.rows))
        part = F.floor((F.col("upto") - F.col("n")) / self.part_values).cast("bigint")
        layout = upto.select(*keys, "chunk", part.alias("part")).withColumn(
            "nth", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("chunk"))
        )
        head = fill(POD_HEAD, {"pod": F.col("pod"), "node": F.col("node")})
        numbers = fill(STATS_LINE, {c: two_decimals(c) for c in ("mean", "max", "min", "std")})
        placed = (
            join_table(blocks.df, derived(layout, blocks), [*keys, "chunk"])
            .join(self.stats.df.select(*keys, F.concat(head, numbers).alias("stats_block")), keys)
            .withColumn("values_block", F.concat(head, F.lit(VALUES_HEAD), F.col("lines"), F.lit(VALUES_END)))
        )
        parts = placed.groupBy(*by, "part").agg(
            F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).alias("n_pods"),
            _joined("stats_block", MEMBER, "nth = 1").alias("stats_blocks"),
            F.concat(F.lit(VALUES_HEADING), _joined("values_block", [*MEMBER, "chunk"])).alias("values_text"),
        )
        stats_text = F.concat(F.lit(STATS_HEADING), F.col("peers"), F.col("stats_blocks")).alias("stats_text")
        peers = _peers(self.stats.df, layout, by, some=pods is not None)
        return join_table(parts, derived(peers, self.stats), by).select(*by, "part", "n_pods", stats_text, "values_text")


def service_texts(rows: Scoped, by: Sequence[str] = BY, part_values: int = PART_VALUES, row_numbers: bool = False) -> DataFrame:
    """Statistics text and values text of each service, in parts."""
    return ServiceTexts(rows, by, part_values, row_numbers).parts()


def _peers(stats: DataFrame, layout: DataFrame, by: Sequence[str], some: bool) -> DataFrame:
    """For services of several parts, or of which only ``some`` pods are shown, what all pods together are like."""
    last = layout.groupBy(*by).agg(F.max("part").alias("last"))
    numbers = {"mean": F.avg("mean"), "max": F.max("max"), "min": F.min("min"), "std": F.stddev_samp("mean")}
    whole = stats.groupBy(*by).agg(F.count(F.lit(1)).cast("string").alias("n"), *[c.alias(name) for name, c in numbers.items()])
    line = fill(PEERS_LINE, {"n": F.col("n"), **{name: two_decimals(name) for name in numbers}})
    return whole.join(last, list(by)).select(*by, F.when((F.col("last") > 0) | F.lit(some), line).otherwise("").alias("peers"))


def log_text(logs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """All messages of each stream, a line break after each, in time order."""
    lines = logs.select(
        *STREAM_KEYS, "event_time", "seq", F.concat(F.coalesce("message", F.lit("")), F.lit("\n")).alias("line")
    ).withColumn("size", F.octet_length("line").cast("bigint"))
    hot = find_hot(lines, STREAM_KEYS, weight="size")
    sized = running_totals(lines, STREAM_KEYS, ["event_time", "seq"], {"upto": F.col("size")}, hot)
    part = F.floor((F.col("upto") - F.col("size")) / part_bytes).cast("bigint")
    return sized.withColumn("part", part).groupBy(*STREAM_KEYS, "part").agg(
        F.count(F.lit(1)).alias("n_events"),
        _joined("line", ["event_time NULLS LAST", "seq"]).alias("text"),
    )
