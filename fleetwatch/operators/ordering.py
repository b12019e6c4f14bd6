"""Positions, running totals and neighbours inside ordered groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetwatch.operators.skew import SLICE, HotGroups, cut_into_slices, join_table, split_hot
from fleetwatch.session import materialise


def ascending(order: Sequence[str], no_nulls: bool = False) -> list[Column]:
    """Columns without nulls are ordered as sorted tables are, so that rows of these need no sort."""
    return [F.col(c).asc() if no_nulls else F.col(c).asc_nulls_last() for c in order]


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    hot: HotGroups,
    no_nulls: bool = False,
) -> DataFrame:
    """Add running totals of bigint expressions over each group in ``order``, current row included.

    ``order`` must end in a unique column; ``no_nulls`` says that its columns hold none. Hot groups are cut into slices; each slice is
    summed on its own and starts from the total of the slices before it.
    """
    keys = list(keys)
    regular, heavy = split_hot(df, hot)
    out = _totals_over(regular, keys, order, totals, no_nulls)
    if heavy is None:
        return out
    sliced = cut_into_slices(heavy, keys, order, hot.limit)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys, SLICE)
        .agg(*[F.sum(c).alias(n) for n, c in totals.items()])
        .select(*keys, SLICE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__from_{n}") for n in totals])
    )
    placed = join_table(_totals_over(sliced, [*keys, SLICE], order, totals), materialise(starts), [*keys, SLICE])
    placed = placed.withColumns({n: F.col(n) + F.col(f"__from_{n}") for n in totals})
    return out.unionByName(placed.select(*out.columns))


def _totals_over(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column], no_nulls: bool = False
) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy(*ascending(order, no_nulls)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(c).over(upto).alias(n) for n, c in totals.items()])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: HotGroups, name: str = "pos", no_nulls: bool = False) -> DataFrame:
    """Number the rows of each group from 1 in ``order``."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, hot, no_nulls)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    hot: HotGroups,
    no_nulls: bool = False,
) -> DataFrame:
    """Apply ``compute(rows, window)``, which may look at ``reach`` rows to either side.

    A hot group is cut into blocks of ``hot.limit`` positions. Each block gets copies of
    the ``reach`` rows around it, which are dropped again afterwards.
    """
    keys = list(keys)
    regular, heavy = split_hot(df, hot)
    out = compute(regular, Window.partitionBy(*keys).orderBy(*ascending(order, no_nulls)))
    if heavy is None:
        return out
    size = max(hot.limit, reach)
    at = F.col("__pos") - 1
    block, offset = F.floor(at / size).cast("bigint"), F.pmod(at, F.lit(size))
    placed = positions(heavy, keys, order, hot, name="__pos").withColumn("__home", block)
    shared = placed.withColumn(
        "__block",
        F.explode(
            F.array_compact(
                F.array(
                    F.col("__home"),
                    F.when((offset < reach) & (F.col("__home") > 0), F.col("__home") - 1),
                    F.when(offset >= size - reach, F.col("__home") + 1),
                )
            )
        ),
    )
    done = compute(shared, Window.partitionBy(*keys, "__block").orderBy("__pos"))
    return out.unionByName(done.filter(F.col("__home") == F.col("__block")).select(*out.columns))
