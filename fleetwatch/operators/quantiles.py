"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.operators.ordering import running_totals
from fleetwatch.operators.skew import HotGroups, find_hot, join_table, split_hot
from fleetwatch.session import Table, materialise

# percentile() keeps the distinct values of up to 128 groups in memory. Groups up to this
# size are left to it; bigger ones are sorted, which can spill.
PERCENTILE_ROWS = 100_000


def group_medians(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    hot: HotGroups,
    others: Sequence[Column] = (),
) -> DataFrame:
    """Exact medians per group, one for each ``column: name``, next to other aggregates of the same pass.

    Values of a hot group are counted first, where they lie; what is left is ordered in
    slices, and the middle is read off the running count.
    """
    keys = list(keys)
    regular, heavy = split_hot(df, hot)
    if hot.regular_rows <= PERCENTILE_ROWS:
        medians = [F.percentile(value, F.lit(0.5)).alias(name) for value, name in values.items()]
        out = regular.groupBy(*keys).agg(*medians, *others)
    else:
        out = _sorted_medians(regular, keys, values, others)
    if heavy is None:
        return out
    counts = [F.count(value).alias(f"__all_{name}") for value, name in values.items()]
    whole = materialise(heavy.groupBy(*keys).agg(*counts, *others))
    found = whole.df
    for value, name in values.items():
        found = found.join(_heavy_median(heavy, keys, value, name, whole, hot.limit), keys, "left")
    return out.unionByName(found.select(*out.columns))


def _sorted_medians(df: DataFrame, keys: list[str], values: Mapping[str, str], others: Sequence[Column]) -> DataFrame:
    for value, name in values.items():
        ordered = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        whole_group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumns({
            f"__rank_{name}": F.row_number().over(ordered),
            f"__all_{name}": F.count(value).over(whole_group),
        })
    medians = [
        _middle_of(value, name, lambda rank, name=name: F.col(f"__rank_{name}") == rank) for value, name in values.items()
    ]
    return df.groupBy(*keys).agg(*medians, *others)


def _heavy_median(heavy: DataFrame, keys: list[str], value: str, name: str, whole: Table, limit: int) -> DataFrame:
    counted = materialise(
        heavy.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    )
    hot = find_hot(counted.df, keys, limit, at_most=counted.rows)
    upto = running_totals(counted.df, keys, [value], {"__upto": F.col("__n")}, hot)

    def holds(rank: Column) -> Column:
        return (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank)

    return join_table(upto, whole, keys).groupBy(*keys).agg(_middle_of(value, name, holds))


def _middle_of(value: str, name: str, holds: Callable[[Column], Column]) -> Column:
    """Mean of the values at the two middle ranks of ``__all_<name>`` values."""
    total = F.col(f"__all_{name}")
    lower, upper = F.shiftright(total + 1, 1), F.shiftright(total, 1) + 1
    at = [F.max(F.when(holds(rank), F.col(value))) for rank in (lower, upper)]
    return (at[0] * 0.5 + at[1] * 0.5).alias(name)
