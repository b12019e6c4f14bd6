"""Hot groups: find them, set them apart, cut them into ordered slices, join past them.

Most groups (pods, log streams) are small and are handled by one task each. A group
with more rows than one task should hold is *hot*. There are at most rows/limit of
them, so the table of hot keys stays small however large the data gets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.functions.times import micros
from fleetwatch.session import Table, materialise

HOT_ROWS_SETTING = "spark.fleetwatch.hotRows"
HOT_ROWS = 5_000_000
HOT_BYTES_SETTING = "spark.fleetwatch.hotBytes"
HOT_BYTES = 1024 * 1024 * 1024

# A table within both bounds may be sent to every executor.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024

SALTS = 64

SLICE = "__slice"
_FAN = 4095          # most pieces one slice is cut into at a time
_DIGITS = 4          # of a piece's number in the name of a slice
_TEXT_CHUNK = 6      # bytes of a string that a double holds exactly
_WRITE_EVERY = 4     # rounds of cutting after which the rows are written, so that the plan stays short


@dataclass(frozen=True)
class HotGroups:
    keys: tuple[str, ...]
    limit: int
    table: Table | None = None  # the hot keys; None where no group is hot
    most: int | None = None     # no other group has more rows than this
    parts: int | None = None    # partitions over which rows of the other groups are spread; None where Spark may choose

    @property
    def regular_rows(self) -> int:
        return self.limit if self.most is None else self.most


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def find_hot(
    df: DataFrame, keys: Sequence[str], limit: int | None = None, at_most: int | None = None, weight: str | None = None
) -> HotGroups:
    """Groups with more than ``limit`` rows, or, where ``weight`` names a column of bytes, with more of them than one task should hold.

    Counts with map-side aggregation on the key columns only, and not at all where the
    table is known to have ``at_most`` so few rows that none can be hot.
    """
    limit = limit or hot_rows(df.sparkSession)
    if weight is not None:
        return _heavy_groups(df, keys, limit, weight)
    if at_most is not None and at_most <= limit:
        return HotGroups(tuple(keys), limit, most=at_most)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*keys)
    if hot.isEmpty():
        return HotGroups(tuple(keys), limit)
    return HotGroups(tuple(keys), limit, materialise(hot))


def _heavy_groups(df: DataFrame, keys: Sequence[str], limit: int, weight: str) -> HotGroups:
    """Slices of heavy groups hold as many rows as fit the bytes, by the biggest row of them all."""
    most = int(df.sparkSession.conf.get(HOT_BYTES_SETTING, str(HOT_BYTES)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(weight).alias("__bytes"), F.max(weight).alias("__most"))
    heavy = materialise(sizes.filter((F.col("__n") > limit) | (F.col("__bytes") > most)), largest="__most")
    if not heavy.rows:
        return HotGroups(tuple(keys), limit)
    limit = max(1, min(limit, most // max(1, heavy.largest or 1)))
    return HotGroups(tuple(keys), limit, Table(heavy.df.select(*keys), heavy.rows, heavy.bytes))


def split_hot(df: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of hot groups (None where there are none)."""
    if hot.table is None:
        return df, None
    keys = list(hot.keys)
    marked = join_table(df, Table(hot.table.df.withColumn("__hot", F.lit(True)), hot.table.rows, hot.table.bytes),
                        keys, how="left")
    regular = marked.filter(F.col("__hot").isNull()).drop("__hot")
    regular = regular.repartition(hot.parts, *keys) if hot.parts else regular
    # hot rows are read in every round of cutting: written once, they don't take all rows along each time
    heavy = materialise(marked.filter(F.col("__hot")).drop("__hot")).df
    return regular, heavy


def fits_broadcast(table: Table) -> bool:
    return table.rows <= BROADCAST_ROWS and table.bytes <= BROADCAST_BYTES


def derived(df: DataFrame, origin: Table) -> Table:
    """A table with at most as many rows as ``origin``: left to be computed on the fly where that is few."""
    return Table(df, origin.rows, origin.bytes) if fits_broadcast(origin) else materialise(df)


def join_table(big: DataFrame, table: Table, on: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``big`` with a written table that has at most one row per key.

    Within the broadcast bounds the table goes to the rows. Beyond them both sides are
    shuffled on the key; a hot key gets a salt and ``salts`` copies of its row, so that
    its rows are spread over that many tasks.
    """
    on = list(on)
    if fits_broadcast(table):
        return big.join(F.broadcast(table.df), on, how)
    hot = find_hot(big, on)
    if hot.table is None:
        return big.join(table.df, on, how)
    marks = hot.table.df.withColumn("__often", F.lit(True))
    marks = F.broadcast(marks) if fits_broadcast(hot.table) else marks
    plain = [c for c, kind in big.dtypes if c not in on and kind != "string"]
    salt = F.pmod(F.xxhash64(*(plain or big.columns)), F.lit(salts)).cast("int")
    salted = big.join(marks, on, "left").withColumn("__salt", F.when(F.col("__often"), salt).otherwise(0)).drop("__often")
    every = F.when(F.col("__often"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = table.df.join(marks, on, "left").withColumn("__salt", F.explode(every)).drop("__often")
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def cut_into_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Add a ``__slice`` text that rises with ``order`` inside each group.

    Slices are found by counting: a slice with more than ``limit`` rows is cut into
    equal ranges of the first order measure that still varies in it, and the pieces are
    counted again. Every cut is a function of the row's own values, so slices are the
    same in every run of a task. Each round leaves at most rows/limit slices to cut, and
    parts the least and the greatest row of each, so rounds end only when no slice is too
    big or its rows are equal in all of ``order``.
    """
    measures = [m for c in order for m in _measures(df, c)]
    names = [f"__m{i}" for i in range(len(measures))]
    rows = df.select("*", F.lit("").alias(SLICE), *[m.value.alias(n) for m, n in zip(measures, names)])
    for turn in count(1):
        big = materialise(
            rows.groupBy(*keys, SLICE)
            .agg(
                F.count(F.lit(1)).alias("__n"),
                *[F.min(n).alias(f"{n}lo") for n in names],
                *[F.max(n).alias(f"{n}hi") for n in names],
            )
            .filter(F.col("__n") > limit)
            .select(*keys, SLICE, _pieces(limit).alias("__fan"), *_widest(measures, names))
            .filter(F.col("__axis").isNotNull())
        )
        if big.rows == 0:
            break
        at = F.coalesce(*[F.when(F.col("__axis") == i, m.number(n, F.col("__skip"))) for i, (m, n) in enumerate(zip(measures, names))])
        share = (at - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
        share = F.when(F.isnan(share), F.lit(1.0)).otherwise(share)
        piece = F.least(F.col("__fan") - 1, F.floor(share * F.col("__fan")))
        digits = F.lpad(F.coalesce(piece, F.lit(0)).cast("string"), _DIGITS, "0")
        rows = join_table(rows, big, [*keys, SLICE], how="left").withColumn(SLICE, F.concat(SLICE, digits))
        rows = rows.drop("__fan", "__axis", "__lo", "__hi", "__skip")
        if turn % _WRITE_EVERY == 0:
            rows = materialise(rows).df
    return rows.drop(*names)


def _pieces(limit: int) -> Column:
    return F.least(F.lit(_FAN), F.greatest(F.lit(2), F.ceil(F.col("__n") * 2 / limit))).cast("bigint")


@dataclass(frozen=True)
class _Measure:
    """A value to compare rows by, after all measures before it: a number or a text."""

    value: Column
    is_text: bool = False

    def number(self, name: str, skip: Column) -> Column:
        """The measure as a double; of a text, the bytes behind the first ``skip`` characters."""
        if not self.is_text:
            return F.col(name)
        rest = F.hex(F.encode(F.substring(F.col(name), skip + 1, F.lit(_TEXT_CHUNK)), "UTF-8"))
        return F.conv(F.rpad(F.substring(rest, 1, 2 * _TEXT_CHUNK), 2 * _TEXT_CHUNK, "0"), 16, 10).cast("double")


def _in_common(one: Column, two: Column) -> Column:
    """How many characters two different texts begin with alike."""
    same = F.zip_with(F.split(one, ""), F.split(two, ""), lambda a, b: a.eqNullSafe(b))
    return (F.array_position(same, False) - 1).cast("int")


def _widest(measures: Sequence[_Measure], names: Sequence[str]) -> list[Column]:
    """The first measure that varies in a slice, and its range.

    All texts of a slice begin as its least and its greatest one do, so the range of a text lies behind that.
    """
    axes, skips, lows, highs = [], [], [], []
    for i, (measure, name) in enumerate(zip(measures, names)):
        low, high = F.col(f"{name}lo"), F.col(f"{name}hi")
        varies = high > low
        if measure.is_text:
            skip = F.when(varies, _in_common(low, high))
            low, high = measure.number(f"{name}lo", skip), measure.number(f"{name}hi", skip)
            varies = high > low
            skips.append(F.when(varies, F.struct(F.lit(i).alias("axis"), skip.alias("skip"))))
        axes.append(F.when(varies, F.lit(i)))
        lows.append(F.when(varies, low))
        highs.append(F.when(varies, high))
    axis = F.coalesce(*axes)
    skip = F.coalesce(*[F.when(s["axis"] == axis, s["skip"]) for s in skips], F.lit(0))
    return [axis.alias("__axis"), F.coalesce(*lows).alias("__lo"), F.coalesce(*highs).alias("__hi"), skip.alias("__skip")]


def _measures(df: DataFrame, name: str) -> list[_Measure]:
    """Measures that follow the order of a column, nulls last."""
    kind = df.schema[name].dataType
    col = F.col(name)
    missing = _Measure(col.isNull().cast("double"))
    if isinstance(kind, T.StringType):
        return [missing, _Measure(col, is_text=True)]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        number, huge = col.cast("double"), F.lit(float("inf"))
        # infinite numbers and NaN have no place in a range: they are parted from the others first
        kinds = F.when(F.isnan(number), 3.0).when(number == huge, 2.0).when(number == -huge, 0.0).otherwise(1.0)
        return [missing, _Measure(F.when(number.isNotNull(), kinds)), _Measure(F.when(kinds == 1.0, number))]
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        whole = micros(col)
    elif isinstance(kind, T.IntegralType):
        whole = col.cast("bigint")
    else:
        raise TypeError(f"Cannot order by column {name} of type {kind.simpleString()}")
    return [  # two halves, each exact as a double
        missing,
        _Measure(F.shiftright(whole, 32).cast("double")),
        _Measure(whole.bitwiseAND(F.lit((1 << 32) - 1)).cast("double")),
    ]
