"""Sample files and tables: check, map, type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.fixed_values import (
    EMPTY_FILE,
    KEY_COLUMNS,
    METRIC_COLUMN,
    METRIC_HIGH,
    METRIC_LOW,
    MISSING_COLUMNS,
    NO_FILE,
    NULL_TOKENS,
    OUT_OF_RANGE,
    PREVIEW_ROWS,
    TIME_COLUMN,
    UNREADABLE_FILE,
    UPLOAD_FIELDS,
)
from fleetwatch.operators.ordering import running_totals
from fleetwatch.operators.skew import derived, find_hot, join_table
from fleetwatch.session import Table, materialise, materialise_kinds

SEQ = "seq"  # tie-breaker between samples of one pod at one time
_CORRUPT = "__corrupt"

# Spellings of a date that are no ISO 8601; of 1/2/2024 the month comes first.
TIME_REWRITES = (
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})[ T](\d{2})(\d{2})$", "$1-$2-$3 $4:$5"),
    (r"^(\d{4})(\d{2})(\d{2})[ T](\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),
)
_OFFSET = r":\d{2}(\.\d+)?\s*(Z|[+-]\d{2}(:?\d{2})?)$"

# Column names under which an upload may carry a field, compared without case, blanks and signs.
FIELD_ALIASES: Mapping[str, Sequence[str]] = {
    "service": ("service", "servicename", "svc", "app", "服务", "服务名称"),
    "pod": ("pod", "podname", "container", "pod名称"),
    "metric": ("metric", "metricname", "指标", "指标名称"),
    "node": ("node", "nodename", "host", "hostname", "节点", "节点信息"),
    "timestamp": ("timestamp", "time", "ts", "datetime", "时间", "时间戳"),
    "cpu_usage": ("cpuusage", "cpu", "cpupercent", "usage", "value", "cpu使用率"),
}


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    pattern: str | None = None,
    multi_line: bool = False,
    source: str | None = None,
    row_number: str | None = None,
    too_long: str | None = None,
) -> DataFrame:
    """Read headed CSV files as text columns, by name.

    ``path`` may be any URI Spark can open. All files of one call must have the same
    header; a different one is an error, not a silent swap of columns. Rows that are too
    short are filled with nulls, rows that are too long are an error, or, where ``too_long``
    names a column, marked in it. ``source`` names a column for the path of each row's file,
    ``row_number`` one for the number of the row, from 0, over all files in order of their paths.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    paths = [path] if isinstance(path, str) else list(path)
    try:
        names = reader.csv(paths).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(NO_FILE + ", ".join(paths)) from error
        raise
    if not names:
        raise ValueError(EMPTY_FILE)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = (
        reader.option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .schema(T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())]))
        .csv(paths)
    )
    if source:
        rows = rows.select("*", F.col("_metadata.file_path").alias(source))
    if row_number:
        rows = _with_places(rows)
    wider = ", ".join(f"`{n}` STRING" for n in [*names, "__extra"])
    is_long = F.col(_CORRUPT).isNotNull() & F.from_csv(F.col(_CORRUPT), wider)["__extra"].isNotNull()
    # always true, but reads a column: Spark refuses scans of nothing but the corrupt record
    true = F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0
    if too_long:
        rows = rows.filter(true).withColumn(too_long, is_long)
    else:
        rows = rows.filter(F.when(~is_long, true).otherwise(
            F.raise_error(F.concat(F.lit(f"{UNREADABLE_FILE}: "), F.col(_CORRUPT))).cast("boolean")
        ))
    rows = rows.drop(_CORRUPT)
    return _numbered(rows, row_number) if row_number else rows


_PLACE = ("__file", "__block", "__at")


def _with_places(rows: DataFrame) -> DataFrame:
    """Which file and block a row was read from, and a number that rises in each block as its rows do."""
    return rows.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
    )


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Number rows in the order of their files, without sorting them: counts of blocks give where each block begins.

    The files are read once more for the counts. Blocks are read alike both times, as they follow from the list of files.
    """
    ends = materialise(rows.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")))
    blocks = ends.df.withColumn("__all", F.lit(0))
    totals = {"__upto": F.col("__n")}
    placed = running_totals(blocks, ["__all"], ["__file", "__block"], totals, find_hot(blocks, ["__all"], at_most=ends.rows))
    starts = placed.select("__file", "__block", (F.col("__upto") - F.col("__n") - F.col("__first")).alias("__shift"))
    both = join_table(rows, derived(starts, ends), ["__file", "__block"])
    return both.withColumn(name, F.col("__at") + F.col("__shift")).drop(*_PLACE, "__shift")


def file_preview(spark: SparkSession, path: str | Sequence[str], rows: int = PREVIEW_ROWS, **options) -> DataFrame:
    """The first rows of a file as they stand in it; of several files, in order of their paths. Reads the files once."""
    read = _with_places(read_csv(spark, path, **options))
    # a file that has a second block holds more rows in its first than a preview shows
    return read.filter("__block = 0").orderBy("__file", "__at").limit(rows).drop(*_PLACE)


def required_columns(metric_col: str = METRIC_COLUMN) -> list[str]:
    return [*KEY_COLUMNS, TIME_COLUMN, metric_col]


def check_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{MISSING_COLUMNS}{missing}")


def null_if_token(col: Column) -> Column:
    return F.when(~col.isin(*NULL_TOKENS), col)


def without_tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: null_if_token(F.col(c)) for c in columns})


def clean_metric(col: Column) -> Column:
    """A missing number is NULL, never NaN."""
    number = col.cast("double")
    return F.when(~F.isnan(number), number)


def time_of(col: Column, rewrites: Sequence[tuple[str, str]] = TIME_REWRITES, failing: bool = True) -> Column:
    """A time from text. Text with an offset is an instant and becomes its time in UTC; other text is taken as it stands.

    ``rewrites`` (pattern, replacement) bring other spellings to year-month-day. Text that then
    is no time fails the job, or is null where it is not ``failing``.
    """
    cast = Column.cast if failing else Column.try_cast
    text = F.trim(col)
    other = text
    for pattern, replacement in rewrites:
        other = F.regexp_replace(other, pattern, replacement)
    text = F.when(text.rlike(r"^\d{4}-"), text).otherwise(other)
    shown = cast(text, "timestamp").cast("timestamp_ntz")
    instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), shown)
    return F.when(text.rlike(_OFFSET), instant).otherwise(cast(text, "timestamp_ntz"))


def typed_samples(df: DataFrame, metric_col: str = METRIC_COLUMN, keep: Sequence[str] = ()) -> DataFrame:
    """Samples with typed columns, from a table that has the required columns.

    Text that cannot be read as a time or number fails the job. ``keep`` names extra
    columns to carry along.
    """
    check_columns(df, required_columns(metric_col))
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    needed = [c for c in [*required_columns(metric_col), *keep] if c in text]
    seq = F.col(SEQ).cast("bigint") if SEQ in df.columns else F.xxhash64(*sorted(df.columns))
    return without_tokens(df.withColumn(SEQ, seq), needed).select(
        *keep,
        *[F.col(c).cast("string").alias(c) for c in KEY_COLUMNS],
        (time_of(F.col(TIME_COLUMN)) if TIME_COLUMN in text else F.col(TIME_COLUMN).cast("timestamp_ntz")).alias(TIME_COLUMN),
        clean_metric(F.col(metric_col)).alias(METRIC_COLUMN),
        SEQ,
    )


def read_samples(
    spark: SparkSession, path: str | Sequence[str], metric_col: str = METRIC_COLUMN, row_numbers: bool = False, **options
) -> DataFrame:
    """Typed samples of files. With ``row_numbers`` their sequence number is the row's place in the files, which ties are broken by."""
    return typed_samples(read_csv(spark, path, row_number=SEQ if row_numbers else None, **options), metric_col)


def checked_samples(table: DataFrame, metric_col: str = METRIC_COLUMN, keep: Sequence[str] = (), too_long: str | None = None) -> tuple[Table, Table]:
    """Typed samples of the rows that can be read, and the other rows as they came, each with its ``reason``.

    Both are written in one pass over the table. ``too_long`` names the mark of rows with too many fields.
    """
    check_columns(table, required_columns(metric_col))
    plain = without_tokens(table, [c for c in required_columns(metric_col)])
    text, number = F.col(TIME_COLUMN), F.col(metric_col)
    time = time_of(text, failing=False)
    value = number.try_cast("double")
    reason = F.when(F.col(too_long), "too many fields") if too_long else F.when(F.lit(False), "")
    reason = reason.when(text.isNotNull() & time.isNull(), TIME_COLUMN).when(number.isNotNull() & value.isNull(), metric_col)
    seq = F.col(SEQ).cast("bigint") if SEQ in table.columns else F.xxhash64(*sorted(table.columns))
    judged = plain.select("*", time.alias("__time"), clean_metric(value).alias("__value"), reason.alias("reason"), seq.alias("__seq"))
    good = judged.filter("reason IS NULL").select(
        *keep, *KEY_COLUMNS, F.col("__time").alias(TIME_COLUMN), F.col("__value").alias(METRIC_COLUMN), F.col("__seq").alias(SEQ)
    )
    refused = judged.filter("reason IS NOT NULL").select(*keep, *required_columns(metric_col), F.col("__seq").alias(SEQ), "reason")
    made = materialise_kinds({"good": good, "refused": refused.withColumnRenamed(TIME_COLUMN, "time_text").withColumnRenamed(metric_col, "value_text")})
    return made["good"], made["refused"]


def read_checked(spark: SparkSession, path: str | Sequence[str], metric_col: str = METRIC_COLUMN, **options) -> tuple[Table, Table]:
    """Samples of files, and the rows of them that cannot be read: file, row number and reason."""
    table = read_csv(spark, path, source="source_file", row_number=SEQ, too_long="__long", **options)
    return checked_samples(table, metric_col, ("source_file",), "__long")


def out_of_range(samples: DataFrame, low: float = METRIC_LOW, high: float = METRIC_HIGH) -> DataFrame:
    """Samples whose value lies outside the accepted range. A missing value counts as outside."""
    return samples.filter(~F.coalesce(F.col(METRIC_COLUMN).between(low, high), F.lit(False)))


def require_range(samples: DataFrame, low: float = METRIC_LOW, high: float = METRIC_HIGH) -> DataFrame:
    """The same samples; the job fails at the first value outside the accepted range."""
    fine = F.coalesce(F.col(METRIC_COLUMN).between(low, high), F.lit(False))
    return samples.filter(
        F.when(fine, True).otherwise(
            F.raise_error(F.lit(OUT_OF_RANGE.format(low=low, high=high))).cast("boolean")
        )
    )


def column_mappings(df: DataFrame, aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES) -> dict[str, str]:
    """Field to column, for the fields that can be found."""
    plain = {}
    for column in df.columns:
        plain.setdefault("".join(ch for ch in column.lower() if ch.isalnum()), column)
    found = {field: next((plain[a] for a in names if a in plain), None) for field, names in aliases.items()}
    return {field: column for field, column in found.items() if column is not None}


def upload_samples(df: DataFrame, aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES) -> DataFrame:
    """Samples of an uploaded table, found through the column mapping, with their metric."""
    mapping = column_mappings(df, aliases)
    missing = [f for f in UPLOAD_FIELDS if f not in mapping]
    if missing:
        raise ValueError(f"Missing required fields: {', '.join(missing)}; columns present: {', '.join(df.columns)}")
    seq = F.col(SEQ) if SEQ in df.columns else F.xxhash64(*sorted(df.columns))
    named = df.select(*[F.col(f"`{mapping[f]}`").alias(f) for f in UPLOAD_FIELDS], seq.alias(SEQ))
    named = named.withColumnRenamed("cpu_usage", METRIC_COLUMN)
    return typed_samples(named, keep=("metric",))


def preview(df: DataFrame, order: Sequence[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(*order).limit(rows)
