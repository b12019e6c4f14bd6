"""Text helpers: trimming, templates, number text, tagged answers."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetwatch.fixed_values import MISSING_NUMBER, NO_ANOMALY, POD_PATTERN, RESULT_PATTERN

# All white space a Python program strips, in any script.
_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


# Stands before the pods of a part, where a service has several parts.
PEERS_LINE = "All {n} pods: mean of means {mean}, max {max}, min {min}, std of means {std}\n\n"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), _BLANKS, "")


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """Put columns in place of ``{name}``. Braces inside the columns stay as they are."""
    pieces = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def two_decimals(value: Column | str) -> Column:
    """Number text with two decimals, half rounded away from zero; ``nan`` for a missing number, ``inf`` and ``-inf`` as such."""
    number = _col(value).cast("double")
    exact = F.round(_col(value), 6).try_cast("decimal(38,6)")
    beyond = F.format_string("%.2f", number)  # more digits than a decimal holds
    text = F.coalesce(F.round(exact, 2).cast("string"), beyond)
    return (
        F.when(number.isNull() | F.isnan(number), F.lit(MISSING_NUMBER))
        .when(number == float("inf"), F.lit("inf"))
        .when(number == float("-inf"), F.lit("-inf"))
        .otherwise(text)
    )


def first_tag(value: Column | str, pattern: str = RESULT_PATTERN) -> Column:
    """Trimmed body of the first match; empty text where there is none."""
    return strip(F.regexp_extract(F.coalesce(_col(value), F.lit("")), "(?U)" + pattern, 1))


def all_tags(value: Column | str, pattern: str = POD_PATTERN) -> Column:
    """Trimmed bodies of all matches, in order."""
    found = F.regexp_extract_all(F.coalesce(_col(value), F.lit("")), F.lit("(?U)" + pattern), F.lit(1))
    return F.transform(found, strip)


def is_flagged(answer: Column | str) -> Column:
    """Does the answer's result lack the marker for "no anomaly"?"""
    return ~F.contains(first_tag(answer), F.lit(NO_ANOMALY))
