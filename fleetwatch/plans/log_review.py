"""Review of log streams by a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from fleetwatch.operators.inference import Model, infer
from fleetwatch.operators.request_tree import FAN_IN, Ask, asked_once, merged_answers
from fleetwatch.operators.requests import log_requests
from fleetwatch.operators.texts import PART_BYTES, log_text
from fleetwatch.session import materialise
from fleetwatch.sources.logs import STREAM_KEYS, log_stream_events


def review_streams(
    logs: DataFrame, make_model: Callable[[], Model], part_bytes: int = PART_BYTES, every_stream: bool = False, **picked
) -> DataFrame:
    """One answer per part of each picked stream."""
    events = logs if every_stream else log_stream_events(logs, **picked)
    return materialise(infer(log_requests(log_text(events, part_bytes)), make_model)).df


def review_tree(
    logs: DataFrame,
    make_model: Callable[[], Model] | None = None,
    part_bytes: int = PART_BYTES,
    every_stream: bool = False,
    ask: Ask | None = None,
    fan_in: int = FAN_IN,
    **picked,
) -> DataFrame:
    """One answer for each picked stream, however long it is: parts are reviewed each, and the reviews put together level by level."""
    events = logs if every_stream else log_stream_events(logs, **picked)
    ask = ask or asked_once(make_model)
    return merged_answers(ask(log_requests(log_text(events, part_bytes))), STREAM_KEYS, ask, fan_in=fan_in)
