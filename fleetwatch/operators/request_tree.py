"""Trees of requests: what one request cannot hold is asked in parts, and the answers are asked about again.

However big a service or a log stream is, it ends with one answer, as a small one does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.requests import MERGE_REVIEWS, request_body
from fleetwatch.functions.text import all_tags, fill, is_flagged
from fleetwatch.operators.charts import series_label
from fleetwatch.operators.inference import Model, infer
from fleetwatch.operators.ordering import positions
from fleetwatch.operators.requests import text_requests
from fleetwatch.operators.series import BY, series_keys
from fleetwatch.operators.skew import find_hot
from fleetwatch.operators.texts import ServiceTexts
from fleetwatch.session import Table, materialise

FAN_IN = 16  # answers that one request of the next level holds; an answer is at most MAX_ANSWER_TOKENS long
Ask = Callable[[DataFrame], DataFrame]  # requests with a body -> the same rows with an answer


def asked_once(make_model: Callable[[], Model]) -> Ask:
    """Ask a model, and write its answers so that each request is asked once."""
    return lambda requests: materialise(infer(requests, make_model)).df


def _part_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__parts"))


def merged_answers(answers: DataFrame, keys: Sequence[str], ask: Ask, template: str = MERGE_REVIEWS, fan_in: int = FAN_IN) -> DataFrame:
    """One answer for each key, from the answers (keys, part, path, answer) of its parts.

    ``fan_in`` answers that follow each other become one request of the next level, until a key has one answer. Keys with one
    part are not asked again. Each level holds a ``fan_in``-th of the rows of the one before, so the number of levels is the
    logarithm of the greatest number of parts.
    """
    if fan_in < 2:
        raise ValueError("At least two answers must be merged at a time")
    keys = list(keys)
    settled, level = [], answers
    while True:
        counted = level.join(_part_counts(level, keys), keys)
        settled.append(counted.filter("__parts = 1").drop("__parts", "part"))
        several = materialise(counted.filter("__parts > 1").drop("__parts"))
        if not several.rows:
            return reduce(DataFrame.unionByName, settled)
        placed = positions(several.df, keys, ["part"], find_hot(several.df, keys, at_most=several.rows))
        part = F.floor((F.col("pos") - 1) / fan_in).cast("bigint")
        texts = placed.withColumn("part", part).groupBy(*keys, "part").agg(
            F.min("path").alias("path"), F.expr("listagg(concat(coalesce(answer, ''), '\n'), '') WITHIN GROUP (ORDER BY pos)").alias("__answers")
        )
        body = request_body(fill(template, {"answers": F.col("__answers")}))
        level = ask(texts.select(*keys, "part", "path", body.alias("body")))


def judged_services(texts: ServiceTexts, ask: Ask, by: Sequence[str] = BY, most_rounds: int | None = None, **wording) -> DataFrame:
    """Answers (by, part, path, answer) that settle which pods of each service are abnormal.

    A service of one part is asked once. Of one with several parts, the pods that any part's answer names are put before the
    model again, side by side and with the figures of all pods, until they fit one request. Where a round does
    not bring fewer parts, its answers stand together. A name that is no pod of the service cannot be asked about again
    and stands as answered.
    """
    by = list(by)
    keys = series_keys(by)
    pods = texts.pods()
    labels = pods.select(*keys, F.col("pod").alias("__name")).unionByName(pods.select(*keys, series_label().alias("__name"))).distinct()
    settled, shown, before, rounds = [], None, None, 0
    while True:
        answers = ask(text_requests(texts.parts(shown), by, **wording))
        parts = _part_counts(answers, by)
        if before is not None:
            parts = parts.join(before.select(*by, F.col("__parts").alias("__before")), by, "left")
        else:
            parts = parts.withColumn("__before", F.lit(None).cast("bigint"))
        stays = (F.col("__parts") == 1) | (F.col("__parts") >= F.coalesce("__before", F.col("__parts") + 1))
        parts = materialise(parts.select(*by, "__parts", stays.alias("__stays"))).df
        rounds += 1
        if most_rounds is not None and rounds >= most_rounds:
            parts = parts.withColumn("__stays", F.lit(True))
        marked = answers.join(parts.select(*by, "__stays"), by)
        settled.append(marked.filter("__stays").drop("__stays"))
        said = marked.filter(~F.col("__stays")).filter(is_flagged("answer"))
        named = materialise(said.select(*by, "part", "path", F.explode(all_tags("answer")).alias("__name"))).df
        unknown = named.join(labels, [*by, "__name"], "left_anti")
        alone = F.concat(F.lit("<result><pod1>"), "__name", F.lit("</pod1></result>")).alias("answer")
        settled.append(unknown.select(*by, "part", "path", alone))
        shown = materialise(labels.join(named, [*by, "__name"], "left_semi").select(*keys).distinct())
        if not shown.rows:
            return reduce(DataFrame.unionByName, settled)
        shown = Table(shown.df, shown.rows, shown.bytes)
        before = parts.filter("NOT __stays")
