"""Batch inference through a function the caller supplies, or through files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.session import materialise, storage_path

Model = Callable[[list[str]], list[str]]


def infer(requests: DataFrame, make_model: Callable[[], Model], batch_rows: int = 16, tasks: int | None = None) -> DataFrame:
    """Replace each request ``body`` by the model's ``answer``, one answer per request.

    ``make_model`` runs once per task and returns a function from request bodies to
    answers. Write the result to a table before using it more than once, or the model is
    asked again.
    """
    schema = T.StructType([f for f in requests.schema.fields if f.name != "body"] + [T.StructField("answer", T.StringType())])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                piece = batch.iloc[start:start + batch_rows]
                answers = model(piece["body"].tolist())
                if len(answers) != len(piece):
                    raise ValueError(f"The model gave {len(answers)} answers to {len(piece)} requests")
                yield piece.drop(columns="body").assign(answer=answers)

    spread = requests.repartition(tasks or requests.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(ask, schema)


def request_id(requests: DataFrame) -> Column:
    """A name for a request: what it is about, and its body."""
    return F.sha2(F.to_json(F.struct(*sorted(requests.columns)), {"ignoreNullFields": "false"}), 256)


def infer_kept(
    requests: DataFrame, make_model: Callable[[], Model], folder: str, rounds: int = 1, batch_rows: int = 16, tasks: int | None = None
) -> DataFrame:
    """Answers of all requests, kept in ``folder``: what it holds already is not asked again.

    Each request has an ``answer`` or, where the model failed on it alone, an ``error``; a later run asks those again. The
    requests are asked in ``rounds`` and stored after each, so a job that dies loses the answers of one round. Equal
    requests are asked once. Not for two runs on one folder at a time.
    """
    spark = requests.sparkSession
    named = materialise(requests.withColumn("request_id", request_id(requests))).df
    distinct = named.select("request_id", "body").dropDuplicates(["request_id"])
    schema = "request_id string, answer string, error string"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()

        def answered(bodies: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                answers = model(bodies)
                if len(answers) != len(bodies):
                    raise ValueError(f"The model gave {len(answers)} answers to {len(bodies)} requests")
                return [(a, None) for a in answers]
            except Exception as error:  # noqa: BLE001  whatever the caller's model raises belongs to its requests
                if len(bodies) == 1:
                    return [(None, f"{type(error).__name__}: {error}")]
                return [answered([body])[0] for body in bodies]

        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                piece = batch.iloc[start:start + batch_rows]
                answers = answered(piece["body"].tolist())
                yield pd.DataFrame({"request_id": piece["request_id"].tolist(), "answer": [a for a, _ in answers], "error": [e for _, e in answers]})

    for turn in range(rounds):
        due = distinct.filter(F.pmod(F.xxhash64("request_id"), F.lit(rounds)) == turn)
        due = due.join(_stored(spark, folder, schema).filter("answer IS NOT NULL"), "request_id", "left_anti")
        spread = due.repartition(tasks or spark.sparkContext.defaultParallelism)
        spread.mapInPandas(ask, schema).write.mode("append").parquet(folder)
    stored = _stored(spark, folder, schema).groupBy("request_id").agg(F.max("answer").alias("answer"), F.max("error").alias("error"))
    known = stored.select("request_id", "answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error"))
    return named.drop("body").join(known, "request_id", "left").drop("request_id")


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    path, files = storage_path(spark, folder)
    return spark.read.schema(schema).parquet(folder) if files.exists(path) else spark.createDataFrame([], schema)


def asked_and_kept(make_model: Callable[[], Model], folder: str, rounds: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A way to ask a model, for plans: answers are kept in ``folder``. A request without an answer stops the plan once the others are stored."""

    def ask(requests: DataFrame) -> DataFrame:
        answers = infer_kept(requests, make_model, folder, rounds)
        failed = answers.filter("answer IS NULL").agg(F.count(F.lit(1)).alias("n"), F.first("error").alias("error")).first()
        if failed.n:
            raise RuntimeError(f"{failed.n} requests have no answer yet, such as: {failed.error}")
        return answers.drop("error")

    return ask


def write_requests(requests: DataFrame, folder: str) -> None:
    """Requests as JSON lines, for a model that runs elsewhere."""
    requests.write.mode("overwrite").json(folder)


def read_responses(spark: SparkSession, folder: str, by: str = "service string") -> DataFrame:
    """Response bodies that were stored as JSON lines."""
    return spark.read.schema(f"{by}, part bigint, path string, body string").json(folder)
