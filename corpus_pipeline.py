"""The corpus pipeline: from raw documents to token ids.

Stages, in order: quality classifier, MinHash near-dedup, benchmark decontamination, secret
scan, SentencePiece encoding. Each takes (spark, docs, sf_dir), works on all documents that the
stage before kept, and returns a DataFrame; all but the last return the columns of ``docs``.
``run`` writes each stage's result as Parquet in the shared scratch folder and reads it again.

What the stages decide: documents scored below the quality threshold go; of each group of near
duplicates the document with the least id stays (a null id is kept); documents that contain a
benchmark item go; secrets are blanked out with ``[secret]``; the last stage returns doc_id,
the ids, and how many there are.

Null and empty texts have no words: the quality stage scores them like any other, and later stages keep them.
Ids may be null or repeated, columns beside ``doc_id`` and ``text`` may have any names, and an empty
table gives an empty table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.llm import decontamination, minhash_dedup, quality, secret_scan, sentencepiece_codec
from fleetwatch.session import materialise

MASK = "[secret]"


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (as one column ``row``, so that no name of theirs clashes) with a number each (``nr``), written so that
    it stays; and number and text as a table of documents.

    Ids may be null or repeated with other texts, so what is found is joined back by the number.
    """
    rows = materialise(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("nr"))).df
    return rows, rows.select(F.col("nr").alias("doc_id"), "row.text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the threshold. Labels of all documents are used to fit it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    return docs.filter(quality.score_column("text", model) >= quality.GOOD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8 or more)."""
    rows, texts = _numbered(docs)
    without = rows.filter("row.doc_id IS NULL")
    found = minhash_dedup.near_duplicates(texts.join(without.select(F.col("nr").alias("doc_id")), "doc_id", "left_anti"))
    groups = found.select(F.col("doc_id").alias("nr"), "component_id", (F.col("n_shingles") > 0).alias("linked"))
    named = rows.select("nr", "row.doc_id").join(groups, "nr")
    first = F.min(F.struct("doc_id", "nr"))["nr"].alias("nr")
    # texts without words are linked with nothing; of their repeated rows one stays
    kept = named.filter("linked").groupBy("component_id").agg(first).select("nr")
    kept = kept.unionByName(named.filter("NOT linked").groupBy("doc_id").agg(first).select("nr"))
    return rows.join(kept.unionByName(without.select("nr")), "nr", "left_semi").select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, texts = _numbered(docs)
    found = materialise(decontamination.leaks(texts, benchmark).select(F.col("doc_id").alias("nr")).distinct()).df
    return rows.join(found, "nr", "left_anti").select("row.*")


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with ``MASK`` for each span. Spans ascend; of overlapping ones the part already passed is not written again."""

    def mask(text, found):
        out, at = [], 0
        for span in found:
            if span["start"] >= at:
                out += [text[at:span["start"]], MASK]
            at = max(at, span["end"])
        return "".join([*out, text[at:]])

    return pd.Series([mask(t, f) for t, f in zip(texts, spans)], dtype=object)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[secret]`` in place of each secret found; n_chars follows the text. Null texts stay null."""
    rows, texts = _numbered(docs)
    found = secret_scan.find_secrets(texts).filter(F.size("spans") > 0)
    bounds = F.transform("spans", lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end")))
    spans = materialise(found.select(F.col("doc_id").alias("nr"), bounds.alias("spans"))).df
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(_masked(F.coalesce("row.text", F.lit("")), F.coalesce("spans", F.array())))
    both = rows.join(spans, "nr", "left").select("row", F.col("spans").isNotNull().alias("masked"), text.alias("text"))
    chars = F.when(F.col("masked"), F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    made = {"text": F.col("text"), "n_chars": chars}
    return both.select(*[
        (made[c].cast(docs.schema[c].dataType) if c in made else F.col(f"row.`{c}`")).alias(c) for c in docs.columns
    ])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of all documents."""
    made = sentencepiece_codec.encode(docs, sentencepiece_codec.model_bytes())
    return made.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

#: The quality, near-duplicate, retrieval and tokenizer stages are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir)).df
    return docs
