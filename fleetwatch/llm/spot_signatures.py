"""SpotSigs document fingerprints, with built-in functions only.

Anchors are the ``ANCHORS`` most frequent words of the whole corpus; the ``COMMON`` most frequent
are skipped. A spot is an anchor followed by a chain of the next ``CHAIN`` words that are not
common, among the ``REACH`` words behind it. The fingerprint is the set of spots (32-bit hashes,
ascending, in hex): style and menus have few of them, running prose has many. A text without any
spot is fingerprinted by its whole text, so only equal ones are alike.

Fingerprints are compared by Jaccard similarity. Since it is at most the ratio of the set
sizes, ``similar_fingerprints`` partitions sets by length, meets only neighbouring partitions,
and reads only the rarest spots that a partner must share.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.session import materialise

ANCHORS, COMMON, CHAIN, REACH = 16, 100, 2, 8
ID_RANGE = 1024  # ids whose documents meet in one window partition
SMALL = 100_000  # rows that may be broadcast or sorted in one task


def words_of(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")


def common_words(docs: DataFrame) -> list[str]:
    """The ``COMMON`` most frequent words of all texts, the most frequent first: a bounded list."""
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(COMMON)
    return [r["word"] for r in top.collect()]


def spots(text: Column, common: list[str]) -> Column:
    """Ascending distinct 32-bit hashes of a text's spots."""
    whole = F.array(F.xxhash64(F.lit("whole"), text).bitwiseAND(F.lit(0xFFFFFFFF)))
    if not common:
        return whole

    def at(words: Column) -> Column:
        def spot(i: Column) -> Column:
            near = F.filter(F.slice(words, i + 2, REACH), lambda w: ~w.isin(common))
            chain = F.slice(near, 1, CHAIN)
            named = F.xxhash64(words[i], F.array_join(chain, " ")).bitwiseAND(F.lit(0xFFFFFFFF))
            return F.when(F.size(chain) == CHAIN, named)

        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: words[i].isin(common[:ANCHORS]))
        found = F.array_sort(F.array_distinct(F.array_compact(F.transform(places, spot))))
        return F.when(F.size(words) > 0, found)

    found = F.element_at(F.transform(F.array(words_of(text)), at), 1)  # words are split once
    return F.when(F.size(found) > 0, found).otherwise(whole)


def fingerprint(found: str | Column) -> Column:
    return F.array_join(F.transform(found, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(one: str, two: str) -> Column:
    """Jaccard similarity of two sets of spots."""
    both = F.size(F.array_intersect(one, two))
    return both / (F.size(one) + F.size(two) - both)


def with_spots(df: DataFrame, text: str, name: str, common: list[str]) -> DataFrame:
    # explode keeps the costly expression from being computed once for each use
    return df.select("*", F.explode(F.array(spots(F.col(text), common))).alias(name))


def following(ids: DataFrame) -> DataFrame:
    """Columns id, next: the next greater id (null for the last). Ranges of ids, then ranges of ranges."""
    table = materialise(ids.distinct())
    if table.rows <= SMALL:
        return table.df.select("id", F.lead("id").over(Window.orderBy("id")).alias("next"))
    ranged = table.df.withColumn("range", F.floor(F.col("id") / ID_RANGE).cast("bigint"))
    heads = ranged.groupBy("range").agg(F.min("id").alias("head"))
    after = following(heads.select(F.col("range").alias("id")))
    firsts = heads.select(F.col("range").alias("next"), "head")
    known = after.join(firsts, "next").select(F.col("id").alias("range"), "head")
    inner = ranged.withColumn("lead", F.lead("id").over(Window.partitionBy("range").orderBy("id")))
    return inner.join(known, "range", "left").select("id", F.coalesce("lead", "head").alias("next"))


def with_next_document(docs: DataFrame, carried: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each row with the ``carried`` columns of the next document in ascending doc_id (after the last: the first) as next_*.

    Texts are shuffled once, by range of ids; the first document of a range also visits the range before. ``made`` adds costly
    columns, once to each row and visitor; finding the order does without them.
    """
    ranged = docs.withColumn("range", F.floor(F.col("doc_id") / ID_RANGE).cast("bigint"))
    heads = docs.select("doc_id").groupBy(F.floor(F.col("doc_id") / ID_RANGE).cast("bigint").alias("id")).agg(F.min("doc_id").alias("head"))
    heads = materialise(heads)
    order = following(heads.df.select("id")).select("id", "next")
    least = heads.df.agg(F.min("id")).first()[0]
    visits = order.select(F.coalesce("next", F.lit(least)).alias("of"), F.col("id").alias("visited"))
    visits = materialise(visits.join(heads.df.withColumnRenamed("id", "of"), "of").select(F.col("head").alias("doc_id"), "visited"))
    small = F.broadcast(visits.df) if visits.rows <= SMALL else visits.df
    guests = ranged.join(small, "doc_id").withColumn("range", F.col("visited")).drop("visited")
    both = made(ranged.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))))
    in_order = Window.partitionBy("range").orderBy("guest", "doc_id", "text")
    return both.select("*", *[F.lead(c).over(in_order).alias(f"next_{c}") for c in carried]).filter("NOT guest").drop("guest", "range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Columns doc_id, text, n_chars, edited, found, edited_found, next_found (sets of spots).

    The edited text has its last quarter of code points replaced by the beginning of the next
    document. A null text is empty. Rows of one id follow in the order of their texts. A row
    without id has no next document: its edited text only loses its end, and next_found is null.
    Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    common = common_words(texts)

    def found(df: DataFrame) -> DataFrame:
        return with_spots(df, "text", "found", common)

    known = with_next_document(texts.filter(F.col("doc_id").isNotNull()), ["text", "found"], found)
    nameless = found(texts.filter(F.col("doc_id").isNull())).select("*", F.lit("").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_found"))
    both = known.unionByName(nameless).withColumn("n_chars", F.length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut)
    edited = both.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), cut))).drop("next_text")
    return with_spots(edited, "edited", "edited_found", common)


def similar_fingerprints(found: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs a < b of different sets with their likeness, if at least ``threshold``, from columns doc_id and found.

    Documents with equal sets are one, named by the least id. Sets are dealt out by length: with
    part = floor(log(size) / log(1 / threshold)), partners lie in the same or the next part.
    """
    sets = materialise(found.groupBy("found").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("found"))).df
    rows = sets.select("id", "n", F.explode("found").alias("spot"))
    counts = rows.groupBy("spot").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "spot"))
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold)).cast("int")
    needed = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    rare = rows.join(counts.filter("df > 1"), "spot").withColumn("nth", rank).filter(F.col("nth") <= needed).select("spot", "id", "n", part.alias("part"))
    other = rare.select("spot", F.col("id").alias("b"), F.col("n").alias("m"), F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    close = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("id") < F.col("b")))
    pairs = rare.join(other, ["spot", "part"]).filter(close & (F.col("n") >= threshold * F.col("m"))).select("id", "b").distinct()
    one = pairs.join(sets.select("id", F.col("found").alias("x")), "id")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")
    alike = two.withColumn("likeness", likeness("x", "y")).filter(F.col("likeness") >= threshold)
    return alike.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), "likeness")


def op5_spot_signatures(spark, folder: str) -> DataFrame:
    found = fingerprints(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("found").alias("fingerprint"), fingerprint("edited_found").alias("edited_fingerprint"),
        likeness("found", "edited_found").alias("near_edited"), likeness("found", "next_found").alias("near_next"),
    )
