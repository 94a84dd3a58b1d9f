"""Exact deduplication by content hash with byte comparison.

Texts are equal when they are the same after each run of white space becomes
one space.  Rows are grouped by a 128-bit hash of that normalised text *and*
by the text itself, so equal hashes of different texts stay apart; partial
aggregation leaves one row per text and map task before the shuffle, so a text
with a third of all rows costs no more than any other.  Rows find their class
again by two independent digests (128 and 256 bits), never by moving texts a
second time.

Defined results: a null text counts as empty, and all empty texts are equal;
of equal texts the smallest doc_id stays (a null doc_id only if all are null);
rows that repeat both doc_id and text count each in ``group_size`` and exactly
one of them stays; an empty table gives an empty table; other columns are
carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, packed, single_spaced


def normalised(text: Column | str) -> Column:
    return single_spaced(filled(text))


def content_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: content_hash, text_sha256, keep_id, group_size."""
    keyed = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return (keyed.groupBy(F.md5("norm").alias("content_hash"), "norm")
            .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select("content_hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))


def exact_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = (docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
            .select("id", F.md5("norm").alias("content_hash"), F.sha2("norm", 256).alias("text_sha256"))
            .groupBy("id", "content_hash", "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    joined = rows.join(content_classes(docs, id_col, text_col), ["content_hash", "text_sha256"])
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size", "text_sha256",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).select(id_col, "keep_id", "group_size",
             (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    The kept row of a class is found by (hashes, id), so copies of one text spread over all
    tasks; of rows that repeat the id as well, the one with the smallest row hash stays (the
    grouping has the join's keys and reuses its partitioning).
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id_key")
    keys = ["content_hash", "text_sha256", "id_key"]
    rows = (packed(docs).withColumn("norm", normalised(F.col(f"_row.`{text_col}`")))
            .select("_row", F.md5("norm").alias("content_hash"), F.sha2("norm", 256).alias("text_sha256"),
                    key(f"_row.`{id_col}`")))
    classes = content_classes(docs, id_col, text_col).select("content_hash", "text_sha256", key("keep_id"))
    kept = rows.join(classes, keys, "left_semi")
    return kept.groupBy(*keys).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
