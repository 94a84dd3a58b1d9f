"""Mixing sources to target weights.

Every row gets a hash-random key; rows are range-partitioned by key inside
their source (the key is uniform, so equal key ranges are equal shares and the
largest source spreads over as many buckets as it needs), running word sums
inside the buckets plus the buckets' own running sums place every row, and the
row at which a source's budget ends is found.  What travels is a narrow table
(source, key, size); the texts are never shuffled: each row decides by itself,
against one row per source, how many of its words the mix takes.

Defined results: a null text has size 0; null is a source of its own, the last
in order; sources without words get the target 0; rows with one key (repeated
ids of one size) share the words at a cut equally, rounded down; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE, packed, small_enough, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
BUCKET_ROWS = 4096


def mix_key(doc_id: Column, seed: int) -> Column:
    """32 hexadecimal digits, uniform over rows and the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, n_rows, weight, target.

    The targets share ``share`` of all words by weight, none above ``max_epochs`` times
    its source.  Resharing the excess until none is above ends at target = min(cap, level * weight),
    where level is the largest of (total - caps before) / (weights from here on), in the order of cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    # One row per source from here on: these windows see as many rows as there are sources.
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    per = (per.withColumn("weight", F.element_at(wheel, (order % len(weights) + 1).cast("int")))
           .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
           .withColumn("reach", F.col("cap") / F.col("weight")))
    everything = Window.partitionBy()
    upward = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before, here_on = (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)
    left = (F.lit(float(share)) * F.sum("source_size").over(everything)
            - F.coalesce(F.sum("cap").over(upward.rowsBetween(*before)), F.lit(0.0)))
    per = per.withColumn("level", left / F.sum("weight").over(upward.rowsBetween(*here_on)))
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", "n_rows", "weight",
                      F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def source_cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target, epochs, and the cut (cut_key, cut_size, cut_words).

    ``sizes`` has source, key, size.  A source's budget is floor(target): ``epochs`` whole passes, then
    the rows in key order up to the cut, whose rows give ``cut_words`` words each.
    """
    budget = F.floor("target")
    plan = targets.select(
        "source", "source_size", "target", "n_rows",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("epochs"))
    plan = plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("buckets", F.ceil(F.col("n_rows") / BUCKET_ROWS))

    side = plan.select(F.col("source").alias("of"), "buckets", "rest")
    rows = sizes.join(small_enough(side), sizes["source"].eqNullSafe(side["of"])).drop("of")
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("bucket", F.floor(at * F.col("buckets")))
    bucket_sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket_sums = bucket_sums.select(
        F.col("source").alias("of"), F.col("bucket").alias("at"),
        F.coalesce(F.sum("bucket_size").over(by_bucket), F.lit(0)).alias("bucket_start"))
    ties = rows.groupBy("source", "bucket", "key", "size", "rest").agg(F.count(F.lit(1)).alias("ties"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("ties")).over(inside), F.lit(0)))
    placed = ties.join(bucket_sums, ties["source"].eqNullSafe(bucket_sums["of"]) & (ties["bucket"] == bucket_sums["at"]))
    start = F.col("bucket_start") + F.col("inside")
    cut = (placed.withColumn("start", start)
           .where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size") * F.col("ties")))
           .select(F.col("source").alias("of"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"),
                   F.floor((F.col("rest") - F.col("start")) / F.col("ties")).alias("cut_words")))
    return plan.join(cut, plan["source"].eqNullSafe(cut["of"]), "left").select(
        "source", "source_size", "target", "epochs", "cut_key", "cut_size", "cut_words")


def _taken(key: Column, size: Column) -> Column:
    """Words beyond the whole epochs."""
    below = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (size < F.col("cut_size")))
    at = (key == F.col("cut_key")) & (size == F.col("cut_size"))
    return F.when(below, size).when(at, F.col("cut_words")).otherwise(F.lit(0)).cast("bigint")


def _plan(sizes: DataFrame, weights, share, max_epochs) -> DataFrame:
    targets = cut_lineage(source_targets(sizes, weights, share, max_epochs))
    return cut_lineage(source_cuts(sizes, targets))


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = 7,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words, repeats counted)."""
    sizes = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
        .withColumn("key", mix_key(F.col("id"), seed)))
    cuts = _plan(sizes, weights, share, max_epochs).withColumnRenamed("source", "of")
    out = sizes.join(small_enough(cuts), sizes["source"].eqNullSafe(cuts["of"]))
    return out.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + _taken(F.col("key"), F.col("size"))).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space included."""
    pieces = F.split(text, rf"(?<=[^\x20\x09-\x0D])(?={SPACE})")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row for each time a document is taken, with all its columns.

    A document at a cut is shortened to the words that fit (``n_chars``, where there is one, follows).
    Documents without words stay out.
    """
    base = packed(docs)
    col = lambda c: F.col(f"_row.`{c}`")
    rows = base.select("_row", col(id_col).alias("id"), col(source_col).alias("source"),
                       word_count(col(text_col)).alias("size")).withColumn("key", mix_key(F.col("id"), seed))
    sizes = cut_lineage(rows.select("source", "key", "size"))
    cuts = _plan(sizes, weights, share, max_epochs).withColumnRenamed("source", "of")
    out = rows.join(small_enough(cuts), rows["source"].eqNullSafe(cuts["of"]))
    out = out.withColumn("last", _taken(F.col("key"), F.col("size")))
    whole = F.array_repeat(F.col("size"), F.col("epochs").cast("int"))
    last = F.when(F.col("last") > 0, F.array(F.col("last"))).otherwise(F.array().cast("array<bigint>"))
    out = out.where(F.col("size") > 0).withColumn("words", F.explode(F.concat(whole, last)))
    text = F.when(F.col("words") < F.col("size"), first_words(col(text_col), F.col("words"))).otherwise(col(text_col))
    out = out.withColumn("mixed", text)
    new = {text_col: F.col("mixed")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("words") < F.col("size"), F.length("mixed").cast(docs.schema["n_chars"].dataType)) \
            .otherwise(col("n_chars"))
    return out.select(*[new.get(c, col(c)).alias(c) for c in docs.columns])
