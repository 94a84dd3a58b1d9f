"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: One white-space byte, as every operator of this package understands it (regular-expression class).
SPACE = r"[\x20\x09-\x0D]"

#: A table of at most this many narrow rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Values of an array that are summed up one by one.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column | str) -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def single_spaced(text: Column) -> Column:
    """Each run of white space as one space.  Only runs that are not one space already are rewritten."""
    return F.regexp_replace(text, SPACE + r"{2,}|[\x09-\x0D]", " ")


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The table written as Parquet to the shared checkpoint folder and read again, in files of their own for values of ``by``.

    Cuts the lineage like a checkpoint, takes less room, and readers fetch only the columns they use.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space (null: 0)."""
    flat = F.trim(single_spaced(filled(text)))
    return let(flat, lambda t: F.when(t == "", F.lit(0)).otherwise(
        F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("bigint"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(df: DataFrame, name: str = "_row") -> DataFrame:
    """The whole row as one struct column, so that working columns cannot clash with any of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the (materialised) table has at most ``rows`` rows, else the table as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_sums(values: Column) -> Column:
    """Sum of all earlier values, for each value of an array<bigint>; in slices, so that it stays near linear."""
    zero = F.lit(0).cast("bigint")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(SLICE))).otherwise(F.array().cast("array<int>"))
    return let(values, lambda v: let(F.transform(starts, lambda s: F.slice(v, s, F.lit(SLICE))), lambda parts: let(
        F.transform(parts, total), lambda totals: F.flatten(F.transform(parts, lambda p, k: let(
            total(F.slice(totals, F.lit(1), k)), lambda base: F.transform(
                p, lambda _, i: base + total(F.slice(p, F.lit(1), i)))))))))
