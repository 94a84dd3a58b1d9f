"""Vectors as integers, packed into bytes of one length."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import map_batches
from .common import stored

SCALE = 256


class Packed(NamedTuple):
    """A stored table (id bigint, label bigint, v binary), its number of rows, components a vector, and their numpy type."""
    table: DataFrame
    n: int
    dims: int
    kind: str


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """id, label and v (each component x as floor(scale * x)) of the rows whose vector and components are not null and finite."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                     F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("v").isNotNull() & finite).withColumn(
        "v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")))


def packed_vectors(rows: DataFrame, multiple: int = 1) -> Packed:
    """The vectors of ``integer_vectors``, with zeros up to the longest and to a multiple, in the narrowest type that holds all."""
    size = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    dims = -(-(size[1] or 0) // multiple) * multiple
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= (size[2] or 0) and (size[3] or 0) <= np.iinfo(k).max)

    def make():
        def each(batch):
            vectors = batch.column(2)
            ends = vectors.offsets.to_numpy()
            flat = vectors.values.to_numpy(zero_copy_only=False)
            grid = np.zeros((batch.num_rows, dims), kind)
            lengths = np.diff(ends)
            grid[np.arange(dims)[None, :] < lengths[:, None]] = flat[ends[0]:ends[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed_column(grid)], ["id", "label", "v"])
        return each

    return Packed(stored(map_batches(rows, make, "id bigint, label bigint, v binary")), size[0], dims, kind)


def packed_column(grid: np.ndarray) -> pa.Array:
    """A row of the grid as the bytes of one value."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(grid)], pa.binary())


def grid_of(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The grid whose rows ``packed_column`` packed."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)
