"""Vector codes: vectors cut into parts, each part as the index of the nearest entry of its position's codebook.

Codebooks are improved by rounds of assignment and averaging, in integers throughout.  Between rounds each part keeps its
nearest b entries: the assigned one, ordered lower bounds on the distances to the others, and one outer bound on the
distance to every entry not kept (Drake and Hamerly).  When entries move, bounds shrink by the distance moved.  A part whose
distance to its entry (computed anew, exactly) lies below all its bounds keeps it.  Otherwise the kept entries are compared
in integers, and only where the outer bound lies too low all entries are.  Bounds are rounded down, and what is too close to
tell counts as uncertain, so the result is that of comparing every part with every entry, ties to the lower index.  After
each round b shrinks to what the round's uncertain parts reached, but not below LEAST_KEPT.

The state (packed vector, kept entries, bounds) is a table written in the checkpoint folder each round.  A task adds up the
parts of each entry, Spark adds the tasks' sums, and the driver gets the sums and counts: one number for each component of
the codebooks, whatever the number of rows.

Rows whose vector is null or holds null or non-finite components are dropped.  Shorter vectors count as padded with zeros, to
a multiple of the number of parts.  The first codebooks come from the smallest ids (rows without id last, ties by the
vector); with fewer rows than entries there are as many entries as rows.  Repeated rows count each by itself.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import map_batches
from .common import stored
from .vectors import SCALE, Packed, grid_of, integer_vectors, packed_column, packed_vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries kept for each part at first, and at least.
KEPT, LEAST_KEPT = 8, 2
#: A label is common with more than one in HOT_LABELS of all rows, so there are fewer common labels than that.
HOT_LABELS = 1000


class Codebooks(NamedTuple):
    entries: np.ndarray  # part x entry x position, int64
    moved: np.ndarray    # part x entry: distance from the entry before, rounded up

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def squares(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, in integers."""
    return ((parts - entries) ** 2).sum(axis=-1)


def down(bound: np.ndarray) -> np.ndarray:
    """Bounds as float32, rounded down."""
    return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


def _sorted_first(near: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of each row by distance, then index."""
    order = np.lexsort((near, distance), axis=-1)
    return np.take_along_axis(near, order, -1), np.take_along_axis(distance, order, -1)


def nearest(parts: np.ndarray, entries: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``kept`` nearest entries of each part, and their bounds: the outer one first, then one for each but the nearest."""
    distance = squares(parts[:, None, :], entries[None])
    order = np.argsort(distance, axis=1, kind="stable")
    root = np.sqrt(np.take_along_axis(distance, order[:, :kept + 1], 1).astype(np.float64))
    outer = root[:, kept] if len(entries) > kept else np.full(len(parts), np.inf)
    return order[:, :kept], down(np.column_stack([outer, root[:, 1:kept]]))


def carried(parts: np.ndarray, near: np.ndarray, bounds: np.ndarray, entries: np.ndarray, moved: np.ndarray, kept: int):
    """Kept entries and bounds after the codebook moved; how many were needed, and how many parts met all entries."""
    bounds = bounds - np.column_stack([np.full(len(parts), moved.max(initial=0.0)), moved[near[:, 1:]]])
    if near.shape[1] > kept:  # entries no longer kept fall under the outer bound
        bounds = np.column_stack([np.minimum(bounds[:, 0], bounds[:, kept:].min(axis=1)), bounds[:, 1:kept]])
        near = near[:, :kept].copy()
    close = lambda d: np.sqrt(d.astype(np.float64)) * (1 + 1e-9) + 1e-6
    reach = close(squares(parts, entries[near[:, 0]]))
    under = bounds <= reach[:, None]
    open_rows = np.flatnonzero(under.any(axis=1))
    bounds, depth = down(bounds), 1
    if not len(open_rows):
        return near, bounds, depth, 0
    depth = int((np.arange(near.shape[1]) * under[open_rows]).max()) + 1
    some, distance = _sorted_first(near[open_rows], squares(parts[open_rows][:, None, :], entries[near[open_rows]]))
    near[open_rows] = some
    bounds[open_rows, 1:] = down(np.sqrt(distance[:, 1:].astype(np.float64)))
    rest = open_rows[bounds[open_rows, 0] <= close(distance[:, 0])]
    if len(rest):
        near[rest], bounds[rest] = nearest(parts[rest], entries, near.shape[1])
    return near, bounds, depth, len(rest)


def _assigned(state: DataFrame, packed: Packed, parts: int, shared, kept: int, before: int) -> DataFrame:
    """The state after a round that keeps ``kept`` entries; ``before`` are kept in ``state`` (0: it has none yet)."""
    shape, kind, dims = (parts, packed.dims // parts), packed.kind, packed.dims

    def make():
        books: Codebooks = shared.value

        def each(batch):
            names, n = batch.schema.names, batch.num_rows
            grid = grid_of(batch.column(names.index("v")), kind, dims).astype(np.int64).reshape(n, *shape)
            near, bounds = np.zeros((n, parts, kept), np.uint8), np.zeros((n, parts, kept), np.float32)
            depth, full = 1, 0
            if before:
                old = grid_of(batch.column(names.index("near")), "u1", parts * before).reshape(n, parts, before)
                low = grid_of(batch.column(names.index("bounds")), "<f4", parts * before).reshape(n, parts, before)
            for p in range(parts):
                if before:
                    near[:, p], bounds[:, p], deep, met = carried(
                        grid[:, p], old[:, p].copy(), low[:, p].astype(np.float64), books.entries[p], books.moved[p], kept)
                    depth, full = max(depth, deep), full + met
                else:
                    near[:, p], bounds[:, p] = nearest(grid[:, p], books.entries[p], kept)
            error = squares(grid, books.entries[np.arange(parts), near[:, :, 0]]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in ("id", "label", "v")), packed_column(near.reshape(n, -1)),
                 packed_column(bounds.reshape(n, -1)), packed_column(near[:, :, 0]), pa.array(error, pa.int64()),
                 pa.array([depth] * n, pa.int64()), pa.array([full] * n, pa.int64())],
                ["id", "label", "v", "near", "bounds", "code", "error", "depth", "full"])
        return each

    return map_batches(state, make, "id bigint, label bigint, v binary, near binary, bounds binary, code binary, "
                                    "error bigint, depth bigint, full bigint")


def _moved(state: DataFrame, packed: Packed, parts: int, books: Codebooks) -> Codebooks:
    """The codebooks whose entries are the averages, rounded down, of their parts; unused entries stay."""
    (k, width), kind, dims = books.entries.shape[1:], packed.kind, packed.dims

    def run(batches):
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            grid = grid_of(batch.column(0), kind, dims).astype(np.int64).reshape(batch.num_rows, parts, width)
            code = grid_of(batch.column(1), "u1", parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], grid[:, p])
                count[p] += np.bincount(code[:, p], minlength=k)
        place, entry = (x.reshape(-1) for x in np.indices((parts, k)))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(entry), pa.array(count.reshape(-1)),
                                          pa.array(total.reshape(parts * k, width).tolist(), pa.list_(pa.int64()))],
                                         ["part", "entry", "n", "total"])

    sums = state.select("v", "code").mapInArrow(run, "part bigint, entry bigint, n bigint, total array<bigint>")
    wide = "decimal(38,0)"
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("total")[j].cast(wide)) for j in range(width)]).cast(f"array<{wide}>").alias("total"))
    entries = books.entries.copy()
    for r in sums.where(F.col("n") > 0).collect():  # parts x entries rows at most
        entries[r["part"], r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    far = np.sqrt(squares(entries, books.entries).astype(np.float64)) * (1 + 1e-9)
    return Codebooks(entries, np.nextafter(far, np.inf))


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, kept: int = KEPT) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error) of each row and the final codebooks; ``code`` has one byte for each part, ``entries`` at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has to fit into a byte")
    packed = packed_vectors(integer_vectors(df, id_col, vector_col, F.col(f"`{label_col}`"), scale), parts)
    first = packed.table.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = packed.dims // parts
    start = np.array([np.frombuffer(r["v"], packed.kind) for r in first], np.int64).reshape(len(first), parts, width)
    books = Codebooks(start.transpose(1, 0, 2), np.zeros((parts, len(first))))
    state, before, kept = packed.table, 0, min(kept, max(1, len(first)))
    context = df.sparkSession.sparkContext
    for _ in range(rounds if packed.n else 0):
        state = stored(_assigned(state, packed, parts, context.broadcast(books), kept, before))
        books = _moved(state, packed, parts, books)
        if before:
            deepest = state.agg(F.max("depth")).first()[0]
            before, kept = kept, min(kept, max(LEAST_KEPT, deepest))
        else:
            before = kept
    return _assigned(state, packed, parts, context.broadcast(books), kept, before).select("id", "label", "code", "error"), books


def vector_code_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (hex), error, label_error (error over equal labels, nulls together) and codebooks_sha256."""
    codes, books = vector_codes(df, id_col, vector_col, label_col)
    codes = stored(codes.withColumn("code", F.lower(F.hex("code"))))
    by_label = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    total = codes.count()
    common = by_label.where(F.col("n") * HOT_LABELS > total).select("label", F.col("label_error").alias("common_error"))
    # Common labels are few by definition and go to the rows; the rows of the others meet their sums in a shuffle.
    out = codes.alias("c").join(F.broadcast(common).alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")), "left").select(
        "c.*", "common_error")
    rare = by_label.where(F.col("n") * HOT_LABELS <= total).select("label", "label_error")
    known = out.where(F.col("common_error").isNotNull()).select("id", "code", "error", F.col("common_error").alias("label_error"))
    others = out.where(F.col("common_error").isNull()).drop("common_error").alias("o")
    others = others.join(rare.alias("r"), F.col("o.label").eqNullSafe(F.col("r.label"))).select("id", "code", "error", "label_error")
    return known.unionByName(others).select(F.col("id").alias(id_col), "code", "error", "label_error",
                                            F.lit(books.digest()).alias("codebooks_sha256"))
