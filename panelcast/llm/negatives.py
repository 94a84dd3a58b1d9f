"""Hard negatives by BOND: a vertical scan of blocks of rows, dimension by dimension, in each anchor's own order.

Rows are dealt to blocks of about ROWS by a hash.  A block keeps its rows by dimension, with the least and the largest
value of each.  An anchor reads the dimensions in descending order of its own magnitude and adds up partial scores; what
the unread dimensions can still add lies between two numbers that follow from the block's least and largest values.  A
row leaves the bitmap as soon as its score can lie in no wanted window, or as soon as enough others surely come before
it in each.  What is left after the last dimension is exact.

Anchors are a stated set of rows.  Each is sent once to every block; a task holds one block and lets the anchors stream
past.  It returns the best few for an anchor (or a window), and a window function ranks those of all blocks.  There are two
such scans: one among the rows of the anchor's label, for its positives, and one among all others, for the negatives.

Rows with a null label, a null vector, or null or non-finite components take no part.  A component x counts as the
integer floor(scale * x); shorter vectors count as padded with zeros.  An anchor's other rows are those with another id.  A
row without id is no anchor and comes last in ties.  Repeated rows count each by itself, as anchors too.  Scores must fit
into a long.  Further columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import SCALE, grid_of, integer_vectors, packed_vectors

ROWS = 4096
#: Dimensions read between two looks at the bitmap.
STEP = 8
#: Anchors whose results travel together.
ANCHORS = 512

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


class Block:
    """Rows by dimension, in the order that settles ties: by id, rows without one last."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, no_id))
        self.ids, self.no_id, self.labels = ids[order], no_id[order], labels[order]
        self.columns = np.ascontiguousarray(vectors[order].T.astype(np.int64))
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, q: np.ndarray, rows: np.ndarray, may_stay: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The rows that ``may_stay(partial scores, least rest, most rest)`` leaves to the end, and their scores."""
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * self.least, q * self.most])[:, order]
        rest = np.cumsum(np.sort(ends, axis=0)[:, ::-1], axis=1)[:, ::-1]
        scores = np.zeros(len(rows), np.int64)
        for k, d in enumerate(order.tolist()):
            if k and k % STEP == 0:
                stay = may_stay(scores, rest[0, k], rest[1, k])
                if not stay.all():
                    rows, scores = rows[stay], scores[stay]
            if not len(rows):
                break
            scores += q[d] * self.columns[d][rows]
        return rows, scores

    def positives(self, q: np.ndarray, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k rows of the label with another id than ``own``."""
        def may_stay(scores, least, most):
            if len(scores) <= k:
                return np.ones(len(scores), bool)
            return scores + most >= np.partition(scores, -k)[-k] + least
        rows, scores = self.scan(q, np.flatnonzero((self.labels == label) & (self.no_id | (self.ids != own))), may_stay)
        first = np.lexsort((rows, -scores))[:k]
        return rows[first], scores[first]

    def negatives(self, q: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (both ends belong to it) its first k rows with other labels."""
        def may_stay(scores, least, most):
            stay = np.zeros(len(scores), bool)
            for low, high in windows:
                sure = scores[(scores + least >= low) & (scores + most <= high)]
                if len(sure) >= k:
                    low = max(low, np.partition(sure, -k)[-k] + least)
                stay |= (scores + most >= low) & (scores + least <= high)
            return stay
        rows, scores = self.scan(q, np.flatnonzero(self.labels != label), may_stay)
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            first = inside[np.lexsort((rows[inside], -scores[inside]))[:k]]
            out.append((rows[first], scores[first]))
        return out


def _past_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, dims: int, kind: str, answer: Callable, schema: str) -> DataFrame:
    """Sends every anchor past every block: ``answer(block, anchor as dict, its vector)`` gives tuples of ``schema``."""
    extra = [c for c in anchors.columns if c not in rows.columns]
    blank = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    place = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    both = rows.select(place.alias("block"), F.lit(False).alias("anchor"), *rows.columns, *blank).unionByName(anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("anchor"), *rows.columns, *extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        at, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            number, is_anchor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((number[1:] != number[:-1]) | (is_anchor[1:] != is_anchor[:-1])) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows]):
                run_rows = batch.slice(a, b - a)
                if number[a] != at:
                    at, parts, block = number[a], [], None
                if not is_anchor[a]:
                    parts.append(run_rows)
                    continue
                if not parts:
                    continue  # a block that got no rows
                if block is None:
                    table = pa.Table.from_batches(parts).combine_chunks()
                    ids = table.column("id").combine_chunks()
                    block = Block(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                                  table.column("label").to_numpy(), grid_of(table.column("v").combine_chunks(), kind, dims))
                for c in range(0, run_rows.num_rows, ANCHORS):
                    some = run_rows.slice(c, ANCHORS)
                    vectors = grid_of(some.column(some.schema.names.index("v")), kind, dims).astype(np.int64)
                    found = [x for row, q in zip(some.drop_columns(["v"]).to_pylist(), vectors) for x in answer(block, row, q)]
                    arrow = arrow or pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=arrow) if found else (
                        pa.RecordBatch.from_pylist([], schema=arrow))

    # The work is in the comparisons, not in the bytes: as many partitions as keep most blocks apart.
    return both.repartition(min(4 * blocks, 10_000), "block").sortWithinPartitions("block", "anchor", "uid").mapInArrow(run, schema)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
                   is_anchor: Callable[[Column], Column] = lambda i: i % 50 == 0, n_positives: int = 5, n_negatives: int = 3,
                   low: int = 50, high: int = 95, scale: int = SCALE, rows: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products with the anchor; higher ones come first, ties by smaller id.  Positives are an anchor's first
    ``n_positives`` other rows of its label (all, if fewer); for each, the first ``n_negatives`` rows of other labels with
    ``low`` to ``high`` percent of the positive's score.  ``is_anchor`` names the anchors by their id; a block has about
    ``rows`` rows.
    """
    label = F.col("label") if label is None else label
    vectors = packed_vectors(integer_vectors(df, id_col, vector_col, label, scale).where(F.col("label").isNotNull()))
    if not vectors.n:
        return df.sparkSession.createDataFrame([], RESULT)
    blocks = -(-vectors.n // rows)
    table = vectors.table.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "label", "v")
    anchors = table.where(is_anchor(F.col("id")))

    def find_positives(block: Block, row: dict, q: np.ndarray):
        at, scores = block.positives(q, row["id"], row["label"], n_positives)
        for i, s in zip(at.tolist(), scores.tolist()):
            yield row["uid"], None if block.no_id[i] else int(block.ids[i]), s

    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("other").asc_nulls_last())
    near = _past_blocks(table, anchors, blocks, vectors.dims, vectors.kind, find_positives, "uid bigint, other bigint, score bigint")
    near = near.withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= n_positives)
    near = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("slot", "other", "score"))).alias("positives"))

    def find_negatives(block: Block, row: dict, q: np.ndarray):
        window = lambda s: (-(-low * s // 100), high * s // 100)
        scores = sorted({p["score"] for p in row["positives"]})
        scores = [s for s in scores if window(s)[0] <= window(s)[1]]
        found = dict(zip(scores, block.negatives(q, row["label"], [window(s) for s in scores], n_negatives))) if scores else {}
        for p in row["positives"]:
            for i, s in zip(*(x.tolist() for x in found.get(p["score"], ()))):
                yield row["uid"], p["slot"], row["id"], p["other"], p["score"], None if block.no_id[i] else int(block.ids[i]), s

    found = _past_blocks(table, anchors.join(near, "uid"), blocks, vectors.dims, vectors.kind, find_negatives,
                         "uid bigint, slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint, "
                         "negative_id bigint, negative_score bigint")
    best = Window.partitionBy("uid", "slot").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
