"""Suffix-array deduplication: removes every byte covered by a 100-byte string that also starts earlier.

All suffixes of a corpus are too many to sort by shuffling them, and most are not needed: of the SPAN byte windows of a
text, each is filed under one of its K-byte substrings, the one with the smallest hash (the leftmost of equals).  Equal windows
are filed under the same substring at the same place, so only windows under a substring that occurs more than once
can repeat.  Neighbouring windows mostly share their substring ("anchor"), which leaves between 2 and 3 anchors per 100 bytes.

1. Every text gives its anchors (hash, place, range of windows); anchors whose hash occurs once are dropped.
2. The others meet their texts again and take the bytes of their windows along.  Equal byte ranges inside a task are
   settled at once: only the earliest travels on.  Windows of very frequent anchors travel one by one under a hash of
   their own bytes, so a passage that many documents share spreads over tasks and is settled mostly before the shuffle.
3. Under each anchor the windows are grouped deep-shallow: their labels are refined by sorting (``numpy.lexsort``, not a multikey
   quicksort) on 8-byte words down to SHALLOW bytes; what still ties is told apart by blind tries, which branch at the first
   byte in which a group differs and skip what it has in common.  Of equal windows all but the earliest are repeated.
4. The repeated ranges meet their texts, and what they cover is cut out.

Texts are read as UTF-8; places are byte offsets.  Order is (id, text hash, start).

Defined results: a null text is empty; texts shorter than SPAN bytes lose nothing; rows that repeat id and text
are one document and get equal results; different texts of one id are ordered by their hash; null ids come last, by
the hash of their text; ids are integers below 2**62; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_rows import map_batches, map_whole_groups, texts_of
from .common import filled, small_enough, stored
from .shingles import BYTE, mix64, powers

SPAN, K = 100, 20
SHALLOW = 32
HOT, LOCAL = 10_000, 8
CHUNK = 1 << 20
SUFFIXES = 1 << 18
NO_ID = 1 << 62


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor of a text, with the first and last window start filed under it."""
    parts = []
    at = 0
    while len(data) - at >= SPAN:  # chunks overlap by SPAN - 1 bytes, so each window lies in one of them
        piece = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at)
        parts.append((at, *_anchors_of(piece)))
        at += len(piece) - SPAN + 1
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return (np.concatenate([p[1] for p in parts]), *(np.concatenate([p[0] + p[k] for p in parts]) for k in (2, 3, 4)))


def _anchors_of(raw: np.ndarray):
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[:len(raw)], out=sums[1:])
    n = len(raw) - K + 1
    hashes = mix64((sums[K:] - sums[:-K]) * down[:n])
    # 40 bits of hash above 24 bits of place: the minimum is the leftmost of the smallest.
    best = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    width, have = SPAN - K + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    place = (best & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    ends = np.append(starts[1:], len(place)) - 1
    place = place[starts]
    return hashes[place].view(np.int64), place, starts, ends


def hashes_at(data: bytes, places: np.ndarray) -> np.ndarray:
    """The anchor hashes of a text at these places."""
    up, _ = powers(K)
    letters = np.frombuffer(data, np.uint8)[places[:, None] + np.arange(K)]
    return mix64((BYTE[letters] * up[:K]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def equal_windows(flat: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for each suffix ``flat[at:at + SPAN]``, equal for suffixes of one group with equal bytes.

    Deep-shallow: ``group`` is refined by 8-byte characters to SHALLOW bytes, then by blind tries.
    """
    label = np.unique(group, return_inverse=True)[1].astype(np.int64)
    open_ = _shared(label, np.arange(len(at)))
    fresh = int(label.max(initial=-1)) + 1

    def refine(rows, key):
        """Splits the labels of these rows by key; rows that still share a label."""
        nonlocal fresh
        order = np.lexsort((key, label[rows]))
        rows, key = rows[order], key[order]
        old = label[rows]
        new = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))
        label[rows] = fresh + np.cumsum(new) - 1
        fresh += int(new.sum())
        return _shared(label, rows)

    def word(rows, depth):
        return flat[(at[rows] + depth)[:, None] + np.arange(8)].view(">u8")[:, 0]

    for depth in range(0, SHALLOW, 8):
        if not len(open_):
            return label
        open_ = refine(open_, word(open_, depth))
    while len(open_):
        # One level of all blind tries: compare with the group's first suffix, branch where the group first differs.
        rows = open_[np.argsort(label[open_], kind="stable")]
        starts = np.flatnonzero(np.append(True, label[rows][1:] != label[rows][:-1]))
        sizes = np.diff(np.append(starts, len(rows)))
        head = np.repeat(rows[starts], sizes)
        common = np.full(len(rows), SPAN)
        for depth in range((SPAN - SHALLOW - 1) // 8 * 8 + SHALLOW, SHALLOW - 1, -8):
            n = min(8, SPAN - depth)
            differ = flat[(at[rows] + depth)[:, None] + np.arange(n)] != flat[(at[head] + depth)[:, None] + np.arange(n)]
            some = differ.any(axis=1)
            common[some] = depth + differ[some].argmax(axis=1)
        branch = np.repeat(np.minimum.reduceat(common, starts), sizes)
        split = branch < SPAN
        open_ = rows[split]
        if len(open_):
            open_ = refine(open_, flat[at[open_] + branch[split]])
    return label


def _shared(label: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Those rows whose label another of them has too."""
    _, inverse, count = np.unique(label[rows], return_inverse=True, return_counts=True)
    return rows[count[inverse] > 1]


def repeats_of(table: pa.Table) -> list[np.ndarray]:
    """Arrays (id, tie, start, end) of the byte ranges that the windows of these whole groups repeat.

    A row has h, id, tie, lo (first window), rel (distance from there to the anchor) and bytes.
    """
    h, ids, tie, lo, rel = (table.column(c).to_numpy() for c in ("h", "id", "tie", "lo", "rel"))
    column = table.column("bytes").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)
    windows = np.diff(offsets) - SPAN + 1
    code = column.dictionary_encode().indices.to_numpy()

    # Rows with the same bytes at the same distance from the anchor: all windows of the later ones are repeated.
    order = np.lexsort((lo, tie, ids, code, rel, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (rel[order][1:] != rel[order][:-1]) | (code[order][1:] != code[order][:-1]))
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (ids[order] != ids[head]) | (tie[order] != tie[head]) | (lo[order] != lo[head])
    whole = order[later]
    out = [(ids[whole], tie[whole], lo[whole], lo[whole] + windows[whole] + SPAN - 1)]

    rows = order[new]
    rows = rows[_in_company(h[rows])]
    if len(rows):
        n = windows[rows]
        row = np.repeat(rows, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = np.unique(np.stack([h[row], rel[row] - step]), axis=1, return_inverse=True)[1].ravel()
        label = equal_windows(flat, offsets[row] + step, group)
        place = lo[row] + step
        order = np.lexsort((place, tie[row], ids[row], label))
        new = np.append(True, label[order][1:] != label[order][:-1])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = order[(ids[row[order]] != ids[row[head]]) | (tie[row[order]] != tie[row[head]]) | (place[order] != place[head])]
        later = np.sort(later)  # by row, then place: runs of neighbours become one range
        if len(later):
            cut = np.append(True, (np.diff(row[later]) != 0) | (np.diff(place[later]) != 1))
            first, last = later[cut], later[np.append(np.flatnonzero(cut)[1:] - 1, len(later) - 1)]
            out.append((ids[row[first]], tie[row[first]], place[first], place[last] + SPAN))
    return [np.concatenate(c) for c in zip(*out)]


def _in_company(sorted_keys: np.ndarray) -> np.ndarray:
    same = sorted_keys[1:] == sorted_keys[:-1]
    return np.append(same, False) | np.append(False, same)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, id, tie (rank of the text among those of one id), again (repeats id and text), text.

    The rows are partitioned by id, and whatever meets them later joins by id alone.  Every reader takes the same
    columns and the id is never null, so that one exchange of the texts serves all of them.
    """
    rows = docs.select(F.col(id_col).alias("doc"), filled(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    no_id = F.lit(NO_ID) + F.pmod("mark", F.lit(NO_ID - 1))
    rows = rows.select("doc", F.coalesce(F.col("doc").cast("bigint"), no_id, F.lit(NO_ID)).alias("id"), "text", "mark")
    same_id = Window.partitionBy("id").orderBy("mark", "text")
    return rows.select("doc", "id", (F.dense_rank().over(same_id) - 1).cast("int").alias("tie"),
                       (F.row_number().over(same_id) > F.rank().over(same_id)).alias("again"), "text")


def _anchor_rows(base: DataFrame) -> DataFrame:
    """h, id, tie and (place, place - first window, place - last window) packed into one number."""
    def make():
        def each(batch):
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out, size = [], 0

            def ready():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["h", "id", "tie", "at"])

            for k, text in enumerate(batch.column(2)):
                h, place, lo, hi = anchors(text.as_py().encode())
                if len(h):
                    out.append((h, np.full(len(h), ids[k]), np.full(len(h), ties[k], np.int32),
                                place << 16 | (place - lo) << 8 | (place - hi)))
                    size += len(h)
                if size > 200_000:
                    yield ready()
                    out, size = [], 0
            if out:
                yield ready()
        return each
    return map_batches(base.where(~F.col("again")).select("id", "tie", "text", "doc"), make, "h bigint, id bigint, tie int, at bigint")


def _frequent_anchors(docs: DataFrame, text_col: str) -> DataFrame:
    """h of anchors that occur often: counted per batch, dropped where a batch has few, summed.

    An anchor that is missed occurs fewer than LOCAL times in nearly every batch, so its rows are few for a group.
    """
    def make():
        def each(batch):
            found = [anchors(t.encode())[0] for t in texts_of(batch.column(0))]
            h, n = np.unique(np.concatenate([f.astype(np.int64) for f in found]), return_counts=True)
            some = n >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(n[some])], ["h", "n"])
        return each
    local = map_batches(docs.select(F.col(text_col).alias("text")), make, "h bigint, n bigint")
    return stored(local.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).select("h"))


def _byte_rows(found: DataFrame) -> DataFrame:
    """The bytes of the windows under repeated anchors, or (bytes null) ranges that are known to repeat.

    ``found`` has id, tie, text and the text's repeated anchors in order of place.  Of equal bytes at the same distance from one anchor
    only the first that the task meets (in order of id) travels on.
    """
    def make():
        seen: dict = {}

        def each(batch):
            if len(seen) > 400_000:
                seen.clear()
            ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for k, (text, own) in enumerate(zip(batch.column(2), batch.column(3))):
                data, own = text.as_py().encode(), own.values
                known = []
                found = own.field("at").to_numpy()
                hashes = hashes_at(data, found >> 16).tolist()
                for h, at, often in zip(hashes, found.tolist(), own.field("often").to_pylist()):
                    place = at >> 16
                    lo, hi = place - (at >> 8 & 255), place - (at & 255)
                    # (first window, last window, distance to the anchor)
                    for a, b in [(p, p) for p in range(lo, hi + 1)] if often else [(lo, hi)]:
                        piece = data[a:b + SPAN]
                        mark = hashlib.blake2b(piece, digest_size=16).digest()
                        key = int.from_bytes(mark[:8], "little", signed=True) if often else h
                        rel = 0 if often else place - a
                        before = seen.setdefault((key, rel, mark), (ids[k], ties[k], a))
                        if before < (ids[k], ties[k], a):
                            if known and known[-1][1] >= a + SPAN - 1:
                                known[-1][1] = max(known[-1][1], b + SPAN)
                            else:
                                known.append([a, b + SPAN])
                        else:
                            seen[key, rel, mark] = ids[k], ties[k], a
                            out.append((key, ids[k], ties[k], a, 0, rel, piece))
                out += [(ids[k] ^ (a << 20), ids[k], ties[k], a, b, 0, None) for a, b in known]
                if len(out) > 50_000:
                    yield ready(out)
                    out = []
            if out:
                yield ready(out)
        return each

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["h", "id", "tie", "lo", "end", "rel", "bytes"]

    def ready(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return map_batches(found, make, "h bigint, id bigint, tie int, lo bigint, end bigint, rel int, bytes binary")


def _ranges(byte_rows: DataFrame) -> DataFrame:
    """id, tie, start, end of repeated byte ranges."""
    def make():
        def ready(ids, ties, start, end):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ties, pa.int32()), pa.array(start, pa.int64()),
                                               pa.array(end, pa.int64())], ["id", "tie", "start", "end"])

        def each(table):
            known = table.filter(table.column("bytes").is_null())
            if known.num_rows:
                yield ready(*(known.column(c).to_numpy() for c in ("id", "tie", "lo", "end")))
            table = table.filter(table.column("bytes").is_valid())
            if not table.num_rows:
                return
            h = table.column("h").to_numpy()
            bounds = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
            # Whole groups together, up to about SUFFIXES windows.
            at = 0
            while at < len(bounds) - 1:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SUFFIXES // (SPAN - K), "right")) - 1)
                part = repeats_of(table.slice(int(bounds[at]), int(bounds[to] - bounds[at])).combine_chunks())
                if len(part[0]):
                    yield ready(*part)
                at = to
        return each
    return map_whole_groups(byte_rows, ["h"], make, "id bigint, tie int, start bigint, end bigint")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, spans array<struct<start, end>> (removed, maximal, in order), kept (bytes)."""
    base = _documents(docs, id_col, text_col)
    frequent = small_enough(_frequent_anchors(docs, text_col)).withColumn("often", F.lit(True))
    rows = _anchor_rows(base).join(frequent, "h", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    # Frequent anchors are known to repeat; they are counted under numbers of their own, spread over all tasks.
    rows = rows.select(F.when(F.col("often"), F.xxhash64("id", "tie", "at")).otherwise(F.col("h")).alias("counted"),
                       "id", "tie", "at", "often")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("counted"))).where("often or n > 1")
    own = rows.groupBy("id").agg(F.sort_array(F.collect_list(
        F.struct("tie", "at", "often"))).alias("anchors"))
    of_text = lambda c: F.filter(c, lambda x: x["tie"] == F.col("tie")).alias(c)
    found = base.where(~F.col("again")).join(own, "id").select("id", "tie", "text", of_text("anchors"), "doc")
    ranges = _ranges(_byte_rows(found)).groupBy("id").agg(F.collect_list(F.struct("tie", "start", "end")).alias("ranges"))
    joined = base.join(ranges, "id", "left").select("doc", "text", of_text("ranges"))

    def make():
        def each(batch):
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                sizes.append(len(data))
                merged: list[list[int]] = []
                if found.is_valid:
                    pair = found.values
                    for a, b in sorted(zip(pair.field("start").to_pylist(), pair.field("end").to_pylist())):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in merged])
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc", "n_bytes", "spans", "kept"])
        return each

    kind = joined.schema["doc"].dataType.simpleString()
    out = map_batches(joined, make, f"doc {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumnRenamed("doc", id_col)


def suffix_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = suffix_dedup(docs, id_col, text_col)
    return out.select(id_col, "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
