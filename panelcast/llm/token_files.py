"""Token ids in binary files: patched frame-of-reference blocks, written and read back by Spark tasks.

A file holds the ids of whole documents in ascending id order.  Ids are cut into blocks of BLOCK.  A block stores its
minimum, the differences to it packed at the width that a given percentile of them needs, and for the outliers their
places and the bits beyond that width.  After the blocks come an index of block starts and the table of documents.

    header     magic, version u16, block size u16, bytes of an outlier's upper bits u16
    block      minimum u32, width u8, outliers u16, packed differences, places u8 each, upper bits u16 or u32 each
    index      u64 start of each block, and the end of the last
    documents  id i64, whether the id is null u8, number of ids u64; each as one run
    trailer    blocks u64, documents u64, ids u64, place of the index u64, magic

Documents are dealt by ranges of ids that hold about as many rows each; an id (or null) with more rows than that has several.
Texts stay where they are read; only token ids are shuffled.  A task writes files under names of its own and reports them in
rows; only the files named by tasks that Spark accepted count, so a lost or repeated task leaves files that nobody reads.
Order: id, null last; rows of one id by a hash of their token ids (by their places in the table, if there are very many).
"""

from __future__ import annotations

import math
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .arrow_rows import Memo, map_batches, texts_of
from .common import stored
from .shingles import mix64

MAGIC, VERSION = b"PFOR", 1
BLOCK = 256
PERCENTILE = 90
FILE_IDS = 1 << 24
#: Ids packed or unpacked at a time.
SPAN = 1 << 17
HEADER, TRAILER, HEAD = struct.Struct("<4sHHH"), struct.Struct("<QQQQ4s"), 7
#: Widths at which packed bits are plain little-endian integers.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
POWERS = np.uint64(1) << np.arange(33, dtype=np.uint64)

MANIFEST = "path string, part bigint, seq bigint, n_docs bigint, n_ids bigint, n_bytes bigint"


# --- blocks ------------------------------------------------------------------------------------------------------------

def _pack(values: np.ndarray, w: int) -> np.ndarray:
    """The values (k x BLOCK, below 2^w) as bytes (k x BLOCK * w / 8), the lowest bit first."""
    if w in WHOLE:
        return values.astype(WHOLE[w]).view(np.uint8)
    if w > 16:
        bits = ((values[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")
    # Eight values make w bytes: four values to a word, two such words to sixteen bytes.
    four = values.astype(np.uint64).reshape(-1, 2, 4)
    words = four[:, :, 0] | four[:, :, 1] << np.uint64(w) | four[:, :, 2] << np.uint64(2 * w) | four[:, :, 3] << np.uint64(3 * w)
    both = np.stack([words[:, 0] | words[:, 1] << np.uint64(4 * w), words[:, 1] >> np.uint64(64 - 4 * w)], axis=1)
    return np.ascontiguousarray(both.astype("<u8").view(np.uint8)[:, :w]).reshape(len(values), -1)


def _unpack(body: np.ndarray, w: int) -> np.ndarray:
    """The values that ``_pack`` packed."""
    if w in WHOLE:
        return np.ascontiguousarray(body).view(WHOLE[w]).astype(np.uint32)
    if w > 16:
        bits = np.unpackbits(body, axis=1, bitorder="little").reshape(len(body), BLOCK, w)
        value = np.zeros((len(body), BLOCK), np.uint32)
        for j in range(w):
            value |= bits[:, :, j].astype(np.uint32) << np.uint32(j)
        return value
    wide = np.zeros((len(body) * BLOCK // 8, 16), np.uint8)
    wide[:, :w] = body.reshape(-1, w)
    both = wide.view("<u8")
    words = np.stack([both[:, 0], both[:, 0] >> np.uint64(4 * w) | both[:, 1] << np.uint64(64 - 4 * w)], axis=1)
    four = words[:, :, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(w)) & np.uint64((1 << w) - 1)
    return four.astype(np.uint32).reshape(len(body), BLOCK)


def pack_blocks(ids: np.ndarray, upper: int, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of ``ids`` (k x BLOCK, uint32); ``upper`` is the number of bytes of an outlier's upper bits."""
    low = ids.min(axis=1)
    rest = ids - low[:, None]
    rank = max(0, -(-BLOCK * percentile // 100) - 1)
    width = np.searchsorted(POWERS, np.partition(rest, rank, axis=1)[:, rank].astype(np.uint64), side="right")
    above = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    packed: list[bytes] = [b""] * len(ids)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for r, line in zip(rows.tolist(), _pack(rest[rows] & np.uint32((1 << w) - 1), w)):
            packed[r] = line.tobytes()
    out = []
    for k in range(len(ids)):
        places = np.flatnonzero(above[k])
        out.append(struct.pack("<IBH", int(low[k]), int(width[k]), len(places)) + packed[k]
                   + places.astype(np.uint8).tobytes() + above[k][places].astype(f"<u{upper}").tobytes())
    return out


def unpack_blocks(raw: np.ndarray, starts: np.ndarray, upper: int) -> np.ndarray:
    """The ids (k x BLOCK, uint32) of blocks that start at ``starts`` in the bytes ``raw``."""
    head = raw[starts[:, None] + np.arange(HEAD)]
    low = head[:, :4].copy().view("<u4")[:, 0]
    width = head[:, 4].astype(np.int64)
    n_out = head[:, 5:7].copy().view("<u2")[:, 0].astype(np.int64)
    ids = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        body = raw[starts[rows][:, None] + HEAD + np.arange(BLOCK * w // 8)]
        ids[rows] = _unpack(body, w)
    block = np.repeat(np.arange(len(starts)), n_out)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        after = starts + HEAD + BLOCK * width // 8
        places = raw[after[block] + nth].astype(np.int64)
        at = after[block] + n_out[block] + nth * upper
        above = raw[at[:, None] + np.arange(upper)].copy().view(f"<u{upper}")[:, 0].astype(np.uint64)
        ids[block, places] |= (above << width[block].astype(np.uint64)).astype(np.uint32)
    return ids + low[:, None]


# --- files -------------------------------------------------------------------------------------------------------------

def filesystem(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder that all executors share (a path, or a URI that Arrow can open), and its path there."""
    if folder.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return arrow_fs.FileSystem.from_uri(folder)


class FileWriter:
    """One file, written front to back: blocks as they fill, index and documents at the end."""

    def __init__(self, store: arrow_fs.FileSystem, path: str, upper: int, percentile: int = PERCENTILE):
        self.path, self.upper, self.percentile = path, upper, percentile
        self.sink = store.open_output_stream(path)
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.starts, self.docs, self.nulls, self.counts = [], [], [], []
        self.sink.write(HEADER.pack(MAGIC, VERSION, BLOCK, upper))
        self.at = HEADER.size

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc is None else doc)
        self.nulls.append(doc is None)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        for a in range(0, len(ids), SPAN):
            self.waiting.append(ids[a:a + SPAN])
            self.n_waiting += len(self.waiting[-1])
            if self.n_waiting >= SPAN:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.empty(0, np.uint32), *self.waiting])
        if last and len(ids) % BLOCK:
            ids = np.append(ids, np.full(-len(ids) % BLOCK, ids[-1], np.uint32))
        whole = len(ids) // BLOCK * BLOCK
        for block in pack_blocks(ids[:whole].reshape(-1, BLOCK), self.upper, self.percentile) if whole else []:
            self.starts.append(self.at)
            self.sink.write(block)
            self.at += len(block)
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int, int]:
        """Number of documents, ids and bytes."""
        self._flush(True)
        index = self.at
        tail = (np.array([*self.starts, self.at], "<u8").tobytes() + np.array(self.docs, "<i8").tobytes()
                + np.array(self.nulls, np.uint8).tobytes() + np.array(self.counts, "<u8").tobytes()
                + TRAILER.pack(len(self.starts), len(self.docs), self.n_ids, index, MAGIC))
        self.sink.write(tail)
        self.sink.close()
        return len(self.docs), self.n_ids, index + len(tail)


class FileReader:
    """Random access by the index: the ids at any places of the file, and its documents."""

    def __init__(self, store: arrow_fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        magic, version, block, self.upper = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        n_blocks, n_docs, self.n_ids, index, end = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if (magic, version, block, end) != (MAGIC, VERSION, BLOCK, MAGIC):
            raise ValueError(f"{path} is not a complete file of token ids")
        tail = self.file.read_at(size - TRAILER.size - index, index)
        self.starts = np.frombuffer(tail, "<u8", n_blocks + 1).astype(np.int64)
        at = 8 * (n_blocks + 1)
        self.docs = np.frombuffer(tail, "<i8", n_docs, at)
        self.nulls = np.frombuffer(tail, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.counts = np.frombuffer(tail, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.begins = np.cumsum(self.counts) - self.counts

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids at places begin to end, exclusive."""
        parts, first = [], begin // BLOCK
        while first * BLOCK < end:
            last = min(first + SPAN // BLOCK, -(-end // BLOCK))
            at = self.starts[first:last + 1]
            raw = np.frombuffer(self.file.read_at(int(at[-1] - at[0]), int(at[0])), np.uint8)
            parts.append(unpack_blocks(raw, at[:-1] - at[0], self.upper).reshape(-1))
            first = last
        out = np.concatenate([np.empty(0, np.uint32), *parts])
        return out[begin % BLOCK:begin % BLOCK + end - begin] if end > begin else out[:0]

    def documents(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Runs of documents with about SPAN ids, and the ids of each run."""
        a = 0
        while a < len(self.docs):
            b = max(a + 1, int(np.searchsorted(self.begins, self.begins[a] + SPAN, side="left")))
            yield slice(a, b), self.ids(int(self.begins[a]), int(self.begins[b - 1] + self.counts[b - 1]))
            a = b


# --- token ids ---------------------------------------------------------------------------------------------------------

#: Characters for which lower-casing is the only normalisation that matters: ASCII, Latin-1 and Latin Extended-A but for U+0130.
PLAIN = re.compile("[^\\x00-\u012f\u0131-\u017f]")
#: The vocabulary's own pattern over them after lower-casing (fixed by its file): letters, one digit, contractions, the rest.
PARTS = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)|"
                   "[^\\t-\\r \x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\u017f]+")
BLANK = re.compile("[\\t-\\r ]+")
LONG, SEGMENT = 100, 1 << 20
#: Parts remembered by a worker process, twice at most (about 200 bytes each).
WORDS = 400_000
ARRAY_KIND = {"<u2": "H", "<u4": "I"}


def _byte_chars() -> dict[int, int]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)}
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(others)}


BYTE_CHARS = _byte_chars()


class Parts(Memo):
    """Remembers parts of LONG characters at most."""

    def __missing__(self, part: str) -> bytes:
        return super().__missing__(part) if len(part) <= LONG else self.make(part)


class WordEncoder:
    """Ids of a text by a vocabulary of lower-case words: each distinct part of a text is encoded once by the library.

    White space parts words, and no merge crosses the parts that the vocabulary's pattern cuts.  Segments in Latin letters
    are lower-cased and cut by that pattern here, so that the library only merges; in others, each word with further
    characters goes to the library whole, and so do all segments that hold the beginning of a special token.  Parts of more than LONG characters are not remembered.
    """

    def __init__(self, definition: str, kind: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = kind
        self.model = self.library.model
        self.parts = Parts(self._part, WORDS)
        self.specials = {t.content[:2] for t in self.library.get_added_tokens_decoder().values()}

    def _ids(self, part: str) -> bytes:
        return np.array(self.library.encode(part, add_special_tokens=False).ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part that is normalised and cut already: what is left to the library is the merging."""
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(BYTE_CHARS)
        return array(ARRAY_KIND[self.kind], [t.id for t in self.model.tokenize(part)]).tobytes()

    def _segments(self, text: str) -> Iterator[str]:
        """Slices of about SEGMENT characters that end at a space."""
        a = 0
        while len(text) - a > SEGMENT:
            b = text.find(" ", a + SEGMENT) + 1
            if not b:
                break
            yield text[a:b]
            a = b
        yield text[a:] if a else text

    def _segment(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self._ids(text)
        if text.isascii() or not PLAIN.search(text):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower())))
        return b"".join([self._ids(w) if PLAIN.search(w) else self._segment(w) for w in BLANK.split(text)])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._segment, self._segments(text)))


_encoders: dict[tuple[str, str], WordEncoder] = {}


def id_kind(definition: str) -> str:
    """uint16 where the vocabulary fits, else uint32."""
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


class Ranges(NamedTuple):
    """Ranges of ids that hold about as many rows each: their upper ends, ascending, and ranges for rows without an id.

    An id with so many rows that it ends several ranges has its rows dealt over them.
    """
    ends: np.ndarray
    without: int

    def of(self, ids: np.ndarray, null: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The range of each row; ``draw`` (0 to 1) deals the rows of an id that has several, in ascending order."""
        first, last = (np.searchsorted(self.ends, ids, side) for side in ("left", "right"))
        n = np.where(null, self.without, np.maximum(last - first, 1))
        return np.where(null, len(self.ends) + 1, first) + np.minimum((draw * n).astype(np.int64), n - 1)


def id_ranges(docs: DataFrame, id_col: str, n: int) -> Ranges:
    """About ``n`` ranges of the ids, from their quantiles: n numbers come to the driver, and only the ids are read."""
    ids = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"))
    found = ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [1.0], F.lit(100 * n)).alias("ends"),
                    F.count("*").alias("all"), F.count("id").alias("known")).first()
    return Ranges(np.array(found["ends"] or [], np.int64), max(1, math.ceil(n * (1 - found["known"] / max(1, found["all"])))))


def token_rows(docs: DataFrame, path: str, ranges: Ranges, id_col: str = "doc_id", text_col: str = "text",
               end_id: int | None = 1) -> tuple[DataFrame, str]:
    """(range, id, tie, ids) of each document: its ids and then ``end_id`` as bytes; and the type of an id in the bytes.

    A null text counts as empty.  ``path`` names a vocabulary of the tokenizers library whose pre-tokenizer removes white
    space and cuts by the pattern of PARTS.  Special tokens in texts are found as the library finds them.  ``tie`` orders rows of
    one id: by a hash of their ids, or, where the id has several ranges, by their places in the table.
    """
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    kind = id_kind(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def make():
        if (shared.value, kind) not in _encoders:
            _encoders[shared.value, kind] = WordEncoder(shared.value, kind)
        encoder, place = _encoders[shared.value, kind], [TaskContext.get().partitionId() << 40]

        def each(batch):
            ids = [encoder.encode(t) + end for t in texts_of(batch.column(1))]
            doc, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            tie = np.array([zlib.crc32(i) for i in ids], np.int64)
            dealt = mix64(np.arange(place[0], place[0] + len(ids)).astype(np.uint64)) >> np.uint64(32)
            place[0] += len(ids)
            several = np.where(null, ranges.without, np.diff([np.searchsorted(ranges.ends, doc, s) for s in ("left", "right")], axis=0)[0]) > 1
            tie = np.where(several, dealt.astype(np.int64), tie)
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(doc, null, tie / 2.0 ** 32)), batch.column(0), pa.array(tie),
                                              pa.array(ids, pa.binary())], ["range", "id", "tie", "ids"])
        return each

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(rows, make, "range bigint, id bigint, tie bigint, ids binary"), kind


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int | None = 1, percentile: int = PERCENTILE, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all documents under ``folder`` (one of its own in the checkpoint folder) and returns the manifest.

    A row of the manifest names a file, its place in the order (part, seq), its documents, ids and bytes, and in ``start``
    the number of ids in the files before it.  An empty table gives an empty manifest.  Files hold about ``file_ids`` ids at
    most, and whole documents.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, kind = token_rows(docs, path, id_ranges(docs, id_col, n), id_col, text_col, end_id)
    upper = int(kind[-1])
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = rows.repartition(n, "range").sortWithinPartitions("range", "id", "tie", "ids")

    def run(batches):
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        name, part, seq, out, done = uuid.uuid4().hex, -1, 0, None, []
        for batch in batches:
            for here, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if out is not None and (here != part or out.n_ids >= file_ids):
                    done.append((out.path, part, seq, *out.close()))
                    out = None
                if here != part:
                    part, seq = here, -1
                if out is None:
                    seq += 1
                    out = FileWriter(store, f"{base}/{part:06d}-{seq:06d}-{name}.pfor", upper, percentile)
                out.add(doc, np.frombuffer(ids.as_buffer(), kind).astype(np.uint32))
        if out is not None:
            done.append((out.path, part, seq, *out.close()))
        names = ["path", "part", "seq", "n_docs", "n_ids", "n_bytes"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], pa.schema(
            [("path", pa.string()), *((n, pa.int64()) for n in names[1:])]))

    files = stored(rows.mapInArrow(run, MANIFEST))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    root = folder[:-len(filesystem(folder)[1])] if folder.endswith(filesystem(folder)[1]) else ""
    return files.withColumns({"start": F.coalesce(F.sum("n_ids").over(before), F.lit(0)),
                              "path": F.concat(F.lit(root), F.col("path"))})


def _from_files(manifest: DataFrame, schema: str, make_batch) -> DataFrame:
    """Maps runs of documents of the manifest's files: ``make_batch(reader, run, ids, start of the file)``."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = filesystem(row["path"])
                reader = FileReader(store, path)
                for docs, ids in reader.documents():
                    yield make_batch(reader, docs, ids, row["start"])
    n = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return manifest.select("path", "start").repartition(int(n), "path").mapInArrow(run, schema)


def _names(reader: FileReader, docs: slice) -> pa.Array:
    return pa.array(reader.docs[docs], pa.int64(), mask=reader.nulls[docs])


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents back from the files: id, start (ids of all documents before it) and token_ids."""
    def make_batch(reader, docs, ids, start):
        begins = reader.begins[docs]
        ends = np.append(begins - begins[0], len(ids)).astype(np.int32)
        return pa.RecordBatch.from_arrays([_names(reader, docs), pa.array(begins + start), pa.ListArray.from_arrays(
            pa.array(ends), pa.array(ids.astype(np.int64)))], ["id", "start", "token_ids"])
    out = _from_files(manifest, "id bigint, start bigint, token_ids array<bigint>", make_batch)
    return out.withColumnRenamed("id", id_col)


def token_file_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from files written and read back."""
    def make_batch(reader, docs, ids, start):
        begins, counts = reader.begins[docs], reader.counts[docs]
        raw = memoryview(ids.astype("<u4").tobytes())
        at = (begins - begins[0]).tolist()
        crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at, counts.tolist())]
        return pa.RecordBatch.from_arrays([_names(reader, docs), pa.array(begins + start), pa.array(counts),
                                           pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])
    manifest = write_token_files(docs, path, id_col=id_col, text_col=text_col, end_id=end_id)
    out = _from_files(manifest, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", make_batch)
    return out.withColumnRenamed("id", id_col)
