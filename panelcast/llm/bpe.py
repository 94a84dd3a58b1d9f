"""Byte-level BPE encoding by backtracking over longest matches, decoding by an offset table.

Merging pairs in order of rank gives the one token sequence in which no two neighbours would have been merged
across their border.  The encoder looks for that sequence directly: an Aho-Corasick automaton gives the longest
token at every position; going left to right it takes the longest token that is compatible with the token before,
falls back to shorter ones, and steps back where none fits.  A position that failed once is never tried again, so
the time is linear.  Compatibility of a pair of tokens is worked out once from the merge table and kept.

Decoding copies byte ranges: the table holds all tokens' bytes in one array with their offsets.

Texts are cut into words first (the vocabulary's own pattern); a word never depends on its neighbours, so encoded
words are kept in a memo of bounded size.  Texts longer than ``SEGMENT`` characters are handled in segments that
end between words, so memory does not grow with the text where it has spaces.

Defined results: a null text is empty and has no tokens (digest of the empty string); special tokens that occur in a
text are encoded as their own id; repeated rows give repeated results; an empty table gives an empty table; in
``bpe_encode`` other columns are carried along.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .arrow_rows import Memo, map_batches, texts_of

SEGMENT = 1 << 20
WHITE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the public word pattern of the byte-level vocabulary.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: A superset cut: every boundary of these parts is a boundary of WORDS too, so parts can be encoded apart.
PARTS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
SAFE_CUT = re.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself where printable, else the next free above 255."""
    own = {b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normaliser and prefix space is needed")
        of = {letter: b for b, letter in enumerate(byte_letters())}
        raw = lambda s: bytes(of[c] for c in s).decode("latin-1")
        ids = {raw(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        size = 1 + max([*ids.values(), *self.special.values()])
        text_of = [""] * size
        for s, i in ids.items():
            text_of[i] = s
        self.length = [len(s) for s in text_of]
        # Merge table: rank of a pair, and for each token its parts and the rank that made it.
        self.rank, self.left, self.right, self.made = {}, {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            i, j, k = ids[a], ids[b], ids[a + b]
            self.rank[i, j] = r
            if k not in self.made:
                self.left[k], self.right[k], self.made[k] = i, j, r
        # Tokens that merging can produce; others never come out of an encoding.
        usable = {s: i for s, i in ids.items() if len(s) == 1 or i in self.made}
        self.shorter = [-1] * size
        automaton = ahocorasick.Automaton()
        for s, i in usable.items():
            automaton.add_word(s, i)
            self.shorter[i] = next((usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in usable), -1)
        automaton.make_automaton()
        self.automaton = automaton
        self.compatible = Memo(self._compatible, 150_000)
        self.parts = Memo(self._encode_part, 250_000)

        pool = [s.encode("latin-1") for s in text_of]
        for s, i in self.special.items():
            pool[i] = s.encode()
        self.pool = np.frombuffer(b"".join(pool), np.uint8)
        self.size = np.array([len(b) for b in pool], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.decimal = [str(i) for i in range(size)]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of both tokens together leaves the border between them alone.

        The token ends that touch the border grow by their own merges in order of rank; the border falls if the
        pair that touches it has a merge that comes first (on equal ranks the merge further left comes first).
        """
        ends, starts = [pair[0]], [pair[1]]
        while ends[-1] in self.right:
            ends.append(self.right[ends[-1]])
        while starts[-1] in self.left:
            starts.append(self.left[starts[-1]])
        a, b = ends.pop(), starts.pop()
        never = len(self.rank)
        while True:
            cross = self.rank.get((a, b), never)
            grow_a = self.made[ends[-1]] if ends else never
            grow_b = self.made[starts[-1]] if starts else never
            if cross < grow_a and cross <= grow_b and cross < never:
                return False
            if not ends and not starts:
                return True
            if grow_a <= grow_b:
                a = ends.pop()
            else:
                b = starts.pop()

    def _encode_word(self, word: str) -> list[int]:
        """Tokens of one word, given as one letter per byte."""
        longest = [-1] * len(word)
        for end, token in self.automaton.iter(word):
            longest[end + 1 - self.length[token]] = token
        length, shorter, compatible = self.length, self.shorter, self.compatible
        out: list[int] = []
        dead = set()
        at, token, n = 0, longest[0], len(word)
        while True:
            end = at + length[token]
            if end not in dead and (not out or compatible[out[-1], token]):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def _encode_part(self, part: str) -> bytes:
        ids = array("i")
        for word in WORDS.findall(part):
            ids.extend(self._encode_word(word.encode().decode("latin-1")))
        return ids.tobytes()

    def segments(self, text: str) -> Iterator[str]:
        """Pieces of about SEGMENT characters that end where a word ends for certain."""
        at = 0
        while len(text) - at > SEGMENT:
            cut = SAFE_CUT.search(text, at + SEGMENT)
            if not cut:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def encode_parts(self, text: str) -> Iterator[np.ndarray]:
        """Token ids of a text, in arrays of bounded size."""
        for k, plain in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield np.array([self.special[plain]], np.int32)
            elif plain:
                for segment in self.segments(plain):
                    yield np.frombuffer(b"".join(map(self.parts.__getitem__, PARTS.findall(segment))), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int32), *self.encode_parts(text)])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        source = np.repeat(self.offset[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.pool[source].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


_codecs: dict[bytes, Codec] = {}


def codec_of(definition: bytes) -> Codec:
    """One compiled codec per worker process."""
    key = hashlib.sha256(definition).digest()
    if key not in _codecs:
        _codecs[key] = Codec(definition)
    return _codecs[key]


def _definition(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids",
               check_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each text (array<int>), and in ``check_col`` whether they decode to it again."""
    shared = _definition(docs, path)
    new = [StructField(ids_col, ArrayType(IntegerType()))] + ([StructField(check_col, BooleanType())] if check_col else [])
    names = {f.name for f in new}

    def make():
        codec = codec_of(shared.value)

        def each(batch):
            fields = batch.schema.names
            texts = list(texts_of(batch.column(fields.index(text_col))))
            ids = [codec.encode(t) for t in texts]
            out = [pa.array(ids, pa.list_(pa.int32()))]
            if check_col:
                out.append(pa.array([codec.decode(i) == t for i, t in zip(ids, texts)], pa.bool_()))
            keep = [i for i, n in enumerate(fields) if n not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *out],
                                             [*(fields[i] for i in keep), *(f.name for f in new)])
        return each

    return map_batches(docs, make, StructType([*(f for f in docs.schema.fields if f.name not in names), *new]))


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text its ids stand for (null ids: empty)."""
    shared = _definition(encoded, path)

    def make():
        codec = codec_of(shared.value)

        def each(batch):
            ids = (v.as_py() or [] for v in batch.column(batch.schema.names.index(ids_col)))
            text = pa.array([codec.decode(np.array(i, np.int64)) for i in ids], pa.string())
            keep = [i for i, n in enumerate(batch.schema.names) if n != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), text],
                                             [*(batch.schema.names[i] for i in keep), text_col])
        return each

    schema = StructType([*(f for f in encoded.schema.fields if f.name != text_col), StructField(text_col, StringType())])
    return map_batches(encoded, make, schema)


def bpe_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, then decoded from its ids again."""
    shared = _definition(docs, path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        codec = codec_of(shared.value)

        def digest(text: str):
            n, ids_hash, text_hash, lead = 0, hashlib.sha256(), hashlib.sha256(), ""
            for ids in codec.encode_parts(text):
                if len(ids):
                    ids_hash.update((lead + ",".join(map(codec.decimal.__getitem__, ids.tolist()))).encode())
                    text_hash.update(codec.decode_bytes(ids))
                    n, lead = n + len(ids), ","
            return n, ids_hash.hexdigest(), text_hash.hexdigest()

        def each(batch):
            out = [digest(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return each

    kind = rows.schema["id"].dataType.simpleString()
    out = map_batches(rows, make, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
