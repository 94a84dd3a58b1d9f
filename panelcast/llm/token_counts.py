"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

Merging leaves the one segmentation in which no pair of neighbours would merge across its border, and any prefix of
it is the segmentation of that prefix.  So the last token after each character is fixed by what was read so far, and
all that later characters can ask for is: which starts are still the beginning of some piece, which token ended there,
and how many tokens there were.  These facts are finite, so they are the states of a deterministic transducer; each
transition is annotated with the number of tokens by which the count grows (or shrinks, when pieces merge).
Characters that are in no piece are written as their UTF-8 bytes and put the transducer back to its start.

States and transitions are compiled when they are first needed and kept, in bounded tables that start anew when full.

A text is cut into chunks; a chunk's state map takes the incoming state to (outgoing state, tokens).  Maps compose
associatively, and the scan over a text's chunks gives its count.  No piece joins a non-space to a space, so a chunk
that begins with a space has a constant map: these are kept in a memo.  Chunks longer than CHUNK are cut anywhere.

Defined results: a null text is empty and has 0 bytes and 0 tokens; repeated rows give repeated results; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import Memo, map_batches, texts_of

SPACE = "▁"
CHUNK = 4096
PART = 1 << 22
MAX_STATES = 300_000
START = 0


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a .model file whose options this transducer covers (else an error)."""
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    kinds = {p.type for p in model.pieces}
    if (train.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces
            or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or not train.byte_fallback or kinds - {1, 2, 3, 6}):
        raise ValueError("only BPE with byte fallback, identity normaliser, prefix space and plain pieces is covered")
    pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
    if any(c not in pieces for p in pieces for c in p) or any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("every character needs a piece of its own, and spaces may only lead a piece")
    return pieces


def merge_steps(text: str, score: dict[str, float]) -> Iterator[list[str]]:
    """Plain BPE of a short text, step by step: the best-scored adjacent pair first, the leftmost on a tie."""
    parts = list(text)
    while True:
        yield parts
        pairs = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
        if not pairs:
            return
        _, i = min(pairs)
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]


class Words(list):
    """Chunks that begin with a line break, or have lost the one space that leads them."""


class Transducer:
    """A state is a tuple of live starts: (text since that start, token that ended there, its count less the current one)."""

    def __init__(self, score: dict[str, float]):
        self.score = score
        self.begins = {p[:n] for p in score for n in range(1, len(p))}
        self.compatible = Memo(self._compatible, 250_000)
        # The tokens that touch a piece's border while it is being merged.
        self.ends = Memo(lambda piece: {parts[-1] for parts in merge_steps(piece, score)})
        self.starts = Memo(lambda piece: {parts[0] for parts in merge_steps(piece, score)})
        self.maps = Memo(lambda chunk: self.run(START, chunk)[1])
        self.words = Memo(lambda word: self.run(START, word if word[:1] == "\n" else " " + word)[1], 600_000)
        self.cut = re.compile(rf"[ {SPACE}]+[^ {SPACE}]*")
        self._reset()

    def _reset(self):
        self.states = [(("", None, 0),)]
        self.number = {self.states[0]: START}
        self.moves: list[dict] = [{}]

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Whether merging both pieces' characters together gives these two pieces."""
        left, right = pair
        if not any(a + b in self.score for a in self.ends[left] for b in self.starts[right]):
            return True
        *_, parts = merge_steps(left + right, self.score)
        return parts == [left, right]

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition (next state, growth of the count) of one character."""
        letter = SPACE if char == " " else char
        if letter not in self.score:
            move = START, len(char.encode())
        else:
            live = [(seen + letter, before, rest) for seen, before, rest in self.states[state]]
            token, growth = next((text, rest + 1) for text, before, rest in live if text in self.score
                                 and (before is None or self.compatible[before, text]))
            after = tuple((text, before, rest - growth) for text, before, rest in live if text in self.begins)
            after += (("", token, 0),)
            number = self.number.get(after)
            if number is None:
                number = self.number[after] = len(self.states)
                self.states.append(after)
                self.moves.append({})
            move = number, growth
        self.moves[state][char] = move
        return move

    def run(self, state: int, chunk: str) -> tuple[int, int]:
        """The chunk's state map at one incoming state: (outgoing state, tokens)."""
        moves, total = self.moves, 0
        for char in chunk:
            try:
                state, more = moves[state][char]
            except KeyError:
                state, more = self._compile(state, char)
            total += more
        return state, total

    def scan(self, maps: Iterable) -> int:
        """Composes state maps from the start state on and returns the tokens of all of them."""
        state, total = START, 0
        for state_map in maps:
            state, more = state_map(state)
            total += more
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.states) > MAX_STATES:
            self._reset()
        return sum(map(self._tokens, self._chunks(text)))

    def _chunks(self, text: str) -> Iterable[list[str]]:
        """Lists of chunks, each beginning with its spaces; of a very long text a part at a time."""
        text = " " + text
        flat = text[1:].replace("\n", " \n")
        if len(text) > PART:
            found = (m[0] for m in self.cut.finditer(text))
            while part := list(islice(found, PART >> 4)):
                yield part
        elif "\n" in self.score or "  " in flat or SPACE in flat or flat[0] in " \n":
            yield self.cut.findall(text)
        else:  # words without the one space that leads them; lines end for certain, so a line break begins a chunk too
            yield Words(flat.split(" "))

    def _tokens(self, chunks: list[str]) -> int:
        memo = self.words if isinstance(chunks, Words) else self.maps
        if max(map(len, chunks)) <= CHUNK:
            return sum(map(memo.__getitem__, chunks))
        lead = lambda c: " " + c if memo is self.words and c[:1] != "\n" else c
        return sum(memo[c] if len(c) <= CHUNK else self.scan(
            lambda s, part=lead(c)[i:i + CHUNK]: self.run(s, part) for i in range(0, len(c) + 1, CHUNK)) for c in chunks)


_transducers: dict[int, Transducer] = {}


def transducer_of(score: dict[str, float]) -> Transducer:
    """One transducer per vocabulary and worker process, so that later tasks find it compiled."""
    key = hash(tuple(score))
    if key not in _transducers:
        _transducers[key] = Transducer(score)
    return _transducers[key]


def token_count_report(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        machine = transducer_of(shared.value)

        def each(batch):
            n_bytes, n_tokens = [], []
            for text in texts_of(batch.column(1)):
                n_bytes.append(len(text.encode()))
                n_tokens.append(machine.count(text))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                pa.array([n > limit for n in n_tokens], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])
        return each

    kind = rows.schema["id"].dataType.simpleString()
    out = map_batches(rows, make, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
