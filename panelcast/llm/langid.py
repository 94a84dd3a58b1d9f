"""Language identification: averaged hashed subword embeddings with a linear softmax.

Text is folded to lower-case letters and single spaces; its character n-grams (1 to 4) are hashed to buckets, each
bucket has an embedding, and the mean embedding goes through a linear softmax.  Both are trained by mini-batch
stochastic gradient descent in numpy on the driver, on a sample of at most ``SAMPLE_ROWS`` labelled rows per language
and at most ``SAMPLE_CHARS`` characters of each (both bounds are parameters; the rows are chosen by a hash of the id,
the characters start at a place given by another hash).  A part of the sample stays out of training: on it the softmax
is calibrated by one temperature, and texts are rejected whose calibrated score lies within ``MARGIN`` of blind guessing,
or lower where that would reject more than a share ``ALPHA`` of the calibration texts.

Because the model is linear after the mean, a bucket's embedding times the output layer is one row of logits: prediction
sums table rows over whole texts, in every task, on Arrow batches.  Texts are cut every ``PIECE`` characters; sums add up.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows with a null label are
not learned from; without any labelled row every text is ``und``; repeated rows get equal predictions; an empty table
gives an empty table; other columns are carried along by ``identify``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .arrow_rows import map_batches
from .common import packed

UNKNOWN = "und"
BUCKET_BITS, DIM, ORDERS = 16, 16, (1, 2, 3, 4)
SAMPLE_ROWS, SAMPLE_CHARS = 400, 2000
ALPHA, MARGIN, PIECE = 0.001, 0.15, 1 << 18
LETTER = regex.compile(r"\p{L}")

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space (built once per process)."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                table[code] = ord(char.lower()[0])
        _fold.append(table)
    return _fold[0]


def folded(text: str) -> np.ndarray:
    codes = fold_table()[np.frombuffer((" " + text + " ").encode("utf-32-le", "replace"), np.uint32)]
    space = codes == 32
    return codes[~(space & np.concatenate([[False], space[:-1]]))]


def ngram_buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each n-gram of this order (empty if the text is shorter)."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h = (h ^ codes[k:k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)


def buckets_of(text: str) -> np.ndarray:
    codes = folded(text)
    return np.concatenate([ngram_buckets(codes, n) for n in ORDERS])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray      # buckets x languages: logits of one n-gram
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities, one row per text."""
        sums = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        group, size = [], 0

        def flush():
            nonlocal group, size
            if not group:
                return
            rows = [i for i, _ in group]
            for n in ORDERS:
                found = [ngram_buckets(c, n) for _, c in group]
                lengths = np.array([len(f) for f in found])
                full = lengths > 0
                if full.any():
                    starts = np.cumsum(lengths) - lengths
                    part = np.add.reduceat(self.table[np.concatenate(found)], starts[full], axis=0, dtype=np.float64)
                    np.add.at(sums, np.array(rows)[full], part)
                    np.add.at(count, np.array(rows), lengths)
            group, size = [], 0

        limit = max(4096, PIECE // max(1, len(self.langs) // 4))
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text)), limit):
                codes = folded(text[at:at + limit])
                group.append((i, codes))
                size += len(codes)
                if size >= limit:
                    flush()
        flush()
        logits = (sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        return softmax(logits)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.5, seed: int = 11,
          alpha: float = ALPHA) -> Model:
    """Stochastic gradient descent (Adagrad steps) on whole samples and short snippets of them."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows, held = [], []
    for i, (text, label) in enumerate(zip(texts, labels)):
        y = langs.index(label)
        words = text.split()
        snippets = [text]
        for longest in (4, 20):
            if words:
                at, n = int(rng.integers(len(words))), int(rng.integers(1, longest + 1))
                snippets.append(" ".join(words[at:at + n]))
        snippets = [s for s in snippets if LETTER.search(s)]
        if i % 5 == 4:
            held += [(s, y) for s in snippets[:1]]
        else:
            rows += [(buckets_of(s), y) for s in snippets]
    width, classes = 1 << BUCKET_BITS, len(langs)
    emb = rng.normal(0, 0.1, (width, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    seen_emb, seen_out, seen_bias = np.full((width, 1), 1e-6, np.float32), np.full((DIM, classes), 1e-6, np.float32), 1e-6
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[k] for k in order[at:at + batch]]
            y = np.array([r[1] for r in part])
            which = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            used, inverse = np.unique(np.concatenate([r[0] for r in part]), return_inverse=True)
            counts = np.bincount(which * len(used) + inverse, minlength=len(part) * len(used)).reshape(len(part), -1)
            mean = (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
            hidden = mean @ emb[used]
            grad = softmax(hidden @ out + bias).astype(np.float32)
            grad[np.arange(len(part)), y] -= 1
            grad /= len(part)
            grad_out, grad_emb, grad_bias = hidden.T @ grad, mean.T @ (grad @ out.T), grad.sum(axis=0)
            seen_out += grad_out ** 2
            seen_bias = seen_bias + grad_bias ** 2
            seen_emb[used] += (grad_emb ** 2).mean(axis=1, keepdims=True)
            out -= rate * grad_out / np.sqrt(seen_out)
            bias -= rate * grad_bias / np.sqrt(seen_bias)
            emb[used] -= rate * 0.2 * grad_emb / np.sqrt(seen_emb[used])
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if held:
        logits = np.log(np.maximum(model.scores([t for t, _ in held]), 1e-12))
        truth = np.array([y for _, y in held])
        grid = np.geomspace(0.2, 20, 60)
        loss = [-np.mean(np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12))) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        sure = softmax(logits / model.temperature).max(axis=1)
        # A little above blind guessing, and no more than a share alpha of the calibration texts falls below it.
        model.threshold = float(min(1 / classes + MARGIN, np.quantile(sure, alpha, method="lower")))
    return model


def _share(id_: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(id_.cast("string"), F.lit(seed)), F.lit(1 << 30))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, chars: int) -> list[tuple]:
    """(label, text) of at most ``rows`` rows per language, in a fixed order."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")) \
        .where(F.col("label").isNotNull() & F.col("id").isNotNull())
    counts = {r["label"]: r["n"] for r in narrow.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    wanted = F.lit(False)
    for label, n in counts.items():
        share = min(1.0, 1.5 * rows / n)
        wanted = wanted | ((F.col("label") == label) & (_share(F.col("id"), 5) < int(share * (1 << 30))))
    start = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(9)), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    picked = narrow.where(wanted & F.col("text").isNotNull()).select(
        "label", _share(F.col("id"), 5).alias("rank"), F.substring("text", (start + 1).cast("int"), F.lit(chars)).alias("text"))
    found = sorted((r["rank"], r["label"], r["text"]) for r in picked.collect())
    kept, taken = [], dict.fromkeys(counts, 0)
    for _, label, text in found:
        if taken[label] < rows:
            taken[label] += 1
            kept.append((label, text))
    return kept


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, **options) -> Model:
    sample = training_sample(docs, id_col, text_col, label_col, rows, chars)
    return train([t for _, t in sample], [y for y, _ in sample], **options)


def learnable(id_: Column) -> Column:
    """Rows to learn from: crc32 of the id as text is not 1 modulo 3."""
    return F.crc32(id_.cast("string").cast("binary")) % 3 != 1


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, rejected (which replace columns of these names)."""
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    names = {f.name for f in new}
    schema = StructType([*(f for f in docs.schema.fields if f.name not in names), *new])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def each(batch):
            fields = batch.schema.names
            texts = [t or "" for t in batch.column(fields.index(text_col)).to_pylist()]
            has = np.array([bool(model.langs) and bool(LETTER.search(t)) for t in texts], bool)
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if has.any():
                p = model.scores([t for t, h in zip(texts, has) if h])
                best = p.argmax(axis=1)
                score[has] = p[np.arange(len(best)), best]
                for i, k in zip(np.flatnonzero(has), best):
                    lang[i] = model.langs[k]
            rejected = ~has | (score < model.threshold)
            keep = [i for i, n in enumerate(fields) if n not in names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected, pa.bool_())], [*(fields[i] for i in keep), *(f.name for f in new)])
        return each

    return map_batches(docs, make, schema)


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = fit(docs.where(learnable(F.col(id_col))), id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = identify(rows, model).withColumn("held_out", ~F.coalesce(learnable(F.col("id")), F.lit(True)))
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows whose language is recognised, with all their columns."""
    model = fit(docs.where(learnable(F.col(id_col))), id_col, text_col, label_col)
    rows = packed(docs).select("_row", F.col(f"_row.`{text_col}`").alias("text"))
    return identify(rows, model).where(~F.col("rejected")).select("_row.*")
