"""Token files, hard negatives and vector codes against the library and plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.llm import negatives, token_files, vector_codes, vectors

from .fixtures import documents, no_documents, records, rows
from .test_arrow import odd_texts

WORDS = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = ["<|startoftext|> a <|endoftext|>b<|STARTOFTEXT|>", "İstanbul ΣΑΣ ǅ ſß ²½ª", "don't I'LL x'sabc ''s '", "é ́x a b\x85c\xa0d\x1ce",
           "\x00\x7f\xad a\xadb", "Ⱥ Ⱦ ẞ K Å", "x" * 300 + " " + "é" * 300]


# --- token files -------------------------------------------------------------------------------------------------------

def expected_files(table) -> dict:
    """start, n_tokens and crc32 by document, in ascending id order (null last)."""
    lib, out, start = Tokenizer.from_file(WORDS), defaultdict(list), 0
    for doc, text in table:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        out[doc].append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark):
    texts = [*odd_texts(), *SPECIAL, None]
    table = list(enumerate(texts, -5))
    shuffled = random.Random(1).sample(table, len(table))
    got = records(token_files.token_file_report(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5), WORDS))
    want = expected_files(table)
    assert len(got) == len(table)
    for g in got:
        assert [(g["start"], g["n_tokens"], g["ids_crc32"])] == want[g["doc_id"]], table[g["doc_id"] + 5]


def test_word_encoder_segments(monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 40)
    definition = Path(WORDS).read_text(encoding="utf-8")
    encoder, lib = token_files.WordEncoder(definition, "<u4"), Tokenizer.from_file(WORDS)
    encoder.parts.limit = 30
    for text in [*odd_texts(5), *SPECIAL]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("w", range(1, 33))
def test_every_width_packs_like_a_bit_string(w):
    values = np.random.default_rng(w).integers(0, 1 << w, (3, token_files.BLOCK), dtype=np.uint64).astype(np.uint32)
    packed = token_files._pack(values, w)
    want = [int("".join(f"{v:0{w}b}" for v in row[::-1].tolist()), 2).to_bytes(token_files.BLOCK * w // 8, "little") for row in values]
    assert [p.tobytes() for p in packed] == want
    assert (token_files._unpack(packed, w) == values).all()


@pytest.mark.parametrize("upper,top", [(2, 1 << 16), (4, 1 << 32)])
def test_blocks_come_back(upper, top):
    rng = np.random.default_rng(upper)
    grid = rng.integers(0, top, (40, token_files.BLOCK), dtype=np.uint64).astype(np.uint32)
    grid[:10] //= 1000
    grid[10:20, ::17] = top - 1
    grid[20:25] = 7
    grid[25:30, 3:] = 0
    for percentile in (0, 50, 90, 100):
        blocks = token_files.pack_blocks(grid, upper, percentile)
        raw = np.frombuffer(b"".join(blocks), np.uint8)
        starts = np.cumsum([0, *map(len, blocks)])[:-1]
        assert (token_files.unpack_blocks(raw, starts, upper) == grid).all()
        assert (token_files.unpack_blocks(raw, starts[::-3], upper) == grid[::-3]).all()
    narrow = token_files.pack_blocks(grid[20:25], upper)
    assert all(len(b) == token_files.HEAD for b in narrow)       # equal ids take no bits


def test_token_files_many_files_and_lost_attempts(spark, tmp_path):
    docs = documents(spark)
    manifest = token_files.write_token_files(docs, WORDS, str(tmp_path / "ids"), file_ids=2000).cache()
    files = records(manifest.orderBy("part", "seq"))
    assert len(files) > 5 and len({f["path"] for f in files}) == len(files)
    assert [f["start"] for f in files] == np.cumsum([0, *(f["n_ids"] for f in files)])[:-1].tolist()
    assert all(Path(f["path"]).stat().st_size == f["n_bytes"] for f in files)
    (tmp_path / "ids" / "000000-000000-lost.pfor").write_bytes(b"PFOR half a file")   # what a lost task leaves
    lib = Tokenizer.from_file(WORDS)
    want = sorted([*lib.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in rows())
    back = records(token_files.read_token_files(manifest))
    assert sorted(r["token_ids"] for r in back) == want
    back.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in back]
    known = [i for i in ids if i is not None]
    assert known == sorted(known) and ids[len(known):] == [None, None]
    assert [r["start"] for r in back] == np.cumsum([0, *(len(r["token_ids"]) for r in back)])[:-1].tolist()
    again = records(token_files.token_file_report(docs.repartition(7), WORDS))
    assert sorted((r["start"], len(r["token_ids"])) for r in back) == sorted((r["start"], r["n_tokens"]) for r in again)


def test_token_files_deal_a_hot_id_over_ranges(spark):
    rng = random.Random(3)
    table = [(rng.choice([7, 7, 7, None, i]), f"text {i} " * rng.randrange(4)) for i in range(600)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    ranges = token_files.id_ranges(df, "doc_id", 8)
    assert (ranges.ends == 7).sum() >= 3 and ranges.without >= 2
    lanes = records(token_files.token_rows(df, WORDS, ranges)[0].groupBy("id").agg(F.count_distinct("range").alias("n")).where("id = 7 OR id IS NULL"))
    assert all(r["n"] >= 2 for r in lanes)
    back = sorted(records(token_files.read_token_files(token_files.write_token_files(df, WORDS))), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in back]
    known = [i for i in ids if i is not None]
    assert known == sorted(known) and ids[:len(known)] == known and len(ids) == len(table)
    lib = Tokenizer.from_file(WORDS)
    assert sorted((str(r["doc_id"]), r["token_ids"]) for r in back) == sorted(
        (str(i), [*lib.encode(t, add_special_tokens=False).ids, 1]) for i, t in table)


def test_token_files_random_access(tmp_path):
    store, base = token_files.filesystem(f"file://{tmp_path}")
    writer = token_files.FileWriter(store, f"{base}/x.pfor", 2)
    docs = [np.random.default_rng(i).integers(0, 50_000, n).astype(np.uint32) for i, n in enumerate([0, 1, 255, 256, 700, 200_000, 0, 3])]
    for i, d in enumerate(docs):
        writer.add(None if i == 1 else i - 2, d)
    writer.close()
    reader, flat = token_files.FileReader(store, f"{base}/x.pfor"), np.concatenate(docs)
    for a, b in [(0, 0), (0, 5), (250, 260), (256, 512), (700, 150_000), (len(flat) - 3, len(flat)), (0, len(flat))]:
        assert (reader.ids(a, b) == flat[a:b]).all()
    assert np.concatenate([x for _, x in reader.documents()]).tolist() == flat.tolist()
    with pytest.raises(ValueError):
        (tmp_path / "y.pfor").write_bytes(b"PFOR" + bytes(80))
        token_files.FileReader(store, f"{base}/y.pfor")


def test_token_files_of_nothing(spark):
    assert token_files.token_file_report(no_documents(spark), WORDS).collect() == []
    assert token_files.read_token_files(token_files.write_token_files(no_documents(spark), WORDS)).collect() == []


# --- vectors -----------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, uid long, id string, v string, block int, anchor boolean, score long"
BAD = [(400, None, 1), (401, [1.0, None, 0.5], 2), (50, [float("nan")] * 3, 1), (403, [float("inf")] * 3, 1), (404, [0.1] * 3, None)]


def vector_rows(seed: int, n: int = 240, dims: int = 6) -> list[tuple]:
    """Coarse vectors, so that scores tie; short, empty, repeated and useless ones; a common label; rows without id."""
    rng = np.random.default_rng(seed)
    out = [(i, (rng.integers(-6, 7, dims) / 16 + (0.5 if i % 4 else 0)).tolist(), int(rng.choice([0, 0, 0, 1, 2, 9]))) for i in range(n)]
    out += BAD + [(405, [], 1), (406, [0.25], 2), (None, out[3][1], 0), (None, [0.5] * dims, 1), (450, [-0.4] * dims, 3)]
    out += [out[0], out[50], out[50], out[7], (100, out[9][1], 2)]
    return [r + (5, "x", "y", 3, False, 9) for r in out]


def usable(table, need_label: bool):
    for i, v, label, *_ in table:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and not (need_label and label is None):
            yield i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label


def brute_negatives(table) -> list[tuple]:
    kept = list(usable(table, True))
    order = lambda c: (-c[1], c[0] is None, c[0] or 0)
    out = []
    for i, q, label in kept:
        if i is None or i % 50:
            continue
        scored = [(j, sum(a * b for a, b in zip(q, v)), m) for j, v, m in kept]
        positives = sorted((c for c in scored if c[2] == label and c[0] != i), key=order)[:5]
        for j, s, _ in positives:
            inside = sorted((c for c in scored if c[2] != label and 50 * s <= 100 * c[1] <= 95 * s), key=order)[:3]
            out += [(i, j, k + 1, c[0], s, c[1]) for k, c in enumerate(inside)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,block", [(1, 10_000), (2, 40), (3, 9)])
def test_hard_negatives_equal_brute_force(spark, seed, block):
    table = vector_rows(seed)
    df = spark.createDataFrame(table, VECTORS).repartition(4)
    got = negatives.hard_negatives(df, rows=block)
    assert [f.simpleString() for f in got.schema] == [f.replace(" ", ":") for f in negatives.RESULT.split(", ")]
    want = brute_negatives(table)
    assert len(want) > 40
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_scan_reads_fewer_rows_but_loses_none():
    rng = np.random.default_rng(5)
    n, dims = 3000, 64
    grid = np.floor(256 * rng.normal(size=(n, dims)) / 8).astype(np.int64)
    block = negatives.Block(np.arange(n), np.zeros(n, bool), rng.integers(0, 3, n), grid)
    kept = []

    def watched(scores, least, most):
        stay = may_stay(scores, least, most)
        kept.append(stay.sum())
        return stay
    q = grid[17]
    truth = grid @ q
    may_stay = lambda s, a, b: s + b >= np.partition(s, -5)[-5] + a
    at, scores = block.scan(q, np.arange(n), watched)
    assert (scores == truth[at]).all() and kept[-1] < n / 10
    assert set(np.lexsort((np.arange(n), -truth))[:5]) <= set(at.tolist())


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    useless = spark.createDataFrame([b + (5, "x", "y", 3, False, 9) for b in BAD], VECTORS)
    assert negatives.hard_negatives(useless).collect() == []
    alone = spark.createDataFrame([(50, [1.0, 2.0], 1), (51, [], 2)], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(alone).collect() == []


def brute_codes(table, parts, entries, rounds):
    kept = list(usable(table, False))
    dims = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    grid = np.array([v + [0] * (dims - len(v)) for _, v, _ in kept], np.int64).reshape(len(kept), parts, dims // parts)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, grid[k].astype("<i2").tobytes()))[:entries]
    books = grid[first].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        far = ((grid[:, :, None, :] - books[None]) ** 2).sum(-1)
        code = far.argmin(-1)
        if r < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (code[:, p] == e).any():
                        books[p, e] = grid[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    error = far.min(-1).sum(-1)
    rows = [(i, "".join(f"{c:02x}" for c in code[k]), int(error[k])) for k, (i, _, _) in enumerate(kept)]
    by_label = defaultdict(int)
    for (_, _, e), (_, _, label) in zip(rows, kept):
        by_label[label] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((*r, by_label[label]) for r, (_, _, label) in zip(rows, kept)), key=str), digest


@pytest.mark.parametrize("hot", [1, 1000])
def test_vector_codes_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(vector_codes, "HOT_LABELS", hot)
    table = vector_rows(4, n=400, dims=32)
    df = spark.createDataFrame(table, VECTORS).repartition(3)
    got = records(vector_codes.vector_code_report(df))
    want, digest = brute_codes(table, 16, 64, 2)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


@pytest.mark.parametrize("parts,entries,rounds,kept", [(3, 20, 6, 8), (2, 7, 5, 2), (1, 30, 4, 1), (4, 500 // 2, 2, 8)])
def test_vector_codes_with_other_parameters(spark, parts, entries, rounds, kept):
    table = vector_rows(6, n=150, dims=7)
    out, books = vector_codes.vector_codes(spark.createDataFrame(table, VECTORS), parts=parts, entries=entries, rounds=rounds, kept=kept)
    want, digest = brute_codes(table, parts, entries, rounds)
    assert books.digest() == digest
    assert sorted(((r["id"], bytes(r["code"]).hex(), r["error"]) for r in out.collect()), key=str) == [w[:3] for w in want]


def test_bounds_settle_most_parts_and_b_shrinks():
    rng = np.random.default_rng(8)
    grid = rng.normal(0, 60, (4000, 4)).astype(np.int64)
    books = grid[:64].copy()
    near, bounds = vector_codes.nearest(grid, books, 8)
    kept, met_all = 8, []
    for _ in range(8):
        new = np.array([grid[near[:, 0] == e].sum(0) // max(1, (near[:, 0] == e).sum()) for e in range(64)])
        moved = np.nextafter(np.sqrt(((new - books) ** 2).sum(1).astype(float)) * (1 + 1e-9), np.inf)
        books = new
        near, bounds, depth, full = vector_codes.carried(grid, near.copy(), bounds.astype(float), books, moved, kept)
        assert (near[:, 0] == ((grid[:, None] - books) ** 2).sum(-1).argmin(1)).all()
        met_all.append(full)
        kept = min(kept, max(vector_codes.LEAST_KEPT, depth))
    assert met_all[-1] < met_all[0] and met_all[-1] < len(grid) / 4, met_all


def test_vector_codes_of_nothing(spark):
    assert vector_codes.vector_code_report(spark.createDataFrame([], VECTORS)).collect() == []
    empty = spark.createDataFrame([(1, [], None), (2, [], 3)], "vec_id long, embedding array<float>, label int")
    assert {(r["vec_id"], r["code"], r["error"]) for r in records(vector_codes.vector_code_report(empty))} == {(1, "00" * 16, 0), (2, "00" * 16, 0)}
    with pytest.raises(ValueError):
        vector_codes.vector_codes(empty, entries=257)


def test_integer_vectors_round_down(spark):
    df = spark.createDataFrame([(1, [-0.001, 0.999, -1.0, 2.0 ** -20], 1)], "vec_id long, embedding array<double>, label int")
    packed = vectors.packed_vectors(vectors.integer_vectors(df, "vec_id", "embedding", F.col("label")), 3)
    assert packed.n == 1 and packed.dims == 6
    assert np.frombuffer(packed.table.first()["v"], packed.kind).tolist() == [-1, 255, -256, 0, 0, 0]
