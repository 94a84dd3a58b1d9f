"""Mixing, fingerprints, chat formatting, exact dedup and personal data against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from panelcast.llm import chat, exact_dedup, fingerprints, mixing, pii
from panelcast.llm.common import running_sums, word_count

from .fixtures import SCHEMA, documents, no_documents, records, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GAP = re.compile(r"[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_word_count(spark):
    for n, text in documents(spark).select(word_count(F.col("text")), "text").collect():
        assert n == len(WORD.findall(text or ""))


def targets_by_hand(sizes, share=1.5, cap=2.0):
    """Shares by weight; what is above a cap is reshared among the rest until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    total, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = cap * sizes[s]
        open_ -= above
    return target


def test_mix_report(spark):
    got = records(mixing.mix_report(documents(spark)))
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = targets_by_hand(sizes)
    taken = defaultdict(int)
    for g in got:
        assert g["source_size"] == sizes[g["source"]]
        assert math.isclose(g["target"], target[g["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= g["taken"] <= 2 * g["size"]
        taken[g["source"]] += g["taken"]
    ties = max(Counter((r[0], r[3]) for r in rows()).values())
    for s in sizes:
        assert target[s] - 1 - ties <= taken[s] <= target[s] + 1e-6
    again = records(mixing.mix_report(documents(spark).repartition(7)))
    pick = lambda rs: Counter((g["doc_id"], g["source"], g["size"], g["taken"]) for g in rs)
    assert pick(got) == pick(again)


def test_mix_rows_follow_the_report(spark):
    docs = documents(spark)
    out = records(mixing.mix(docs))
    assert list(mixing.mix(docs).columns) == docs.columns
    words = Counter()
    for r in out:
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    exp = Counter()
    for g in records(mixing.mix_report(docs)):
        exp[g["doc_id"], g["source"]] += g["taken"]
    assert +words == +exp
    texts = defaultdict(list)
    for r in rows():
        texts[r[0]].append(r[1] or "")
    assert all(any(t.startswith(r["text"]) for t in texts[r["doc_id"]]) for r in out)


def test_mix_of_one_large_source_uses_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 17 as int))").alias("text"),
                                 F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 97 == 1, "c").otherwise("a").alias("source"))
    got = records(mixing.mix_report(df))
    for s in "abc":
        own = [g for g in got if g["source"] == s]
        assert sum(g["taken"] for g in own) == math.floor(own[0]["target"])


def test_fingerprint_report(spark):
    got = records(fingerprints.fingerprint_report(documents(spark)))
    assert len(got) == len(rows())
    text = Counter(((r[0], r[1] or "") for r in rows()))
    down = sorted({r[0] for r in text}, key=lambda i: (i is None, -(i or 0)))
    follows = dict(zip(down, down[1:] + down[:1]))
    by_id = defaultdict(set)
    for doc, t in text:
        for other, tail in text:  # rows of one id may stand in either order
            if other == follows[doc] or other == doc:
                by_id[doc].add((len(t), sha(t[:len(t) - len(t) // 2] + tail[:len(t) // 2])))
    for g in got:
        assert (g["n_chars"], g["edited_sha256"]) in by_id[g["doc_id"]]
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    same = defaultdict(set)
    for g in got:
        same[g["fingerprint"]].add(g["n_chars"])
    assert all(len(v) == 1 for v in same.values())


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    ids = [3, 4, 9, 100, 101, 102, 103, 5000, -20]
    texts = {i: f"text number {i}. with a tail {i * 7}." for i in ids}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    down = sorted(ids, reverse=True)
    for g in records(fingerprints.fingerprint_report(df)):
        t, n = texts[g["doc_id"]], texts[down[(down.index(g["doc_id"]) + 1) % len(down)]]
        assert g["edited_sha256"] == sha(t[:len(t) - len(t) // 2] + n[:len(t) // 2])


PIECE = re.compile(fingerprints.PIECE, re.ASCII)


def lanes_by_hand(text):
    """Number of pieces, sums and one-bit lanes of a text, piece by piece."""
    found = PIECE.findall(text)
    sums, lanes = [0] * 16, [0] * 124
    for piece in found:
        digest = sha(piece).encode()
        seeded = [xxhash.xxh64_intdigest(digest, xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)) for k in range(10)]
        for k, h in enumerate(seeded[:2]):
            for j in range(31):
                lanes[62 * k + 2 * j] += h >> j & 1
                lanes[62 * k + 2 * j + 1] += h >> (j + 31) & 1
        for k, h in enumerate(seeded[2:]):
            sums[2 * k] = (sums[2 * k] + h) % 2 ** 32
            sums[2 * k + 1] = (sums[2 * k + 1] + (h >> 32)) % 2 ** 32
    return len(found), sums, lanes


def likeness_by_hand(a, b):
    (m, s, x), (n, t, y) = a, b
    if (m, s) == (n, t):
        return 1.0
    u, v = [2 * c - m for c in x], [2 * c - n for c in y]
    both = sum(c * c for c in u) + sum(c * c for c in v)
    return max(0.0, 1 - sum((p - q) ** 2 for p, q in zip(u, v)) / both) if both else 0.0


def test_fingerprints_and_likeness_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    texts = {r[0]: r[1] or "" for r in rows()[:38]}
    down = sorted(texts, reverse=True)
    df = spark.createDataFrame([(i, t or None) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    got = records(fingerprints.fingerprint_report(df))
    assert len(got) == len(texts)
    show = lambda f: f"{f[0]}:{''.join(f'{x:08x}' for x in f[1])}:{'.'.join(f'{x:x}' for x in f[2])}"
    for g in got:
        text, after = texts[g["doc_id"]], texts[down[(down.index(g["doc_id"]) + 1) % len(down)]]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        own, changed, other = lanes_by_hand(text), lanes_by_hand(edited), lanes_by_hand(after)
        assert (g["fingerprint"].upper(), g["edited_fingerprint"].upper()) == (show(own).upper(), show(changed).upper())
        assert g["near_edited"] == pytest.approx(likeness_by_hand(own, changed), abs=1e-9)
        assert g["near_next"] == pytest.approx(likeness_by_hand(own, other), abs=1e-9)


def test_ranges_hold_as_many_rows_whatever_the_ids(spark):
    at = fingerprints._range_of([10, 20, 20, 20, 30], 3)
    table = [(i, t) for i in (None, -5, 10, 11, 20, 21, 30, 31) for t in (-2 ** 63, -2 ** 61, 0, 2 ** 62, 2 ** 63 - 1)]
    df = spark.createDataFrame(table, "id long, tie long").withColumn("id", F.col("id").cast("decimal(20,0)"))
    got = df.select("id", "tie", at(F.col("id"), F.col("tie")).alias("at")).collect()
    order = sorted(got, key=lambda r: (r["id"] is None, -(r["id"] or 0), r["tie"]))
    assert [r["at"] for r in order] == sorted((r["at"] for r in got), reverse=True)
    lanes = lambda i: {r["at"] for r in got if r["id"] == i}
    assert (lanes(None), lanes(20), lanes(10), lanes(11), lanes(-5), lanes(31)) == ({-1, -2, -3}, {1, 2, 3}, {0}, {1}, {0}, {5})


def test_neighbours_of_outlying_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    ids = [*range(120), 10 ** 15, *[7] * 60, *[None] * 60]
    df = spark.createDataFrame([(i, f"a text {k}. and more {k * k}.") for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    texts = [r["text"] for r in df.select("text", "doc_id", F.xxhash64("text").alias("tie")).orderBy(
        F.col("doc_id").desc_nulls_last(), "tie").collect()]
    want = sorted(sha(t[:len(t) - len(t) // 2] + n[:len(t) // 2]) for t, n in zip(texts, texts[1:] + texts[:1]))
    assert sorted(g["edited_sha256"] for g in records(fingerprints.fingerprint_report(df))) == want


def test_fingerprint_algebra(spark):
    df = spark.createDataFrame([("First. Second. Third.", "First. ", "Second. Third.", "Else. Other. Third.")],
                               "ta string, tc string, td string, te string")
    fp = {c: fingerprints.fingerprint(F.col(f"t{c}")) for c in "acde"}
    row = df.select(
        fp["a"].alias("a"), fingerprints.combine(fp["c"], fp["d"]).alias("cd"),
        fingerprints.combine(fp["a"], fp["c"], -1).alias("less"), fp["d"].alias("d"),
        fingerprints.likeness(fp["a"], fp["a"]).alias("same"), fingerprints.likeness(fp["a"], fp["e"]).alias("other")).first()
    assert row["a"] == row["cd"] and row["less"] == row["d"]
    assert row["same"] == 1 and row["other"] < 0.8
    order = spark.createDataFrame([("x.y.z.",), ("z.x.y.",), ("x.y.y.",)], "t string").select(fingerprints.fingerprint(F.col("t")).alias("f"))
    first, second, third = (r["f"] for r in order.collect())
    assert first == second != third


def test_likeness_follows_the_share_in_common(spark):
    rng = random.Random(4)
    unit = lambda: " ".join(rng.choice("abcdefghij") * 3 for _ in range(6)) + str(rng.randrange(10 ** 9)) + ".\n"
    pairs = []
    for keep in (0, 20, 40, 60, 80):
        base = [unit() for _ in range(80)]
        pairs.append((keep, "".join(base), "".join(base[:keep] + [unit() for _ in range(80 - keep)])))
    df = spark.createDataFrame(pairs, "keep int, a string, b string")
    got = {r["keep"]: r["x"] for r in df.select("keep", fingerprints.likeness(
        fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("x")).collect()}
    assert all(abs(got[k] - k / 80) < 0.25 for k in got)


def test_exact_dedup(spark):
    got = records(exact_dedup.exact_dedup_report(documents(spark)))
    groups = defaultdict(list)
    for r in rows():
        groups[GAP.sub(" ", r[1] or "")].append(r[0])
    assert len(got) == len(rows())
    for g in got:
        norm = next(t for t in groups if sha(t) == g["text_sha256"])
        ids = [i for i in groups[norm] if i is not None]
        assert g["keep_id"] == (min(ids) if ids else None) and g["group_size"] == len(groups[norm])
    assert Counter(g["text_sha256"] for g in got if g["kept"]) == Counter(sha(t) for t in groups)
    docs = documents(spark)
    stay = records(exact_dedup.exact_dedup(docs))
    assert exact_dedup.exact_dedup(docs).columns == docs.columns
    assert Counter((r["doc_id"], GAP.sub(" ", r["text"] or "")) for r in stay) == Counter(
        (min((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())


@pytest.mark.parametrize("step", [1000, None])
def test_chat_of_many_turns_takes_no_square(spark, step):
    n = 8000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), (F.col("id") * step if step else F.lit(None).cast("long")).alias("turn"), F.when(
        F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.format_string("%05d text", "id").alias("text"))
    chat.chat_report(turns.limit(10)).collect()
    began = time.time()
    row = chat.chat_report(turns).first()
    assert time.time() - began < 15                # quadratic: 30 s and more
    texts = sorted((i * (step or 0), "user" if i % 3 == 0 else "assistant", f"{i:05d} text") for i in range(n))
    assert row["n_turns"] == n and row["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in texts))
    assert row["loss_sha256"] == sha("".join(t for _, r, t in texts if r == "assistant"))


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi & <|im_end|> &lt;| bye"), (1, 1, "user", ""), (1, 2, "assistant", "a<|im_sep|>b"), (1, 3, "assistant", None),
             (1, 3, "assistant", "again"), (1, 3, "assistant", "again"), (2, None, None, "no role"), (2, 5, "ass\nistant&", "x" * 5000),
             (None, 0, "assistant", "no conversation"), (3, 0, "system", "日本 <| & \n")]
    turns += [(4, i, "assistant" if i % 3 else "user", f"t{i} " * (i % 5)) for i in range(1300)]
    df = spark.createDataFrame([t + ("clash", 1) for t in turns],
                               "conv_id long, turn long, role string, text string, ts string, slice int").repartition(4)
    exp = defaultdict(list)
    for c, turn, role, text in sorted(turns, key=lambda t: (t[0] is None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        exp[c].append((role or "", text or ""))
    for size in (1, 7, 256):
        out = chat.format_conversations(df, slice_turns=size).withColumn("turns", chat.read_turns(F.col("formatted"))) \
            .withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"), group=5))
        got = {r["conv_id"]: r for r in records(out)}
        assert set(got) == set(exp)
        for c, r in got.items():
            assert [(t["role"], t["text"]) for t in r["turns"]] == exp[c]
            assert r["loss"] == "".join(x for role, x in exp[c] if role == "assistant")
            blocks = 1 + sum(a[0] != b[0] for a, b in zip(exp[c], exp[c][1:]))
            assert r["formatted"].count("<|im_start|>") == blocks == r["formatted"].count("<|im_end|>\n")


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "phone": 10 <= len(d) <= 15}[kind]


def spans_by_hand(text):
    out = [(m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if passes(kind, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_data(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("0123456789 .-+()@ab_é😀" if i % 2 else "0123456789.- +@a") for _ in range(rng.randrange(120))) for i in range(800)]
    texts += [None, "", "a@b.c_d@e.f+x@y.z.q..w", "1" * 30000 + "a", "a." * 20000 + "@x.y", "1 " * 30000, "x@" + "a." * 20000, "1.2.3.4 " * 3000,
              "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1111", "+1 (377) 555-0271 and 1.2.3.4.5.6.7.8 0001.02.3.255"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, mark int")
    for g in records(pii.pii_report(df)):
        exp = spans_by_hand(texts[g["doc_id"]] or "")
        assert g["base_sha256"] == sha(exp)
        assert sum(g[f"n_{k}"] for k in pii.KINDS) == (exp.count(",") + 1 if exp else 0)
        assert set(filter(None, exp.split(","))) <= set(g["spans"].split(","))


def test_revealing_terms(spark):
    told = [(i, f"contact zorblat at mail bob@x.example.org now please {'alpha' if i % 2 else 'beta'} gamma{i}") for i in range(6)]
    copies = [(50 + i, "one unusualword near eve@y.example.org in a passage") for i in range(4)]
    plain = [(100 + i, f"the contact at mail now please filler {i}") for i in range(200)]
    df = spark.createDataFrame(told + copies + plain, "doc_id long, text string")
    got = {g["doc_id"]: g["spans"] for g in records(pii.pii_report(df))}
    for i, t in told:
        a = t.index("zorblat")
        assert f"term:{a}:{a + 7}" in got[i].split(",")
        assert not any(t[int(s.split(":")[1]):int(s.split(":")[2])] in ("contact", "at", "mail", "now") for s in got[i].split(","))
    assert all("term" not in got[i] for i, _ in copies)      # one surrounding, however often it is copied
    assert all(got[i] == "" for i, _ in plain)
    text = {r["doc_id"]: r["sanitised"] for r in records(pii.sanitise(df))}
    assert "bob" not in text[0] and "zorblat" not in text[0] and "[EMAIL]" in text[0]
    assert text[100] == plain[0][1]


def terms_by_hand(texts):
    """Terms hidden in each text: PMI over whole documents, with the value or without it."""
    words = [set(filter(None, re.split(r"[\W_]+", t.lower()))) for t in texts]
    around = lambda t, v: tuple(sorted({w for m in re.finditer(re.escape(v), t) for w in (
        re.findall(r"[^\W_]+", t[:m.start()].lower())[-8:] + re.findall(r"[^\W_]+", t[m.end():].lower())[:8])}))
    holders = {}
    for i, t in enumerate(texts):
        for v in set(re.findall(r"[a-z0-9]+@[a-z.]+[a-z]", t)):
            holders.setdefault(v, []).append(i)
    out = [set() for _ in texts]
    for v, docs in holders.items():
        for w in set().union(*(words[i] for i in docs)):
            both = [i for i in docs if w in words[i]]
            if len({around(texts[i], v) for i in both}) < 2:
                continue
            with_term = [i for i, x in enumerate(words) if w in x]
            pmi = math.log(len(texts) * len(both) / (len(docs) * len(with_term)))
            if pmi >= 0.9 * math.log(len(texts) / len(docs)) - 1e-9:
                for i in with_term:
                    out[i].add(w)
    return out


def hidden_words(spans, text):
    places = [s.split(":") for s in spans.split(",") if s.startswith("term")]
    return {text[int(a):int(b)].lower() for _, a, b in places}


def test_terms_at_any_distance(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    texts = [f"Zorblat {some(30)} ann{i % 2}@x.org {some(30)} tail{i % 2}" for i in range(8)]
    texts += [f"head {some(20)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g["doc_id"]: g["spans"] for g in records(pii.pii_report(df))}
    by_hand = terms_by_hand(texts)
    for i, t in enumerate(texts[:8]):
        assert hidden_words(got[i], t) == {w for w in by_hand[i] if re.search(rf"(?i)(?<![\w@.]){w}(?![\w@.])", t)}
        assert f"tail{i % 2}" in hidden_words(got[i], t)
    one = spark.createDataFrame([(i, t.replace("ann1", "ann0")) for i, t in enumerate(texts)], "doc_id long, text string")
    assert all("term:0:7" in g["spans"].split(",") for g in records(pii.pii_report(one)) if g["doc_id"] < 8)


def test_terms_in_documents_without_the_value(spark):
    texts = [f"Quibble ann@x.org number{i}" for i in range(20)] + ["a quibble here", "A Quibble there"]
    texts += [f"plain text {i}" for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g["doc_id"]: g["spans"] for g in records(pii.pii_report(df))}
    by_hand = terms_by_hand(texts)
    assert by_hand[20] == by_hand[21] == {"quibble"}          # 20 of 22 documents with it have the value: above 0.9 of IC
    assert (got[20], got[21]) == ("term:2:9", "term:2:9")
    assert all("term:0:7" in got[i].split(",") for i in range(20))
    assert all(got[i] == "" for i in range(22, len(texts)))
    clean = {r["doc_id"]: r["sanitised"] for r in records(pii.sanitise(df))}
    assert clean[20] == "a xxxxxxx here" and clean[21] == "A Xxxxxxx there"


def test_running_sums(spark, monkeypatch):
    df = spark.createDataFrame([([],), ([5],), (list(range(700)),)], "a array<long>").select(running_sums(F.col("a")).alias("s"))
    for n, r in zip((0, 1, 700), df.collect()):
        a = [5] if n == 1 else list(range(n))
        assert r["s"] == [sum(a[:i]) for i in range(len(a))]


@pytest.mark.parametrize("report", [mixing.mix_report, mixing.mix, fingerprints.fingerprint_report, exact_dedup.exact_dedup_report,
                                    exact_dedup.exact_dedup, pii.pii_report, pii.sanitise])
def test_empty_table_and_clashing_columns(spark, report):
    assert report(no_documents(spark)).collect() == []
    assert len(report(documents(spark)).collect()) > 0
    assert len(SCHEMA.split(",")) == len(documents(spark).columns)


def test_empty_conversations(spark):
    assert chat.chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
