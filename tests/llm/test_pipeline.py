"""The pipeline against its stages done by hand, and the registered queries."""

import re
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from panelcast.llm import mixing
from panelcast.llm.langid import keep_identified
from panelcast.llm.queries import QUERIES, SQL

from .fixtures import documents, no_documents, records, rows
from .test_arrow import connected_by_hand

SF = "/root/testdata/sf0.001"
GAP = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))
    assert set(SQL) <= set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_equals_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = records(corpus_pipeline.run(spark, SF))
    kept = sorted(((r["doc_id"], r["text"], r["source"]) for r in records(keep_identified(docs))), key=lambda r: r[0])
    assert len(kept) >= 0.99 * docs.count()
    exact, seen = [], set()
    for r in kept:
        norm = GAP.sub(" ", r[1])
        if norm not in seen:
            seen.add(norm)
            exact.append(r)
    near = [exact[g[0]] for g in connected_by_hand([(r[0], r[1]) for r in exact])]
    report = {g["doc_id"]: g["taken"] for g in records(mixing.mix_report(spark.createDataFrame(near, "doc_id long, text string, source string")))}
    words = Counter()
    for g in got:
        words[g["doc_id"]] += len(WORD.findall(g["text"]))
    assert +words == +Counter(report)
    lib = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    text = {r[0]: r[1] for r in near}
    for g in got:
        assert g["token_ids"] == lib.encode(g["text"], add_special_tokens=False).ids
        assert g["n_tokens"] == len(g["token_ids"]) and g["round_trip"]
        assert text[g["doc_id"]].startswith(g["text"]) and g["n_chars"] == len(g["text"])


def test_stages_take_awkward_and_empty_tables(spark):
    for source, n in ((documents(spark), len(rows())), (no_documents(spark), 0)):
        docs = source
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == source.columns
                docs = spark.createDataFrame(docs.collect(), source.schema)
        left = records(docs)
        assert (len(left) > 0) == (n > 0)
        by_id = defaultdict(int)
        for r in left:
            by_id[r["doc_id"]] += 1
