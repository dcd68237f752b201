"""The pipeline, stage by stage, on the smallest tables."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from tidegraph.llm import decontaminate, personal_data, simhash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_stages(spark):
    docs = corpus_pipeline.table(spark, DATA, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, DATA), name)
        kept.append(out.count())
        if name != "packing":
            assert out.columns == docs.columns
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in corpus_pipeline.table(spark, DATA, "labels").collect()}
            ids = {r["doc_id"] for r in out.collect()}
            good = [i for i, q in labels.items() if q]
            assert sum(i in ids for i in good) >= 0.97 * len(good)
            assert sum(i in ids for i, q in labels.items() if not q) <= 0.2 * max(1, len(labels) - len(good))
        if name == "near_duplicates":
            prints = [simhash.fingerprint(r["text"].encode()) for r in out.collect()]
            assert all((a ^ b).bit_count() > 4 for k, a in enumerate(prints) for b in prints[:k])
        if name == "decontamination":
            bench = corpus_pipeline.table(spark, DATA, "benchmark")
            assert decontaminate.find_contamination(out, bench).where("contaminated").count() == 0
        if name == "personal_data":
            assert all(not personal_data.base_spans(r["text"]) for r in out.collect())
        docs = out
    assert kept[0] >= kept[1] >= kept[2] == kept[3] <= kept[4]
    by = {}
    for r in docs.collect():
        by[r["doc_id"]] = by.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= 2048
    assert all(by[r["doc_id"]] == r["doc_tokens"] for r in docs.collect())
    assert corpus_pipeline.run(spark, DATA).count() == kept[4]


def test_registry():
    names = __spark_entry__.queries()
    assert [k for k in names if k.startswith("op")] == [k for k in names if k.startswith(tuple(f"op{n}_" for n in range(1, 11)))]
    assert sum(k.startswith("op") for k in names) == 10 and "pipeline" in names
    assert {"op1_decontamination", "op8_neighbours", "op10_chat"} <= __spark_entry__.oracle_sql().keys()
