"""The pipeline against a brute-force version of its stages."""

import re

import corpus_pipeline
from docquarry.llm import mixing, queries
from test_python import brute_classes, check_packing, reference_ids


def test_pipeline_by_brute_force(spark, data):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    good = {r["doc_id"] for r in queries.op1_quality_rules(spark, data).collect() if r["kept"]}
    first = {}
    for d in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d]["text"] or ""), d)
    alone = sorted(first.values())
    near = brute_classes([(d, rows[d]["text"]) for d in alone])
    kept = [d for d in alone if near[d][0] == d]
    docs = spark.createDataFrame([rows[d] for d in kept], spark.read.parquet(f"{data}/documents.parquet").schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = corpus_pipeline.run(spark, data).collect()
    ids = dict(zip(kept, reference_ids([rows[d]["text"] for d in kept]), strict=True))
    assert sum(r["length"] for r in out) == sum(copies[d] * len(ids[d]) for d in kept)
    assert {r["doc_id"] for r in out} == {d for d in kept if copies[d]}
    once = [d for d in kept if copies[d] == 1]
    check_packing([r for r in out if r["doc_id"] in set(once)], [], 4096)
    for d in once:
        assert sorted((r["start"], r["length"]) for r in out if r["doc_id"] == d) == [(k, min(4096, len(ids[d]) - k)) for k in range(0, len(ids[d]), 4096)]


def test_stages_return_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name
