"""The pipeline stage by stage on the smallest tables, and on none."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dwellgrid.llm import bpe
from dwellgrid.session import scratch_path
from tests.llm.test_groups import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage-test")
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() > 0
        if name == "exact dedup":
            keys = [hashlib.md5("".join((r.text or "").split()).encode()).digest() for r in before.collect()]
            assert docs.count() == len(set(keys))
        if name == "near-duplicate removal":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {d for d, _, _, k in brute_components(rows) if k}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id")
    assert kept["quality classifier"].join(labels, "doc_id").count() <= 3
    mixed = kept["mixing to target weights"]
    assert kept["BPE encoding"].count() == mixed.count()
    tokens = bpe.token_digests(bpe.encode_documents(mixed)).agg(F.sum("n_tokens")).first()[0]
    assert tokens == kept["BPE encoding"].agg(F.sum("n_tokens")).first()[0]


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_stages_without_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
