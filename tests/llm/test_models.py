"""Quality and language models: held-out accuracy, what they may learn from, odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellgrid.llm import language, quality
from tests.llm.cases import no_documents, odd_documents

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@needs_tables
def test_quality_on_held_out_documents(spark, tables):
    docs, labels = tables
    model = quality.fit_quality(docs, labels)
    found = quality.score_documents(docs, model).join(labels, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == is_held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_documents(docs, model).where("predicted = 1").collect()}


@needs_tables
def test_held_out_labels_and_other_columns_change_nothing(spark, tables):
    docs, labels = tables
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.score_documents(docs, quality.fit_quality(docs, labels)).orderBy("doc_id").collect()
    b = quality.score_documents(other, quality.fit_quality(other.repartition(3), flipped)).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in a], [r.score for r in b], atol=1e-9)


def test_quality_of_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 21)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert len({r.score for r in rows if r.doc_id in (5, 6, 7)}) == 1
    assert quality.fit_quality(docs, labels.limit(0)) is None
    assert {(r.score, r.predicted) for r in quality.score_documents(docs, None).collect()} == {(0.5, 0)}
    assert quality.keep_good(docs, None).count() == docs.count()
    assert quality.score_documents(no_documents(spark), model).count() == 0


def test_word_vectors_do_not_cross_texts():
    index = quality.index_vectors()
    together, apart = (np.zeros_like(index) for _ in range(2))
    texts = [b"one two three", b"", b"four five", b"six"]
    quality.contexts(texts, index, together)
    for text in texts:
        quality.contexts([text], index, apart)
    assert (together == apart).all() and together.any()
    assert (quality.pooled(texts, together)[[1]] == 0).all()


def test_long_text_is_pooled_whole():
    index = quality.index_vectors()
    words = [f"w{i}" for i in range(90_000)]
    whole = quality.pooled([" ".join(words).encode()], index)[0]
    plain = [quality.pooled([w.encode()], index)[0] for w in words[:2000]]
    assert np.allclose(quality.pooled([" ".join(words[:2000]).encode()], index)[0], np.mean(plain, axis=0), atol=1e-3)
    assert not np.allclose(whole, np.mean(plain, axis=0), atol=1e-3)


@needs_tables
def test_languages_of_held_out_documents(spark, tables):
    docs, _ = tables
    net = language.fit_languages(docs)
    found = language.predict_languages(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == is_held(r.doc_id) and 0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    # language and source of the held-out part, and the source of all, change nothing
    other = docs.withColumn("source", F.lit("x")).withColumn(
        "lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    again = language.predict_languages(other, language.fit_languages(other)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in again) == sorted((r.doc_id, r.lang_pred) for r in found)


def test_languages_of_odd_documents(spark):
    docs = odd_documents(spark)
    net = language.fit_languages(docs)
    rows = language.predict_languages(docs, net).collect()
    texts = {r.row: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and set(net.languages) == {"de", "en"}
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (5, 6, 7, 17):  # null, empty, blank, digits only
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("de", "en")
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit_languages(nothing) is None and language.fit_languages(no_documents(spark)) is None
    assert {(r.lang_pred, r.score) for r in language.predict_languages(docs, None).collect()} == {("und", 0.0)}
    assert language.predict_languages(no_documents(spark), net).count() == 0


def test_windows_cover_whole_texts():
    texts = [b"a" * 600, b"", b"b" * 256, b"c"]
    rows, filled, counts = language.windows(texts)
    assert counts.tolist() == [3, 0, 1, 1] and filled.tolist() == [256, 256, 88, 256, 1]
    assert (rows != 0).sum(axis=1).tolist() == [256, 256, 88, 256, 1]


def test_table_lookup_equals_convolution():
    net = language.ByteConvNet(["a", "b", "c"])
    rows = np.random.default_rng(3).integers(0, 256, (5, 40)).astype(np.uint8)
    hidden = []
    for table, width in zip(net.filters, language.WIDTHS):
        out = sum(table[k][rows[:, k:k + 37]] for k in range(width))
        hidden.append(out.max(axis=1))
    want = language.softmax(np.maximum(np.concatenate(hidden, axis=1) + net.bias, 0) @ net.dense + net.shift)
    assert np.allclose(net.predict(rows, net.tables()), want, atol=1e-5)


def test_columns_with_the_names_used_inside(spark, tables):
    docs, labels = tables
    names = ["id", "s_id", "s_lang", "s_draw", "draw", "bucket", "place", "part", "label", "row", "held_out", "score", "vector"]
    wide = docs.select("*", *(F.lit(7).alias(n) for n in names))
    net, plain_net = language.fit_languages(wide), language.fit_languages(docs)
    want = sorted(map(tuple, language.predict_languages(docs, plain_net).collect()))
    assert sorted(map(tuple, language.predict_languages(wide, net).collect())) == want
    wide_labels = labels.select("*", *(F.lit(7).alias(n) for n in names))
    want = sorted(map(tuple, quality.score_documents(docs, quality.fit_quality(docs, labels)).collect()))
    assert sorted(map(tuple, quality.score_documents(wide, quality.fit_quality(wide, wide_labels)).collect())) == want
