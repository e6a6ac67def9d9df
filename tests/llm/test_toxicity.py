"""Character n-gram classifier against plain Python, known labels and odd tables."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.llm import entries, toxicity

DOCS = "doc_id long, text string, Score double, Predicted string, label int, _id long"


def grams(text):
    """Runs of 3 to 6 characters of the lower-cased text, where one space stands between letters."""
    out = " "
    for c in text.replace("\0", " ").lower():
        if "a" <= c <= "z" or ord(c) >= 0xC0:
            out += c
        elif out[-1] != " ":
            out += " "
    return {out[i : i + n] for n in toxicity.SIZES for i in range(len(out) - n + 1)}


def bucket(gram):
    code = 0
    for c in gram:
        code = (code * toxicity._BASE + ord(c)) % 2**64
    return (code ^ (code >> 29)) * toxicity._SPREAD % 2**64 >> (64 - toxicity.BITS)


TEXTS = ["", "a", "The IDIOT!! spoke", "x\0y  zz%%%abc", "ÉCOLE réeux 12 été", "ab" * 40, "привет мир", "  ", "🙂 hello"]


@pytest.mark.parametrize("step", [1 << 18, 8])
def test_features_equal_plain_python(monkeypatch, step):
    monkeypatch.setattr(toxicity, "_STEP", step)
    row, found = toxicity.features(TEXTS)
    for i, text in enumerate(TEXTS):
        own = found[row == i]
        assert len(own) == len(set(own)) and set(own) == {bucket(g) for g in grams(text)}
    wanted = np.zeros(toxicity.BUCKETS, bool)
    wanted[[bucket(g) for g in grams("the idiot")]] = True
    row, some = toxicity.features(TEXTS, wanted)
    assert set(some) == set(found[wanted[found]])


def test_counts_and_ratios(spark):
    rows = [(i, int("idiot" in t), t) for i, t in enumerate(["an idiot here", "the idiot", "a plain text", "plain", "", "idiot idiot"])]
    counts = {r.bucket: (r.toxic, r.clean) for r in toxicity.feature_counts(spark.createDataFrame(rows, "doc_id long, label int, text string").repartition(3)).collect()}
    for gram in set().union(*(grams(t) for *_, t in rows)):
        same = [(y, t) for _, y, t in rows if bucket(gram) in {bucket(g) for g in grams(t)}]
        assert counts[bucket(gram)] == (sum(y for y, _ in same), sum(1 - y for y, _ in same))
    ratio = toxicity.log_count_ratios(np.array([9.0, 3, 0]), np.array([1.0, 0, 9]), 10, 20)
    assert ratio[0] == pytest.approx(math.log(10 / 12) - math.log(2 / 22)) and ratio[1] == 0 and ratio[2] < 0


def test_regression_reaches_the_optimum():
    """The gradient of the ridge loss, written out densely, vanishes."""
    rng = np.random.default_rng(1)
    dense = rng.random((60, 12)) < 0.4
    dense[:, 0] |= ~dense.any(axis=1)
    y, ratio = (dense[:, 2] ^ (rng.random(60) < 0.1)).astype(float), rng.normal(size=12)
    weight = np.full(60, 1 / 60)
    w, b = toxicity._regress(toxicity._Sparse(dense.sum(axis=1), np.concatenate([np.flatnonzero(d) for d in dense]).astype(np.int32), ratio), y, weight, 3000)
    x = dense * ratio * (dense.sum(axis=1) ** -toxicity.DAMPING)[:, None]
    pull = weight * (y - 1 / (1 + np.exp(-(x @ w + b))))
    assert np.abs(x.T @ pull - toxicity.RIDGE * w).max() < 1e-4 and abs(pull.sum()) < 1e-4


def test_odd_tables(spark):
    long = "you idiot " + "word " * 60000
    texts = [None, "", "you idiot and clown", "a fair day", long, "a fair day", "a fair day"]
    docs = spark.createDataFrame([(i, t, 9.0, "x", 5, 1) for i, t in enumerate(texts)] + [(None, "you idiot", 0.0, None, None, None), (5, "zzz", 0.0, "x", None, None)], DOCS)
    labels = spark.createDataFrame([(i, int(i in (2, 4)), 1) for i in range(7)] + [(2, 0, 1), (None, 1, 1), (3, None, 0), (3, 7, 0)], "doc_id long, toxic int, quality int")
    scored = toxicity.score_documents(docs, toxicity.fit_on_labels(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert len({r.score for r in scored if r.text == "a fair day"}) == 1
    for none in (labels.limit(0), labels.where("toxic = 0")):
        share = {round(r.score, 9) for r in toxicity.score_documents(docs, toxicity.fit_on_labels(docs, none)).collect()}
        assert share == ({0.5} if none.isEmpty() else {0.01})
    assert toxicity.score_documents(docs.limit(0), toxicity.even_model(0.3)).collect() == []
    assert toxicity.fit_on_labels(docs.limit(0), labels).weights.sum() == 0


def test_registered_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = entries.op13_toxicity(spark, sf)
    assert [f.dataType.typeName() for f in scored.schema][:4] == ["long", "boolean", "double", "integer"]
    known = scored.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left").toPandas()
    assert len(known) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (known.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in known.doc_id]).all()
    part = known[known.held_out & known.toxic.notna()]
    hit, y = part.predicted == 1, part.toxic == 1
    assert (hit & y).sum() / y.sum() >= 0.8 and (hit & y).sum() / hit.sum() >= 0.9
    rank = part.score.rank()
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) >= 0.95


def test_held_out_labels_are_not_used(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_on_labels(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.base) == (b.slope, b.base)
