"""Spelling variants against brute force over all pairs, and odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.llm import spelling

DOCS = "doc_id long, text string, word string, N long, _id long, _run string, key string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute(rows, ratio=10):
    n = Counter()
    lower = str.maketrans(spelling._UPPER, spelling._LOWER)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(docs):
    out = spelling.spelling_forms(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def crowded():
    """Words over few letters, many edits of one another, of very uneven frequency."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abÀÿ×"), k)) for k in rng.integers(7, 11, 500)]
    words += ["hypertension", "hypertensoin", "hypertensio", "hypertensionn", "Hypertention"] + ["x" * 3000, "x" * 2999 + "y", "x" * 3001]
    rows = []
    for i in range(60):
        rows.append((i, " ".join([*rng.choice(words[:500], 90), *(["hypertension"] * 20), *words[500:][i % 8 : i % 8 + 1]])))
    return [*rows, (None, "hypertension hypertensio"), (3, None), (4, ""), (5, "short x " * 9), rows[0], rows[0], (70, "aaaaaaa " * 1200), (71, "aaaaaab " * 110), (72, "aaaaabb " * 9)]


@pytest.mark.parametrize("bucket_rows", [256, 8])
def test_equals_brute_force(spark, crowded, monkeypatch, bucket_rows):
    monkeypatch.setattr(spelling, "BUCKET_ROWS", bucket_rows)
    docs = spark.createDataFrame([(i, t, "w", 1, 2, "r", "k") for i, t in crowded], DOCS).repartition(3)
    expected = brute(crowded)
    assert found(docs) == expected
    assert any(f for _, f, *_ in expected) and any(r != f for _, f, r, *_ in expected if f), "forms and chains occur"


def test_large_buckets_by_shuffle_and_small_steps(spark, crowded, monkeypatch):
    monkeypatch.setattr(spelling, "BUCKET_ROWS", 8)
    monkeypatch.setattr(spelling, "_FEW", 0)
    monkeypatch.setattr(spelling, "_CELLS", 64)
    assert found(spark.createDataFrame([(i, t, "w", 1, 2, "r", "k") for i, t in crowded], DOCS)) == brute(crowded)


def test_buckets_stay_small(spark):
    """A family of thousands of words that share both ends: no bucket keeps more than the bound, no link is lost."""
    letters = "abcdefghij"
    words = [f"pre{x}{y}{z}fixes" for x in letters for y in letters for z in letters]
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    near = {r.word: r.n_near for r in spelling.near_words(table).collect()}
    assert len(near) == 1000 and set(near.values()) == {27}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert found(none) == set() and found(spark.createDataFrame([(1, None, "", 1, 1, "", "")], DOCS)) == set()
    with pytest.raises(ValueError):
        spelling.spelling_forms(none, ratio=2)


def test_misspell(spark):
    rows = [(i, f"beispiele{chr(97 + i % 26)}é") for i in range(300)]
    got = spark.createDataFrame(rows, "i long, w string").select("i", "w", spelling.misspell(F.col("i"), F.col("w")).alias("m")).collect()
    for r in got:
        h = zlib.crc32(f"{r.i}:{r.w}".encode())
        assert r.m == (r.w if h % 31 else r.w[: h % len(r.w)] + r.w[h % len(r.w) + 1 :])
    assert any(r.m != r.w for r in got)
