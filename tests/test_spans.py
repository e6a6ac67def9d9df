"""Spans in Spark expressions against the Python pass and against re."""

import re

import numpy as np
from pyspark.sql import functions as F

from chartweave.functions import personal_data as known
from chartweave.functions.boundaries import compiled, java
from chartweave.operators import redaction as r
from chartweave.operators import spans
from tests.test_redaction import pieces


def test_resolved_as_in_python(spark):
    rng = np.random.default_rng(11)
    kinds = [None, *known.PRIORITY]
    rows = []
    for k in range(600):
        own = []
        for nth in range(rng.integers(0, 9)):
            start = int(rng.integers(0, 20))
            kind = kinds[rng.integers(len(kinds))]
            own.append((start, start + int(rng.integers(1, 9)), kind, known.PRIORITY.get(kind, 10), nth))
        rows.append((k, own))
    table = spark.createDataFrame([*rows, (-1, None)], f"k int, spans array<{spans.SPAN}>")
    for row in table.select("k", spans.resolve_spans(F.col("spans")).alias("kept")).collect():
        if row.k < 0:
            assert row.kept is None
            continue
        assert [tuple(x) for x in row.kept] == [tuple(x) for x in r.resolve([r.Span(*x[:3]) for x in rows[row.k][1]])]


def test_places_of_matches(spark):
    rng = np.random.default_rng(12)
    texts = [pieces(rng) for _ in range(300)] + ["", "12", "🙂12🙂34"]
    for name in ("date_numeric", "phone", "bare_long_id", "date_textual"):
        pattern = known.DETECTORS[name][1]
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.match_spans(F.col("t"), java(pattern), "date", 3).alias("s")).collect()
        for row in got:
            assert [(x.start, x.end) for x in row.s] == [m.span() for m in compiled(pattern).finditer(row.t)]
            assert all((x.kind, x.priority, x.nth) == ("date", 60, 3) for x in row.s)


def structured(text):
    """The Python pass without names and institutions."""
    red = r.Redactor(known.Lexicon((), (), (), frozenset()))
    red.name_spans = lambda _: ()
    return red.redact(text)


def test_redacted_as_in_python(spark):
    rng = np.random.default_rng(13)
    texts = [re.sub(r"[\tİ²٣]", " ", pieces(rng)) for _ in range(400)] + ["", "plain", "🙂 14 лет 🙂 8 812 123-45-67 🙂", "F20.0 25 мг 01.02.2024"]
    table = spark.createDataFrame([(t, 1, "x") for t in [*texts, None]], "text string, removed_count int, kinds string")
    done = spans.redact_structured(table.withColumn("was", F.col("text")))
    assert not re.search("Python|Arrow|Exchange", done._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", ""))
    for row in done.collect():
        want, counts = structured(row.was or "")
        assert (row.text, row.removed_by_type, row.removed_count) == (want, counts, sum(counts.values())), row.was
    assert done.limit(0).collect() == []
