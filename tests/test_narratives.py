"""Sentences in Python workers against Spark's expressions, and what is done once."""

import pytest
from pyspark.sql import functions as F

from chartweave.functions import narratives
from chartweave.operators import stays
from chartweave.operators import timeline as t
from chartweave.plans import corpus, flows, timelines

ODD = ["", " ", ".", "а. б.\nв", "а. б.  в\x0b.\n\n г\r\n.д", "﻿а. б\x85", "\x1cа.\x1f б", "конец.\n", "\n. .\n", "🙂. я", "Во время игр на 5-й день пел. Во время сна на 99999999999 день", None]


def test_sentences_as_in_spark(spark):
    for row in spark.createDataFrame([(x,) for x in ODD], "x string").select("x", stays.split_sentences(F.col("x")).alias("s")).collect():
        assert row.s == (None if row.x is None else narratives.split(row.x)), row.x


def test_context_of_odd_narratives(spark):
    days = spark.createDataFrame([(k, f"2024-01-0{n}", n) for k in range(len(ODD)) for n in range(1, 8)], "stay_id int, day string, day_number int").withColumn("day", F.to_date("day"))
    got = {(r.stay_id, r.day_number): r.context for r in t.context_for_day(spark.createDataFrame(list(enumerate(ODD)), "stay_id int, narrative string"), days).collect()}
    assert all(got[len(ODD) - 1, n] == got[0, n] == "" for n in range(1, 8)) and got[3, 2] == "а. б. в"
    assert got[10, 5] == "Во время игр на 5-й день пел." and got[10, 6] == got[10, 7] == ""


@pytest.mark.parametrize(("query", "patterns"), [(timelines.p19_context_for_day, 0), (timelines.p6_narrative_facts, 0)])
def test_rules_are_not_interpreted(spark, query, patterns):
    """Rules over sentences are not lambdas of patterns, which Spark interprets for every sentence."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == patterns


@pytest.mark.parametrize("query", [flows.c12_ingest_stats, flows.r16_recall_report])
def test_redacted_once(spark, query):
    """Who reads redacted notes more than once reads them from a table."""
    assert "run(" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_structured_notes_by_places(spark):
    assert corpus.r9_structured_notes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
