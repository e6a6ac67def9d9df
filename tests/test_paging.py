"""Pages by key against the offset form, searched titles against the scan."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.operators import history, paging


@pytest.fixture(scope="module")
def requests(spark):
    rng = np.random.default_rng(1)
    day = lambda k: None if k == 0 else dt.datetime(2024, 1, int(k))
    rows = [(int(i), int(rng.integers(0, 4)) if i % 11 else None, None, day(rng.integers(0, 9)), ["Urgent", "urgent call", None, "x"][i % 4], "m") for i in rng.permutation(230)]
    rows += [(1000 + i, None, int(rng.integers(0, 230)), day(3), "kid", "m") for i in range(150)]
    return spark.createDataFrame(rows, "id long, doctor_id long, parent_request_id long, created_at timestamp, title_safe string, llm_model_used string").repartition(5)


@pytest.mark.parametrize("order", [paging.NEWEST, [("created_at", False), ("id", False)], [("doctor_id", True), ("created_at", False), ("id", True)]])
def test_every_page_equals_the_offset_form(requests, order):
    rows = history.top_level_only(requests)
    whole = [r.id for r in rows.orderBy(*paging._sorted(order)).collect()]
    size, key = 40, None
    heads = {r.page: r for r in paging.page_directory(rows, None, order, size).collect()}
    assert len(heads) == 6 and {r.total for r in heads.values()} == {230} and sum(r.rows for r in heads.values()) == 230
    for p in range(7):
        want = whole[p * size : (p + 1) * size]
        after = paging.page_after(rows, order, key, size).collect()
        assert [r.id for r in after] == want
        assert [r.id for r in paging.page_of(rows, order, size, heads.get(p)).collect()] == want
        key = after[-1] if after else key


def test_directory_of_groups(requests):
    rows = history.top_level_only(requests)
    got = {(r.doctor_id, r.page): (r.total, r.rows, r.id) for r in paging.page_directory(rows, "doctor_id", paging.NEWEST, 7).collect()}
    want = {}
    for owner in (None, 0, 1, 2, 3):
        own = [r.id for r in rows.where(F.col("doctor_id").eqNullSafe(F.lit(owner))).orderBy(*paging._sorted(paging.NEWEST)).collect()]
        want |= {(owner, p // 7): (len(own), len(own[p : p + 7]), own[p]) for p in range(0, len(own), 7)}
    assert got == want
    assert paging.page_directory(rows.limit(0), "doctor_id", paging.NEWEST, 7).collect() == []


def test_pages_count_their_own_children(requests):
    key = None
    for offset in (0, 60, 120, 180, 240):
        want = history.history_list(requests, limit=60, offset=offset).collect()
        got = paging.history_after(requests, None, key, 60).collect()
        assert [(r.id, r.children_count, r.title_safe) for r in got] == [(r.id, r.children_count, r.title_safe) for r in want]
        key = got[-1] if got else key
    assert {r.doctor_id for r in paging.history_after(requests, 2, None, 60).collect()} == {2}


def test_a_page_keeps_no_sorted_table(requests):
    plan = paging.page_after(requests, paging.NEWEST, {"created_at": dt.datetime(2024, 1, 3), "id": 5}, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_titles_equal_the_scan(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcЖ "), n))
    rows = spark.createDataFrame([*((i, word(rng.integers(0, 14)), "clash") for i in range(300)), (300, None, "x"), (301, "Straße ABC", "x"), (301, "Straße ABC", "x")], "id long, title_safe string, gram string")
    asked = sorted({word(rng.integers(1, 6)) for _ in range(60)}) + ["STRASSE", "straße", " abc ", "zzz", "", None, "ABC"]
    index = paging.title_index(rows)
    got = paging.search_many_titles(rows, index.distinct(), spark.createDataFrame([(q,) for q in asked], "query string")).collect()
    want = []
    for q in {(q or "").strip().lower() for q in asked if q is not None}:
        want += [(q, r.id, r.title_safe) for r in history.search_titles(rows.drop("gram"), q).collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    found = paging.title_candidates(index.distinct(), spark.createDataFrame([("abcab",)], "query string")).count()
    assert found < rows.count() / 4
