"""Exact filtered retrieval against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.operators import retrieval

FIELDS = retrieval.FIELDS
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", extra string"


def brute(queries, points, k):
    out = set()
    for q in queries:
        rows = []
        for p in points:
            if all(a is None or a == b for a, b in zip(q[2], p[2], strict=True)):
                a, b = np.array(q[1]), np.array(p[1])
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                rows.append((-round(float(a @ b / norm), 9) if norm else 0.0, p[0]))
        out |= {(q[0], i + 1, p, -s) for i, (s, p) in enumerate(sorted(rows)[:k])}
    return out


def table(spark, rows, name):
    return spark.createDataFrame([(i, v, *f, "x") for i, v, f in rows], f"{name} {'string' if rows and isinstance(rows[0][0], str) else 'long'}, embedding array<double>, {SCHEMA}")


def found(df):
    return {(r.query_id, r["rank"], r.point_id, round(r.score, 9) + 0.0) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 4
    pick = lambda options: options[rng.integers(len(options))]
    fields = lambda: (pick(["daily", "exam"]), pick(["s1", "s2", None]), pick(["F20x", "F32x"]), pick(["full", ""]))
    points = [(i, (centres[i % 6] + rng.normal(size=8) * 0.1).tolist(), fields()) for i in range(700)]
    points += [(700 + i, points[i][1], points[i][2]) for i in range(40)] + [(800, [0.0] * 8, fields()), (801, [0.0] * 8, fields())]
    free = lambda v: None if rng.random() < 0.5 else v
    queries = [(i, points[i * 7][1], tuple(map(free, fields()))) for i in range(60)] + [(60, [0.0] * 8, (None,) * 4), (61, points[3][1], (None,) * 4), (62, points[3][1], ("nothing", None, None, None))]
    return queries, points


@pytest.mark.parametrize(("rows", "per_pivot", "held", "part"), [(1024, 2048, 32768, 256), (16, 60, 90, 2)])
def test_equals_brute_force(spark, clustered, monkeypatch, rows, per_pivot, held, part):
    for name, value in (("TILE_ROWS", rows), ("POINTS_PER_PIVOT", per_pivot), ("HELD_ROWS", held), ("SLICE", part)):
        monkeypatch.setattr(retrieval, name, value)
    queries, points = clustered
    q, p = table(spark, queries, "query_id").repartition(2), table(spark, points, "point_id").repartition(3)
    for k in (1, 7):
        assert found(retrieval.cosine_top_k(q, p, k)) == brute(queries, points, k)


def test_tiles_are_dropped_exactly(spark, clustered, monkeypatch):
    monkeypatch.setattr(retrieval, "POINTS_PER_PIVOT", 60)
    queries, points = clustered
    apart = [(i, v, (None,) * 4) for i, v, _ in queries if any(v)]
    plain = [(i, v, (None,) * 4) for i, v, _ in points if any(v)]
    _, _, pairs, _ = retrieval.plan_search(table(spark, apart, "query_id"), table(spark, plain, "point_id"), 5)
    share = retrieval.scored_share(pairs).first()
    assert share["pairs"] == len(apart) * len(plain) and share["scored"] < 0.5 * share["pairs"] and share["share"] == share["scored"] / share["pairs"]


def test_odd_vectors_take_no_part(spark):
    none = (None,) * 4
    rows = [(1, [1.0, 0.0], none), (2, None, none), (3, [1.0, None], none), (4, [], none), (5, [0.6, 0.8], none), (6, [1.0, 2.0, 3.0], none), (7, [float("nan"), 1.0], none), (8, [float("inf"), 1.0], none), (None, [1.0, 0.0], none)]
    q, p = table(spark, rows, "query_id"), table(spark, rows, "point_id")
    assert {(r.query_id, r.point_id) for r in retrieval.cosine_top_k(q, p).collect()} == {(1, 1), (1, 5), (5, 5), (5, 1)}
    for a, b in ((q.limit(0), p), (q, p.limit(0)), (q.where("query_id IN (2, 4)"), p), (q, p.where("point_id IN (2, 4)"))):
        got = retrieval.cosine_top_k(a, b)
        assert got.columns == ["query_id", "rank", "point_id", "score"] and got.collect() == []
        assert retrieval.retrieve_with_fallback(a, b).collect() == []


def test_text_ids_and_ties(spark):
    none = (None,) * 4
    points = [(f"p{i:02}", [1.0, float(i % 2)], none) for i in range(12)]
    queries = [("q", [1.0, 0.0], none)]
    assert found(retrieval.cosine_top_k(table(spark, queries, "query_id"), table(spark, points, "point_id"), 4)) == brute(queries, points, 4)


def test_first_level_that_is_not_empty(spark):
    full = ("daily", "s1", "F20x", "full")
    points = [(1, [1.0, 0.0], full), (2, [0.0, 1.0], ("daily", "s2", "F20x", "part")), (3, [1.0, 1.0], ("exam", "s1", None, None))]
    queries = [
        (1, [1.0, 0.0], full),
        (2, [1.0, 0.0], ("daily", "s9", "F20x", "full")),
        (3, [1.0, 0.0], ("daily", "s9", "F99x", None)),
        (4, [1.0, 0.0], ("daily", "s9", "", "")),
        (5, [1.0, 0.0], ("none", None, None, None)),
        (6, [1.0, 0.0], ("", "", "", "")),
    ]
    got = {}
    for r in retrieval.retrieve_with_fallback(table(spark, queries, "query_id"), table(spark, points, "point_id")).collect():
        got.setdefault((r.query_id, r.level), set()).add(r.point_id)
    assert got == {(1, 0): {1}, (2, 1): {1, 2}, (4, 1): {1, 2}, (5, 3): {1, 2, 3}, (6, 0): {1, 2, 3}}


def test_joins_are_by_equality(spark, clustered):
    queries, points = clustered
    q, p = table(spark, queries, "query_id"), table(spark, points, "point_id")
    for df in (retrieval.chosen_level(q, p), retrieval.retrieve_with_fallback(q, p)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tiles_are_full(spark, monkeypatch):
    """As many tiles as vectors need, not one for each task, facet and pivot; rows of the last step grow by blocks."""
    monkeypatch.setattr(retrieval, "POINTS_PER_PIVOT", 50)
    rng = np.random.default_rng(7)
    points = [(i, rng.normal(size=8).tolist(), ("daily", f"s{i % 5}", f"F{i % 10}x", "full")) for i in range(2000)]
    asked = [(i, v, (None,) * 4) for i, v, _ in points[:200]] + [(1000 + i, v, ("daily", None, f, None)) for i, v, (_, _, f, _) in points[:50]]
    made, stored, pairs, _ = retrieval.plan_search(table(spark, asked, "query_id").repartition(4), table(spark, points, "point_id").repartition(8), 7)
    # one copy a mask in use; 40 pivots without a filter, 4 for each class
    assert stored.agg(F.sum("n")).first()[0] == 4000 and stored.count() <= 80 and made.count() <= 80
    assert pairs.count() <= 40 * 40 + 40 * 4
    assert pairs.select("a_block", "s_block").distinct().count() <= 40
