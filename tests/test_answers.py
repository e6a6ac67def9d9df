from chartweave.operators import answers as a
from chartweave.plans import answers as plan
from chartweave.plans.answers import config


def test_faults_of_a_schema(spark):
    q, o, c = config(spark)
    assert a.check_schema(q, o, c).count() == 0
    twice = q.unionByName(q.where("qid = 'syndrome'"))
    odd = spark.createDataFrame([("dynamics", "Z", "sleep"), ("dynamics", "", "sleep"), ("sleep", "F", "gone"), ("flag", "true", "sleep")], c.schema)
    flag = spark.createDataFrame([("daily", 9, "flag", "Flag", "boolean", False, None, None), ("daily", 10, "bare", "Bare", "select", False, None, None)], q.schema)
    found = {(r.problem, r.qid, r.detail) for r in a.check_schema(twice.unionByName(flag), o, odd).collect()}
    assert found == {("duplicate_id", "syndrome", "daily"), ("no_options", "bare", "select"), ("dangling_child", "sleep", "gone"), ("empty_trigger", "dynamics", "sleep"), ("unknown_trigger", "dynamics", "Z")}


def test_response_without_answers(spark):
    q, o, c = config(spark)
    responses = spark.createDataFrame([(1, "daily"), (2, "unknown")], "response_id long, doc_type string")
    none = spark.createDataFrame([], "response_id long, doc_type string, qid string, idx int, kind string, code string, custom_text string")
    states = a.question_states(responses, none, q, c)
    assert {r.qid for r in states.where("visible").collect()} == {"dynamics", "syndrome", "behaviour"}
    report = a.completeness_report(none, states).collect()
    assert [(r.response_id, r.answered, r.total, r.missing) for r in report] == [(1, 0, 3, ["dynamics", "syndrome", "behaviour"])]
    assert a.map_answers(none, q, o).count() == 0


def test_parts_of_answers_grow_with_their_file(spark):
    """A task's rows of answers stay few: parts follow the file's, not the session's setting alone."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").rdd.getNumPartitions()
    rows = plan.answers(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 16 * lines
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # lines and orders, none behind
