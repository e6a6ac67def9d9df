"""Queries of chartweave.operators.answers over the driver's tables, and their SQL.

Orders stand for responses, line items for answers; the questionnaire is configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.operators import answers as a
from chartweave.plans.history import table

#: Parts that answers are dealt into for each part that their file is read in (128 MB at most).
PARTS = 16
QUESTIONS = [
    ("daily", 1, "dynamics", "Dynamics", "select", True, "N", None),
    ("daily", 2, "syndrome", "Syndrome", "select", True, None, None),
    ("daily", 3, "behaviour", "Behaviour", "multiselect", True, None, "Seen: "),
    ("daily", 4, "sleep", "Sleep", "select", True, "O", None),
    ("daily", 5, "diagnosis", "Diagnosis", "text", True, None, None),
    ("exam_10d", 1, "dynamics", "Dynamics", "select", True, "A", None),
    ("exam_10d", 2, "behaviour", "Behaviour", "multiselect", False, None, "Over ten days: "),
    ("exam_10d", 3, "sleep", "Sleep", "select", False, None, None),
]
OPTIONS = [("dynamics", "N", "no change"), ("dynamics", "A", "better"), ("dynamics", "R", "worse"), ("syndrome", "0", "anxious picture"), ("behaviour", "N", "calm"), ("behaviour", "A", "restless"), ("sleep", "O", "sleeps well"), ("sleep", "F", "sleeps badly")]
CONDITIONS = [("dynamics", "R", "sleep"), ("dynamics", "A", "sleep"), ("sleep", "F", "diagnosis")]
CODES = [("dynamics", "A", "dynamics", "slight_gain"), ("dynamics", "R", "dynamics", "loss"), ("syndrome", "0", "syndrome", "Anxious kind")]
STEMS = [("anxi", "anxiety"), ("anxious-", "anxious")]


def config(spark):
    q = spark.createDataFrame(QUESTIONS, "doc_type string, ord int, qid string, label string, qtype string, required boolean, default string, multi_prefix string")
    return q, spark.createDataFrame(OPTIONS, "qid string, value string, phrase string"), spark.createDataFrame(CONDITIONS, "parent_qid string, if_value string, child_qid string")


def _values(rows) -> str:
    def one(x):
        return "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else f"'{x}'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def responses(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("response_id"), F.when(F.col("o_custkey") % 4 == 0, "exam_10d").otherwise("daily").alias("doc_type"))


def answers(spark, d):
    """One entry for lines 1, 2, 4 and 5 of an order; the other lines are a multiple choice."""
    lines = table(spark, d, "lineitem")
    # entries of a response stay together from here on; parts grow with the input, so that a task's rows do not
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * lines.rdd.getNumPartitions())
    asked = lines.repartition(parts, "l_orderkey").join(responses(spark, d), F.col("l_orderkey") == F.col("response_id"))
    qid = F.when(F.col("l_linenumber") == 1, "dynamics").when(F.col("l_linenumber") == 2, "syndrome").when(F.col("l_linenumber") == 4, "sleep").when(F.col("l_linenumber") == 5, "diagnosis").otherwise("behaviour")
    idx = F.when(qid == "behaviour", F.when(F.col("l_linenumber") == 7, 9).otherwise(F.ascii("l_returnflag") % 3)).otherwise(0)
    rows = asked.groupBy("response_id", "doc_type", qid.alias("qid"), idx.cast("int").alias("idx")).agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("state"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    own = ((F.col("qid") == "syndrome") & (F.col("p") % 3 > 0)) | (F.col("idx") == 9)
    code = F.when(F.col("qid") == "syndrome", F.lit("0")).when(F.col("qid") == "sleep", F.col("state")).when(F.col("qid") == "diagnosis", F.concat(F.lit(" x f"), (F.col("s") % 10).cast("string"), F.lit("0 "))).otherwise(F.col("flag"))
    words = F.when(F.col("idx") == 9, F.lit("extra")).when(F.col("p") % 3 == 1, F.lit("  Anxious-like ")).otherwise(F.lit("  "))
    return rows.select("response_id", "doc_type", "qid", "idx", F.when(own, "custom").otherwise("code").alias("kind"), F.when(~own, code).alias("code"), F.when(own, words).alias("custom_text"))


BASE = f"""WITH questions(doc_type, ord, qid, label, qtype, required, dflt, multi_prefix) AS (VALUES {_values(QUESTIONS)}), options(qid, value, phrase) AS (VALUES {_values(OPTIONS)}),
 responses AS (SELECT o_orderkey AS response_id, CASE WHEN o_custkey % 4 = 0 THEN 'exam_10d' ELSE 'daily' END AS doc_type FROM orders),
 raw AS (SELECT response_id, doc_type, CASE l_linenumber WHEN 1 THEN 'dynamics' WHEN 2 THEN 'syndrome' WHEN 4 THEN 'sleep' WHEN 5 THEN 'diagnosis' ELSE 'behaviour' END AS qid,
  CASE WHEN l_linenumber IN (1, 2, 4, 5) THEN 0 WHEN l_linenumber = 7 THEN 9 ELSE ascii(l_returnflag) % 3 END AS idx, min(l_returnflag) AS flag, min(l_linestatus) AS state, min(l_partkey) AS p, min(l_suppkey) AS s
  FROM lineitem JOIN responses ON l_orderkey = response_id GROUP BY 1, 2, 3, 4),
 own AS (SELECT *, (qid = 'syndrome' AND p % 3 > 0) OR idx = 9 AS own FROM raw),
 answers AS (SELECT response_id, doc_type, qid, idx, CASE WHEN own THEN 'custom' ELSE 'code' END AS kind,
  CASE WHEN NOT own THEN CASE qid WHEN 'syndrome' THEN '0' WHEN 'sleep' THEN state WHEN 'diagnosis' THEN ' x f' || (s % 10) || '0 ' ELSE flag END END AS code,
  CASE WHEN own THEN CASE WHEN idx = 9 THEN 'extra' WHEN p % 3 = 1 THEN '  Anxious-like ' ELSE '  ' END END AS custom_text FROM own),
 good AS (SELECT *, trim(coalesce(custom_text, code)) AS said FROM answers WHERE trim(coalesce(custom_text, code)) <> ''),
 facts AS (SELECT r.response_id, r.doc_type, coalesce(bool_or(qid = 'dynamics' AND code IN ('A', 'R')), false) AS awake, coalesce(bool_or(qid = 'sleep' AND code = 'F'), false) AS bad FROM responses r LEFT JOIN answers x ON r.response_id = x.response_id GROUP BY 1, 2),
 states AS (SELECT response_id, f.doc_type, qid, ord, required, CASE qid WHEN 'sleep' THEN awake WHEN 'diagnosis' THEN awake AND bad ELSE true END AS visible FROM facts f JOIN questions q ON f.doc_type = q.doc_type)"""


def _states(spark, d):
    q, _, c = config(spark)
    return a.question_states(responses(spark, d), answers(spark, d), q, c)


def q1_build_defaults(spark, d):
    return a.build_defaults(responses(spark, d), config(spark)[0]).select("response_id", "qid", "code")


def q2_visible_questions(spark, d):
    return _states(spark, d).where("visible").select("response_id", "qid")


def q3_clear_hidden(spark, d):
    return a.clear_hidden(answers(spark, d), _states(spark, d))


def q4_completeness(spark, d):
    return a.completeness_report(answers(spark, d), _states(spark, d)).withColumn("missing", F.array_join("missing", ","))


def q5_prepare_answers(spark, d):
    return a.prepare_answers(answers(spark, d), _states(spark, d))


def q6_map_answers(spark, d):
    q, o, _ = config(spark)
    return a.map_answers(answers(spark, d), q, o).select("response_id", F.array_join("lines", "\n").alias("lines"), F.array_join("phrases", "|").alias("phrases"))


def _metadata(spark, d):
    return a.answer_metadata(answers(spark, d), config(spark)[0], spark.createDataFrame(CODES, "qid string, code string, field string, value string"), STEMS)


def q7_answer_metadata(spark, d):
    return _metadata(spark, d)


def q8_safe_titles(spark, d):
    return _metadata(spark, d).select("response_id", a.safe_title(F.lit("Note"), F.col("syndrome"), F.col("dynamics")).alias("title"))


def q9_query_texts(spark, d):
    q, o, _ = config(spark)
    mapped = a.map_answers(answers(spark, d), q, o).join(_metadata(spark, d), "response_id")
    return mapped.select("response_id", a.query_text(F.lit("daily note"), F.col("syndrome"), F.col("phrases")).alias("query_text"))


def q10_free_text_paths(spark, d):
    return a.free_text_paths(answers(spark, d), config(spark)[0])


QUERIES = {f.__name__: f for f in (q1_build_defaults, q2_visible_questions, q3_clear_hidden, q4_completeness, q5_prepare_answers, q6_map_answers, q7_answer_metadata, q8_safe_titles, q9_query_texts, q10_free_text_paths)}

_ENTRY = "response_id, doc_type, qid, idx, kind, code, custom_text"
_PARTS = """, parts AS (SELECT g.response_id, q.qid, qtype, ord, label, multi_prefix, idx, CASE WHEN kind = 'custom' OR qtype = 'text' THEN said ELSE phrase END AS part, kind = 'custom' OR qtype = 'text' AS own
  FROM good g JOIN questions q ON g.doc_type = q.doc_type AND g.qid = q.qid LEFT JOIN options o ON o.qid = g.qid AND o.value = g.code),
 told AS (SELECT response_id, ord, qtype, CASE WHEN qtype = 'multiselect' THEN any_value(multi_prefix) || string_agg(part, ', ' ORDER BY idx) || '.' WHEN bool_or(own) THEN any_value(label) || ': ' || min(part) || '.' ELSE min(part) END AS line, string_agg(part, '|' ORDER BY idx) AS texts
  FROM parts WHERE part IS NOT NULL GROUP BY response_id, ord, qtype),
 mapped AS (SELECT response_id, string_agg(line, chr(10) ORDER BY qtype = 'text', ord) AS lines, string_agg(texts, '|' ORDER BY qtype = 'text', ord) AS phrases FROM told GROUP BY 1)"""
_META = """, meta AS (SELECT x.response_id, max(CASE WHEN x.qid = 'dynamics' THEN CASE code WHEN 'A' THEN 'slight_gain' WHEN 'R' THEN 'loss' END END) AS dynamics,
  max(CASE WHEN x.qid = 'syndrome' THEN CASE WHEN code = '0' THEN 'anxiety' WHEN trim(custom_text) <> '' THEN 'anxious' END END) AS syndrome, max(CASE WHEN x.qid = 'diagnosis' THEN 'F' || substr(code, 5, 1) || 'x' END) AS diagnosis_class
  FROM answers x JOIN questions q ON x.doc_type = q.doc_type AND x.qid = q.qid GROUP BY 1)"""
SQL = {
    "q1_build_defaults": f"{BASE} SELECT response_id, qid, dflt AS code FROM responses r JOIN questions q ON r.doc_type = q.doc_type WHERE dflt IS NOT NULL",
    "q2_visible_questions": f"{BASE} SELECT response_id, qid FROM states WHERE visible",
    "q3_clear_hidden": f"{BASE} SELECT {_ENTRY} FROM answers x WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.response_id = x.response_id AND s.qid = x.qid AND NOT visible)",
    "q4_completeness": f"{BASE}, given AS (SELECT DISTINCT response_id, qid, true AS given FROM good) SELECT s.response_id, count(*) FILTER (WHERE required AND visible AND given) AS answered, count(*) FILTER (WHERE required AND visible) AS total, coalesce(string_agg(s.qid, ',' ORDER BY ord) FILTER (WHERE required AND visible AND given IS NULL), '') AS missing FROM states s LEFT JOIN given g ON s.response_id = g.response_id AND s.qid = g.qid GROUP BY 1",
    "q5_prepare_answers": f"{BASE} SELECT {_ENTRY} FROM good x WHERE EXISTS (SELECT 1 FROM states s WHERE s.response_id = x.response_id AND s.qid = x.qid AND visible)",
    "q6_map_answers": f"{BASE}{_PARTS} SELECT * FROM mapped",
    "q7_answer_metadata": f"{BASE}{_META} SELECT * FROM meta",
    "q8_safe_titles": f"{BASE}{_META} SELECT response_id, concat_ws(' · ', 'Note', syndrome, replace(dynamics, '_', ' ')) AS title FROM meta",
    "q9_query_texts": f"{BASE}{_PARTS}{_META} SELECT response_id, concat_ws(' ', 'daily note', syndrome, replace(phrases, '|', ' ')) AS query_text FROM mapped JOIN meta USING (response_id)",
    "q10_free_text_paths": f"{BASE} SELECT response_id, CASE WHEN kind = 'custom' THEN g.qid || CASE WHEN qtype = 'multiselect' THEN '[' || idx || ']' ELSE '' END || '.custom_text' ELSE g.qid END AS path, said AS text FROM good g JOIN questions q ON g.doc_type = q.doc_type AND g.qid = q.qid WHERE kind = 'custom' OR qtype = 'text'",
}
