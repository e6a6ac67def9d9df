"""Queries of ingestion, prompts, days and export clean-up over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.operators import briefs as b
from chartweave.operators import chunks as c
from chartweave.operators import history as h
from chartweave.operators import ingest as i
from chartweave.operators import stays as s
from chartweave.operators import text as t
from chartweave.operators.redaction import spread
from chartweave.plans.corpus import DONE, STAYS, days_of, iso, varied_notes
from chartweave.plans.flows import DYNAMICS, HEADINGS, MARKER
from chartweave.plans.history import table
from chartweave.sources import files


def _chunks(clean):
    return c.chunk_documents(clean, "doc_ref", MARKER, HEADINGS, "осмотр", "тревожн", [("тревожн", "тревожный")], DYNAMICS)


def c11_ingest_corpus(spark, d):
    done = i.ingest_corpus(varied_notes(spark, d, spread), "doc_ref", None, _chunks, lambda: i.letter_model)
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6)
    return done.points.select("doc_type", "section", "syndrome", "diagnosis_class", "dynamics", "source", "text", norm.alias("norm"))


def e1_embed(spark, d):
    rows = i.embed(table(spark, d, "benchmark"), lambda: i.letter_model, "query", "own-e5")
    return rows.select("item_id", F.round(F.element_at("embedding", 5), 6).alias("e"), F.round(F.element_at("embedding", 17), 6).alias("q"))


def s3_read_history(spark, d):
    rows = files.read_history(spark, f"{d}/events.parquet", {"value": "int", "user_id": "string"}, {"props": "k int"})
    return rows.select("event_id", "user_id", "value", F.col("props.k").alias("k"))


def s6_batch_filenames(spark, d):
    return t.batch_filename(table(spark, d, "lineitem"), "l_orderkey", "l_shipdate")


def p10_phase_role(spark, d):
    return b.day_phase_role(days_of(spark, d)).select("stay_id", iso("day"), "percent", "phase", "role")


def p11_interpolate_state(spark, d):
    told = F.element_at(F.array(*map(F.lit, ["negative", "wavy", "stable", "positive"])), (F.col("stay_id") % 4 + 1).cast("int"))
    rows = b.interpolate_state(b.day_phase_role(days_of(spark, d)).withColumn("dynamics", told))
    return rows.select("stay_id", iso("day"), "mood", F.array_join("mood_detail", ",").alias("detail"), "behavior")


def p12_pick_rotated(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_linenumber").cast("string"))).alias("pool"))
    picks = s.pick_rotated(F.filter("pool", lambda x: x != "1"), F.col("l_orderkey").cast("int"), 2)
    return rows.select("l_orderkey", F.array_join(picks, ",").alias("picks"))


def p22_unpack_batch_meta(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    last = F.when(F.col("o_orderkey") % 3 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), day, F.lit('"')))
    text = F.concat(F.lit('{"sleep":"A","__batch_meta__":{"admission_date":"'), day, F.lit('","date_from":"'), day, F.lit('","date_to":'), last, F.lit(',"session_title":"'), "o_orderpriority", F.lit('","director_context":5}}'))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "[1]").when(F.col("o_orderkey") % 11 == 0, "{").otherwise(text).alias("answers"))
    return b.unpack_batch_meta(rows).drop("answers", "estimated_discharge")


def q11_assemble_prompts(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("response_id"), "turn", "role", "text").distinct()
    responses = turns.select("response_id", F.when(F.col("response_id") % 2 == 0, "daily").otherwise("exam_10d").alias("doc_type"), F.when(F.col("response_id") % 3 == 0, F.lit("brief")).alias("brief")).distinct()
    prose = spark.createDataFrame([("daily", "Write a note.", "A:\nB:", "- none", "no samples"), ("exam_10d", "Write an exam.", "C:", "- none", "no samples")], "doc_type string, system string, skeleton string, no_lines string, no_samples string")
    lines = turns.where("role = 'user'").select("response_id", F.col("turn").alias("ord"), F.col("text").alias("line"))
    return b.assemble_prompts(responses, lines, turns.where("role <> 'user'").select("response_id", F.col("turn").alias("rank"), F.col("text").alias("block")), prose)


def q11_default_prompts(spark, d):
    """Prompts with the library's own prose, for all conversations as responses."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("response_id"), "turn", "role", "text").distinct()
    responses = turns.select("response_id", F.when(F.col("response_id") % 2 == 0, "daily").otherwise("exam_10d").alias("doc_type")).distinct()
    lines = turns.where("role = 'user'").select("response_id", F.col("turn").alias("ord"), F.col("text").alias("line"))
    samples = turns.where("false").select("response_id", F.col("turn").alias("rank"), F.col("text").alias("block"))
    done = b.assemble_prompts(responses, lines, samples, b.default_prose(spark))
    return done.select("response_id", F.md5("system").alias("system"), F.md5("user").alias("user"))


def h8_automatic_titles(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    word = F.when(F.col("o_orderkey") % 3 == 0, "Пакет").when(F.col("o_orderkey") % 3 == 1, "Период").otherwise("Отпуск")
    status = F.when(F.col("o_custkey") % 4 == 0, " · Ошибка").when(F.col("o_custkey") % 4 == 1, " · ошибок: 12").when(F.col("o_custkey") % 4 == 2, " · Другое").otherwise("")
    return o.select("o_orderkey", h.is_automatic_title(F.concat(word, F.lit(" · "), day, F.lit("–"), day, F.lit(" (5 дн.)"), status)).alias("automatic"))


def _headers(spark, d):
    o = table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 5 == 0, "31.02.2024").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return o, F.concat(F.lit("ОСМОТР\n ** "), day, F.lit(" время:  9:05 **\nИБ N 12\nтекст "), day, F.lit("\nиб №"))


def t4_date_headers(spark, d):
    o, text = _headers(spark, d)
    return o.select("o_orderkey", t.rewrite_date_headers(text).alias("text"))


def t8_case_numbers(spark, d):
    o, text = _headers(spark, d)
    text = F.when(F.col("o_orderkey") % 2 == 0, text).otherwise("ОСМОТР\nбез номера")
    number = F.when(F.col("o_custkey") % 3 == 0, F.lit("[НОМЕР_ИБ]")).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit(" ИБ №"), F.col("o_custkey").cast("string")))
    return o.select("o_orderkey", t.case_number_line(text, number, F.col("o_orderkey") % 7 == 0).alias("text"))


def t12_build_substitutions(spark, d):
    docs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doctor_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("7")).alias("case_number"), F.to_date("o_orderdate").alias("day"))
    doctors = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.concat(F.lit("Лечащий врач, "), "c_mktsegment").alias("position"), F.lit("  ").alias("head_full_name"), F.lit(None).cast("string").alias("head_position"), F.lit("ЛУ").alias("head_institution"))
    made = t.build_substitutions(docs, doctors, F.col("day"))
    return made.select("o_orderkey", F.array_join(F.transform(F.array_sort(F.map_entries("substitutions")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("pairs"))


QUERIES = {f.__name__: f for f in (c11_ingest_corpus, e1_embed, s3_read_history, s6_batch_filenames, p10_phase_role, p11_interpolate_state, p12_pick_rotated, p22_unpack_batch_meta, q11_assemble_prompts, q11_default_prompts, h8_automatic_titles, t4_date_headers, t8_case_numbers, t12_build_substitutions)}

_PHASE = f"""{STAYS}, x AS (SELECT stay_id, day, day_number, doc_type, row_number() OVER (PARTITION BY stay_id ORDER BY day) AS place, count(*) OVER (PARTITION BY stay_id) AS n FROM days),
 y AS (SELECT *, CASE WHEN n > 1 THEN round((place - 1) * 100.0 / (n - 1)) ELSE 100.0 END AS percent FROM x),
 z AS (SELECT *, CASE WHEN day_number <= 3 THEN 'admission' WHEN percent < 35 THEN 'field' WHEN percent < 55 THEN 'titration' WHEN percent < 80 THEN 'improving' ELSE 'residual' END AS phase,
  CASE WHEN doc_type = 'exam_10d' THEN 'exam' WHEN place = n OR (place - 1) % 3 = 0 THEN 'event' ELSE 'quiet' END AS role FROM y)"""
_LETTERS = [chr(97 + k) for k in range(26)]
_COUNTS = "[" + ", ".join(f"len(x) - len(replace(x, '{ch}', ''))" for ch in _LETTERS) + "]"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in t.MONTHS) + "]"
_OFFICIAL = f"'«' || strftime(day, '%d') || '» ' || {_MONTHS}[month(day)] || ' ' || strftime(day, '%Y') || ' г.'"
_HEADER = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 = 0 AS odd, CASE WHEN o_orderkey % 5 = 0 THEN '31.02.2024' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS said FROM orders"
SQL = {
    "c11_ingest_corpus": rf"""WITH {DONE}, p AS (SELECT unnest(CASE WHEN regexp_matches(done, '(?m)^\[(ДАТА|ПЕРИОД)\]') THEN string_split(regexp_replace(done, '\n(\[(ДАТА|ПЕРИОД)\])', chr(1) || '\1', 'g'), chr(1)) ELSE regexp_split_to_array(done, '\n\s*\n') END) AS x FROM done WHERE clean),
 q AS (SELECT DISTINCT regexp_replace(x, '^\s+|\s+$', '', 'g') AS text FROM p)
 SELECT 'daily' AS doc_type, 'full' AS section, CASE WHEN contains(text, 'тревожн') THEN 'тревожный' END AS syndrome, CASE WHEN regexp_extract(text, '(?:^|[^0-9A-Za-zА-Яа-яЁё_])([A-ZА-Я])\d\d', 1) IN ('F', 'Ф') THEN 'F' || regexp_extract(text, '(?:^|[^0-9A-Za-zА-Яа-яЁё_])[A-ZА-Я](\d)\d', 1) || 'x' END AS diagnosis_class,
 CASE WHEN text LIKE '%улучш%' THEN 'better' WHEN text LIKE '%ухудш%' THEN 'worse' WHEN text LIKE '%без динамики%' THEN 'same' END AS dynamics, 'corpus' AS source, text, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 1.0 ELSE 0.0 END AS norm FROM q WHERE length(text) >= 40""",
    "e1_embed": f"WITH a AS (SELECT item_id, lower('query: ' || text) AS x FROM benchmark), b AS (SELECT item_id, {_COUNTS} AS n FROM a), c AS (SELECT item_id, n, sqrt(list_sum(list_transform(n, lambda k: CAST(k * k AS DOUBLE)))) AS norm FROM b) SELECT item_id, round(n[5] / norm, 6) AS e, round(n[17] / norm, 6) AS q FROM c",
    "s3_read_history": "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(trunc(value) AS INT) AS value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
    "s6_batch_filenames": "SELECT l_orderkey, 'diaries_batch_' || strftime(min(l_shipdate), '%Y-%m-%d') || '_to_' || strftime(max(l_shipdate), '%Y-%m-%d') || '.docx' AS filename FROM lineitem GROUP BY 1",
    "p10_phase_role": f"WITH {_PHASE} SELECT stay_id, CAST(day AS VARCHAR) AS day, percent, phase, role FROM z",
    "p11_interpolate_state": f"WITH {_PHASE}, w AS (SELECT *, ['negative', 'wavy', 'stable', 'positive'][CAST(stay_id % 4 + 1 AS INT)] AS told FROM z) SELECT stay_id, CAST(day AS VARCHAR) AS day, CASE told WHEN 'negative' THEN 'unstable' WHEN 'stable' THEN 'even' ELSE CASE WHEN phase IN ('improving', 'residual') THEN 'even' ELSE 'unstable' END END AS mood, CASE told WHEN 'negative' THEN 'irritability' WHEN 'stable' THEN '' WHEN 'wavy' THEN CASE WHEN phase IN ('improving', 'residual') THEN '' ELSE 'lability' END ELSE CASE phase WHEN 'admission' THEN 'irritability,lability' WHEN 'field' THEN 'irritability,lability' WHEN 'titration' THEN 'lability' ELSE '' END END AS detail, CASE phase WHEN 'admission' THEN 'restless' WHEN 'field' THEN CASE role WHEN 'event' THEN 'restless' ELSE 'minor_remarks' END WHEN 'residual' THEN 'ordered' ELSE 'minor_remarks' END AS behavior FROM w",
    "p12_pick_rotated": "WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber) FILTER (WHERE l_linenumber <> 1))) AS pool FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN coalesce(len(pool), 0) = 0 THEN '' ELSE pool[l_orderkey % len(pool) + 1] || ',' || pool[(l_orderkey + 1) % len(pool) + 1] END AS picks FROM a",
    "p22_unpack_batch_meta": "SELECT o_orderkey, CASE WHEN fine THEN day END AS admission_date, CASE WHEN fine THEN day END AS date_from, CASE WHEN fine THEN day END AS date_to, CASE WHEN fine THEN '' END AS director_context, CASE WHEN fine THEN o_orderpriority END AS session_title FROM (SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS fine FROM orders)",
    "q11_assemble_prompts": "WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations) SELECT conv_id AS response_id, CASE WHEN conv_id % 2 = 0 THEN 'Write a note.' || chr(10) || chr(10) || 'A:' || chr(10) || 'B:' ELSE 'Write an exam.' || chr(10) || chr(10) || 'C:' END || CASE WHEN conv_id % 3 = 0 THEN chr(10) || chr(10) || 'brief' ELSE '' END AS system, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (WHERE role <> 'user' AND text <> ''), 'no samples') || chr(10) || chr(10) || coalesce(string_agg('- ' || text, chr(10) ORDER BY turn, text) FILTER (WHERE role = 'user' AND text <> ''), '- none') AS user FROM c GROUP BY 1",
    "q11_default_prompts": "WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations) SELECT conv_id AS response_id, md5(CASE WHEN conv_id % 2 = 0 THEN " + " ELSE ".join("'" + system + "' || chr(10) || chr(10) || '" + "' || chr(10) || '".join(captions) + "'" for system, captions in b.PROSE.values()) + f" END) AS system, md5('{b.NO_SAMPLES}' || chr(10) || chr(10) || coalesce(string_agg('- ' || text, chr(10) ORDER BY turn, text) FILTER (WHERE role = 'user' AND text <> ''), '{b.NO_LINES}')) AS user FROM c GROUP BY 1",
    "h8_automatic_titles": "SELECT o_orderkey, o_orderkey % 3 < 2 AND o_custkey % 4 <> 2 AS automatic FROM orders",
    "t4_date_headers": f"SELECT o_orderkey, 'ОСМОТР' || chr(10) || CASE WHEN odd THEN ' ** ' || said || ' время:  9:05 **' ELSE {_OFFICIAL} || ' время: 09 час. 05 мин.' END || chr(10) || 'ИБ N 12' || chr(10) || 'текст ' || said || chr(10) || 'иб №' AS text FROM ({_HEADER})",
    "t8_case_numbers": f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ОСМОТР' || chr(10) || ' ** ' || said || ' время:  9:05 **' || chr(10) || 'ИБ N 12' || chr(10) || 'текст ' || said || chr(10) || 'иб №' ELSE 'ОСМОТР' || chr(10) || 'без номера' END WHEN o_orderkey % 2 = 0 THEN 'ОСМОТР' || chr(10) || ' ** ' || said || ' время:  9:05 **' || chr(10) || line || chr(10) || 'текст ' || said ELSE line || chr(10) || 'ОСМОТР' || chr(10) || 'без номера' END AS text FROM (SELECT *, 'ИБ №' || CASE WHEN o_custkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS line FROM ({_HEADER}))",
    "t12_build_substitutions": f"SELECT o_orderkey, array_to_string(list_sort(list_filter(['[ДАТА]=' || {_OFFICIAL}, '[ВРЕМЯ]=10 час. 00 мин.', '[ФИО_ВРАЧА]=' || c_name, '[ДОЛЖНОСТЬ_ВРАЧА]=' || c_mktsegment, '[ЛУ]=' || CASE WHEN c_name IS NOT NULL THEN 'ЛУ' END, '[НОМЕР_ИБ]=' || CASE WHEN o_orderkey % 2 = 0 THEN '7' END], lambda x: x IS NOT NULL)), ';') AS pairs FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 5 <> 0)",
}
