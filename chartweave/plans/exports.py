"""Queries of export clean-up over notes made from orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.operators import export as e
from chartweave.operators.redaction import spread
from chartweave.plans.history import table

# The lines of a note, as Spark and as DuckDB make them from an order: (condition, line).
TITLES = {0: e.DAILY_TITLE, 1: " ".join(e.JOINT_TITLE), 2: "осмотр ЛЕЧАЩИМ врачом", 3: "Записка"}
CLOSING = {
    0: ("Лечащий врач: врач-психиатр, Петров П. П.",),
    1: (e.DOCTOR_CAPTION, "", "Петров П. П., врач"),
    2: (" " + e.HEAD_CAPTION, "Жалобы: нет", "Назначения: нет", "данных нет"),
    3: (e.DOCTOR_CAPTION, e.HEAD, e.DOCTOR_CAPTION),
    4: (f"Лечащий врач {e.DOCTOR}",),
}


def _body(day: str, key: str, number: str) -> list[str]:
    """The middle lines as SQL that both engines read."""
    return [
        "''",
        f"CASE {key} % 3 WHEN 0 THEN concat('Дата: ', {day}, ' время: 9:05') WHEN 1 THEN 'Дата: без времени' ELSE concat({day}, ' время:  10:45') END",
        f"concat('ИБ №', {number})",
        "'**Жалобы:** нет'",
        f"CASE {key} % 5 WHEN 0 THEN 'Диагноз : Данных  нет.' ELSE concat('Диагноз: F', CAST({key} % 90 AS STRING)) END",
        f"CASE {key} % 2 WHEN 0 THEN 'данных нет' ELSE 'продолжение' END",
        "'  '",
        "'Синдром: «данных'",
        "'нет»'",
        "'Назначения: , ,'",
        "'...'",
    ]


def note_lines(day: str, key: str, number: str) -> str:
    quote = lambda x: "'" + x + "'"
    title = f"CASE {key} % 4 " + " ".join(f"WHEN {k} THEN {quote(v)}" for k, v in TITLES.items()) + " END"
    closing = [f"CASE {number} % 5 " + " ".join(f"WHEN {k} THEN {quote(v[i])}" for k, v in CLOSING.items() if i < len(v)) + " END" for i in range(4)]
    return ", ".join([title, *_body(day, key, number), *closing])


def export_notes(spark, d):
    text = f"concat_ws('\\n', {note_lines('date_format(o_orderdate, "dd.MM.yyyy")', 'o_orderkey', 'o_custkey')})"
    return table(spark, d, "orders").select("o_orderkey", F.expr(text).alias("text"), "o_custkey")


def t5_canonical_signatures(spark, d):
    return export_notes(spark, d).select("o_orderkey", e.canonical_signatures(F.col("text")).alias("text"))


def t6_drop_empty_sections(spark, d):
    return export_notes(spark, d).select("o_orderkey", e.drop_empty_sections(F.col("text")).alias("text"))


def t7_daily_form(spark, d):
    return export_notes(spark, d).select("o_orderkey", e.daily_form(F.col("text")).alias("text"))


def t10_transform_documents(spark, d):
    values = F.create_map(F.lit(e.DOCTOR), F.lit("Сидоров С. С."), F.lit(e.POSITION), F.lit("врач"), F.lit(e.CASE_KEY), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")))
    return e.transform_documents(spread(export_notes(spark, d)).withColumn("substitutions", values), [("F1", "F01")]).select("o_orderkey", "text")


QUERIES = {f.__name__: f for f in (t5_canonical_signatures, t6_drop_empty_sections, t7_daily_form, t10_transform_documents)}

_LABELS = ", ".join(f"'{x}'" for x in e.LABELS)
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NOTES = f"""notes AS (SELECT o_orderkey, array_to_string([{note_lines("strftime(o_orderdate, '%d.%m.%Y')", 'o_orderkey', 'o_custkey').replace('STRING', 'VARCHAR')}], chr(10)) AS text, o_orderkey % 4 IN (0, 2) AS daily FROM orders)"""
_LINES = "{0} AS (SELECT o_orderkey, daily, unnest(string_split({1}, chr(10))) AS line, generate_subscripts(string_split({1}, chr(10)), 1) AS pos FROM {2})"
_KNOWN = f"(strpos(line, ':') > 0 AND lower({_TRIM.format("split_part(line, ':', 1)")}) IN ({_LABELS}))"

# a value is a line whose last line before it that is not blank is a caption
_SIGNED = f"""{_NOTES}, fixed AS (SELECT o_orderkey, daily, regexp_replace(replace(text, '{e.DOCTOR_CAPTION}' || chr(10) || '{e.HEAD}', '{e.HEAD_CAPTION}' || chr(10) || '{e.HEAD}'), '(^|\\n)Лечащий врач {e.literal(e.DOCTOR)}(\\n|$)', CASE WHEN daily THEN '\\1Лечащий врач, {e.POSITION}, {e.DOCTOR}\\2' ELSE '\\1{e.DOCTOR}, {e.POSITION}\\2' END, 'g') AS text FROM notes),
 {_LINES.format('l', 'text', 'fixed')}, t AS (SELECT o_orderkey, daily, pos, line, {_TRIM.format('line')} AS bare FROM l), c AS (SELECT *, bare IN ('{e.DOCTOR_CAPTION}', '{e.HEAD_CAPTION}') AS caption FROM t),
 p AS (SELECT *, max(CASE WHEN bare <> '' THEN pos END) OVER (PARTITION BY o_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
 v AS (SELECT p.*, coalesce(q.caption, false) AND p.bare <> '' AND NOT p.caption AND NOT {_KNOWN.replace('line', 'p.bare')} AND lower(p.bare) NOT IN ('осмотр', lower('{e.DAILY_TITLE}')) AND NOT regexp_matches(p.bare, '^ИБ|^Дата:|\\[ДАТА\\]') AS goes FROM p LEFT JOIN c q ON q.o_orderkey = p.o_orderkey AND q.pos = p.before),
 w AS (SELECT v.*, EXISTS (SELECT 1 FROM v g WHERE g.o_orderkey = v.o_orderkey AND g.goes AND g.before < v.pos AND v.pos < g.pos) AS between_ FROM v)
 SELECT o_orderkey, string_agg(CASE WHEN bare = '{e.HEAD_CAPTION}' THEN bare || chr(10) || '{e.HEAD}, {e.HEAD_POSITION}, {e.PLACE}' WHEN bare = '{e.DOCTOR_CAPTION}' THEN CASE WHEN daily THEN '{e.POSITION} {e.DOCTOR}' ELSE bare || chr(10) || '{e.DOCTOR}, {e.POSITION}' END ELSE line END, chr(10) ORDER BY pos) AS text FROM w WHERE NOT goes AND NOT between_ GROUP BY 1"""

_BARE = _TRIM.format(r"regexp_replace(regexp_replace(replace(replace(lower({}), '—', '-'), '–', '-'), '[.,;:!?\"''«»()]', '', 'g'), '\s+', ' ', 'g')")
_SECTIONS = f"""{_NOTES}, {_LINES.format('l', "replace(text, '**', '')", 'notes')}, t AS (SELECT o_orderkey, pos, {_TRIM.format('line')} AS line FROM l),
 k AS (SELECT *, {_KNOWN} AS head FROM t), n AS (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY o_orderkey ORDER BY pos) AS section FROM k),
 j AS (SELECT * FROM n WHERE head OR line = '' OR {_BARE.format('line')} NOT IN ('', '{e.NOTHING}')),
 b AS (SELECT o_orderkey, section, max(line) FILTER (WHERE head) AS head, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT head), ''), CASE WHEN section > 0 THEN '^\\n+|\\n+$' ELSE '^\\n+' END, '', 'g') AS body FROM j GROUP BY 1, 2),
 s AS (SELECT *, CASE WHEN section = 0 THEN body ELSE head || CASE WHEN body = '' THEN '' ELSE chr(10) || body END END AS whole FROM b WHERE section = 0 OR {_BARE.format("regexp_replace(head, '^[^:]*:', '') || ' ' || body")} <> '{e.NOTHING}')
 SELECT o_orderkey, regexp_replace(string_agg(whole, chr(10) ORDER BY section), '^\\n+|\\n+$', '', 'g') AS text FROM s GROUP BY 1"""

_NAMED = f"CASE WHEN line = 'Лечащий врач: врач-психиатр, Петров П. П.' THEN 'врач-психиатр Петров П. П.' WHEN line LIKE 'Лечащий врач%' THEN '{e.POSITION} {e.DOCTOR}'"
_DAILY = f"""{_NOTES}, {_LINES.format('l', 'text', 'notes')}, t AS (SELECT o_orderkey, pos, daily, {_TRIM.format('line')} AS line FROM l),
 f AS (SELECT o_orderkey, string_agg(CASE WHEN lower(line) = lower('{e.DAILY_TITLE}') THEN '{e.DAILY_TITLE}' ELSE {_NAMED} WHEN regexp_matches(line, '^(Дата: )?\\d\\d\\.\\d\\d\\.\\d{{4}} время:') THEN 'Дата: ' || regexp_extract(line, '\\d\\d\\.\\d\\d\\.\\d{{4}}') || ' ' || lpad(regexp_extract(line, '(\\d+:\\d\\d)$', 1), 5, '0') ELSE line END END, chr(10) ORDER BY pos) AS text FROM t WHERE daily AND line NOT IN ('', '{e.DOCTOR_CAPTION}') AND line NOT LIKE 'ИБ №%' GROUP BY 1)
 SELECT o_orderkey, text FROM f UNION ALL SELECT o_orderkey, text FROM notes WHERE NOT daily"""

SQL = {"t5_canonical_signatures": f"WITH {_SIGNED}", "t6_drop_empty_sections": f"WITH {_SECTIONS}", "t7_daily_form": f"WITH {_DAILY}"}
