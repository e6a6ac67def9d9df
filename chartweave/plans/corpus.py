"""Queries of text, redaction, stay and vector operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.functions import personal_data as known
from chartweave.operators import redaction as r
from chartweave.operators import retrieval
from chartweave.operators import stays as s
from chartweave.operators import text as t
from chartweave.operators import vectors as v
from chartweave.operators.timeline import dealt
from chartweave.plans.history import table

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def notes(spark, d):
    """Cyrillic notes made from orders: marked records with a date, a code and a phone."""
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    text = F.concat(
        F.lit("Общее\n[ДАТА] "), day, F.lit(" Диагноз: F"), (F.col("o_custkey") % 10).cast("string"), F.lit("0.1. Тел. +7 812 123-45-"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"),
        F.lit("\nСостояние с улучшением.\n[ПЕРИОД] карта "), (F.col("o_orderkey") + 20000000).cast("string"), F.lit(" без динамики"),
    )
    return o.select(F.col("o_orderkey").alias("doc_ref"), text.alias("text"))


NOTES = r"""notes AS (SELECT o_orderkey AS doc_ref, 'Общее' || chr(10) || '[ДАТА] ' || strftime(o_orderdate, '%d.%m.%Y') || ' Диагноз: F' || (o_custkey % 10) || '0.1. Тел. +7 812 123-45-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0')
 || chr(10) || 'Состояние с улучшением.' || chr(10) || '[ПЕРИОД] карта ' || (o_orderkey + 20000000) || ' без динамики' AS text FROM orders)"""


# Notes of many shapes, one by the remainder of the order's key; {..} are filled from the row.
FORMS = [
    "Общее\n[ДАТА] {date} Диагноз: F{c}0.1. Тел. +7 812 123-45-{cc}\nСостояние с улучшением.\n[ПЕРИОД] карта {long} без динамики",
    "[ДАТА] {date} Пациент Иванов Пётр Сергеевич, 14 лет, жалобы на сон. Диагноз: Ф{c}1.1. Состояние без динамики, контакт формальный.",
    "Врач Петрова А.С. осмотрела. История болезни № {key}/2. Диагноз: R51, F{c}2.0; состояние с ухудшением.",
    "[ПЕРИОД] с 1.02—9.02.2024 в ГБУЗ № 7 «Первая» лечение 25 мг, АД 120/80. Заметно улучшение сна, тел. 8-911-123-45-{cc}.",
    "6 октября 2025 года и 2024-2025 гг. в возрасте до пятнадцати лет, 10 час. 18 мин., СНИЛС 123-456-789 {cc}.",
    "направление № {key} от 2024-01-09; номер {long}; f{c}3 в тексте, ухудшение, позже улучшение.",
    "",
    None,
    "Осмотр врача\nЖалобы: на сон, на тревогу, на аппетит и на шум в доме\nДиагноз: F{c}4.5, тревожный синдром, состояние с улучшением\nИтог",
    " \n\t ",
    "Первый абзац без отметок.\n\nВторой абзац, {date}.\n \nТретий абзац, f{c}5.",
    "Мать: Сидорова Анна Петровна. Наличие жалоб; паралич; QTc=0.40, 123/70, 18-21, до 10:45.",
    "Мария Кузнецова пришла сама. Паспорт 4010 123456, полис {long}, ул. Ленина, д. 5, с 5 мая по 6 мая, октябрь 2025 г.",
]
_FILL = {
    "date": (lambda: F.date_format("o_orderdate", "dd.MM.yyyy"), "strftime(o_orderdate, '%d.%m.%Y')"),
    "key": (lambda: F.col("o_orderkey").cast("string"), "CAST(o_orderkey AS VARCHAR)"),
    "long": (lambda: (F.col("o_orderkey") + 20000000).cast("string"), "CAST(o_orderkey + 20000000 AS VARCHAR)"),
    "cc": (lambda: F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), "lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0')"),
    "c": (lambda: (F.col("o_custkey") % 10).cast("string"), "CAST(o_custkey % 10 AS VARCHAR)"),
}


def varied_notes(spark, d, deal=lambda rows: rows):
    """Notes of all forms made from orders; some are empty, blank or null. ``deal`` deals the
    short orders out before their notes are written."""
    text = F.element_at(F.array(*[F.lit(f).cast("string") for f in FORMS]), (F.col("o_orderkey") % len(FORMS) + 1).cast("int"))
    for name, (column, _) in _FILL.items():
        text = F.replace(text, F.lit("{" + name + "}"), column())
    return deal(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select(F.col("o_orderkey").alias("doc_ref"), text.alias("text"))


def _sql_text(value):
    return "NULL" if value is None else " || chr(10) || ".join("'" + part.replace("\t", "' || chr(9) || '") + "'" for part in value.split("\n"))


def _filled(sql):
    for name, (_, column) in _FILL.items():
        sql = f"replace({sql}, '{{{name}}}', {column})"
    return sql


VARIED = f"varied AS (SELECT o_orderkey AS doc_ref, {_filled('[' + ', '.join(map(_sql_text, FORMS)) + f'][CAST(o_orderkey % {len(FORMS)} + 1 AS INT)]')} AS text FROM orders)"
# In these forms no two detectors meet, so one after another gives what all at once give.
_STEPS = [
    (r"(Врач )" + known.SURNAME_INITIALS, r"\1[ФИО_ВРАЧА]"), (r"(Пациент )[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ович|(Пациент )[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+евич", r"\1\2[ПАЦИЕНТ]"),
    # a run of capitalised words goes on behind the full stop
    (r"(Мать: )[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+овна\. Наличие", r"\1[РОДИТЕЛЬ]"), ("Мария Кузнецова", "[ФИО]"), (r"ГБУЗ № \d+ «[^»]*»", "[УЧРЕЖДЕНИЕ]"),
    *[(known.DETECTORS[n][1], known.PLACEHOLDERS[known.DETECTORS[n][0]]) for n in known.DETECTORS if n not in known.ON_REQUEST],
]
_REDACTED = "coalesce(text, '')"
for _pattern, _placeholder in _STEPS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '{_placeholder}', 'g')"
_MARKS = {k: p.strip("[]") for k, p in known.PLACEHOLDERS.items()}
_HITS = ", ".join(f"len(regexp_extract_all(done, '\\[{m}\\]')) - len(regexp_extract_all(coalesce(text, ''), '\\[{m}\\]')) AS n_{k}" for k, m in _MARKS.items())
_RESIDUAL = " OR ".join(f"regexp_matches(regexp_replace(done, '{known.PLACEHOLDER_MARK}', ' ', 'g'), '{p}')" for p in known.RESIDUAL.values())
#: doc_ref, text as it was, done: redacted, n_<kind>: how many were removed, clean.
DONE = f"{VARIED}, done AS (SELECT *, {_HITS}, trim(done, ' ' || chr(9) || chr(10)) <> '' AND NOT ({_RESIDUAL}) AS clean FROM (SELECT doc_ref, text, {_REDACTED} AS done FROM varied))"
_TOTAL = " + ".join(f"n_{k}" for k in _MARKS)
REMOVED = "SELECT doc_ref, unnest([" + ", ".join(f"'{k}'" for k in _MARKS) + "]) AS type, unnest([" + ", ".join(f"n_{k}" for k in _MARKS) + "]) AS n FROM done"


def r1_normalize_text(spark, d):
    raw = F.concat(F.lit("﻿"), F.replace("text", F.lit(" "), F.lit(" ")), F.lit("\r\nx\ry"))
    return table(spark, d, "documents").select("doc_id", F.md5(t.normalize_text(raw)).alias("digest"))


NUMBERED = {"period": "date_range_numeric", "date": "date_numeric", "phone": "phone", "doc_number": "bare_long_id", "id_doc": "snils", "time": "time_colon"}


def r2_detector_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", *[r.detector_count(F.col("text"), name).cast("long").alias(k) for k, name in NUMBERED.items()])


def r2_all_detectors(spark, d):
    return varied_notes(spark, d).select("doc_ref", *[r.detector_count(F.col("text"), n).cast("long").alias(n) for n in known.DETECTORS])


def r7_protected_text(spark, d):
    return varied_notes(spark, d).select("doc_ref", r.protected_count(F.col("text")).cast("long").alias("n"))


def r9_structured_notes(spark, d):
    """Structured data only. ``spans.redact_structured`` does the same in plain expressions, which
    are interpreted and try each pattern on each text."""
    done = r.redact_documents(varied_notes(spark, d, r.spread), structured=True)
    return done.select("doc_ref", "text", "removed_count", F.array_join(F.array_sort(F.map_keys("removed_by_type")), ",").alias("types"))


CAPITALISED = "[А-ЯЁ][а-яё]+"


def r5_stem_matches(spark, d):
    """Capitalised words of the notes and the listed names that they are forms of."""
    words = varied_notes(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(CAPITALISED), F.lit(0))).alias("word"))
    names = spark.createDataFrame([(n,) for n in (*known.USUAL.first_names, *known.USUAL.surnames)], "name string")
    return r.stem_matches(words, names)


def r10_redact_notes(spark, d):
    return r.redact_documents(varied_notes(spark, d, r.spread)).select("doc_ref", "text", "removed_count", "clean")


def r11_suspicions(spark, d):
    """The gate alone, over texts that nothing was done to."""
    return varied_notes(spark, d).select("doc_ref", F.array_join(r.gate_suspicions(F.col("text")), ",").alias("kinds"))


def r12_quarantine(spark, d):
    return r.gate_split(r.redact_documents(varied_notes(spark, d, r.spread)))[1].select("doc_ref", "reason")


def r12_documents_held_back(spark, d):
    docs = table(spark, d, "documents").withColumn("clean", F.size(r.gate_suspicions(F.col("text"))) == 0)
    return r.gate_split(docs)[1].select("doc_id", "reason")


def r13_removed_by_type(spark, d):
    return r.removed_by_type_report(r.redact_documents(varied_notes(spark, d, r.spread)))


def f1_select_paths(spark, d):
    return t.select_paths(table(spark, d, "pages"), r"page=1", r"ref=", ["fr", "de"], "url").select("page_id", "url")


def f2_source_ref(spark, d):
    return table(spark, d, "pages").select("page_id", t.source_ref(F.col("url")).alias("doc_ref"))


def c1_split_records(spark, d):
    return t.split_records(varied_notes(spark, d), "doc_ref", r"^\[(?:ДАТА|ПЕРИОД)\]").groupBy("doc_ref").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("chars"))


def c5_icd_class(spark, d):
    return varied_notes(spark, d).select("doc_ref", t.icd_class_first(F.col("text")).alias("first_class"), t.diagnosis_class_any(F.col("text")).alias("any_class"))


def c7_syndromes(spark, d):
    c = table(spark, d, "customer")
    raw = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("-form "))
    return c.select("c_custkey", t.normalize_stems(raw, [("auto", "car"), ("automobile", "automobile"), ("build", "building")]).alias("syndrome"))


def c8_dynamics(spark, d):
    rules = [("улучш", "better"), ("ухудш", "worse"), ("без динамики", "same")]
    return varied_notes(spark, d).groupBy(t.first_rule(F.col("text"), rules).alias("dynamics")).agg(F.count(F.lit(1)).alias("n"))


def c10_point_id(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", t.point_id(F.col("html"), F.lit("daily"), F.lit("full"), F.col("url"), NAMESPACE).alias("point_id"))


def t1_fix_typos(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.fix_typos(F.col("text"), [("the", "teh"), ("teh ", "THE ")]).alias("text"))


def t11_paragraphs(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text"))
    return t.paragraphs(raw).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("paragraph")).alias("chars"))


def s5_export_batches(spark, d):
    kids = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("parent_request_id"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").alias("created_at"), F.when(F.col("l_linestatus") == "F", "done").otherwise("failed").alias("status"),
        F.concat(F.lit("Day "), F.col("l_linenumber").cast("string")).alias("header"), F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("content"),
    )
    return t.export_batch_text(kids)


def s6_export_filename(spark, d):
    return table(spark, d, "orders").select("o_orderkey", t.export_filename(F.lit("daily"), F.col("o_orderdate")).alias("filename"))


def stay_table(spark, d):
    o = table(spark, d, "orders")
    first = F.date_add("o_orderdate", (F.col("o_orderkey") % 15 - 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("stay_id"), F.to_date("o_orderdate").alias("admission"), first.alias("date_from"), F.date_add(first, (F.col("o_custkey") % 40 - 2).cast("int")).alias("date_to"))


STAYS = """stays AS (SELECT *, CASE WHEN date_from < admission THEN 'before_admission' WHEN date_to < date_from THEN 'reversed' WHEN date_to - date_from + 1 > 31 THEN 'too_long' END AS reason FROM (
  SELECT stay_id, admission, date_from, date_from + CAST(c % 40 - 2 AS INT) AS date_to FROM (SELECT o_orderkey AS stay_id, CAST(o_orderdate AS DATE) AS admission, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 - 1 AS INT) AS date_from, o_custkey AS c FROM orders))),
 days AS (SELECT *, day - admission + 1 AS day_number, CASE WHEN (day - admission + 1) % 10 = 0 THEN 'exam_10d' ELSE 'daily' END AS doc_type FROM (SELECT *, CAST(unnest(generate_series(date_from, date_to, INTERVAL 1 DAY)) AS DATE) AS day FROM stays WHERE reason IS NULL))"""


def iso(column):
    """A date as ISO text, which every engine compares alike."""
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def days_of(spark, d):
    """The days of all stays, dealt by stay before a stay becomes days: they are made on all
    cores, and what puts a stay's days together again needs no shuffle."""
    return s.plan_days(s.validate_periods(dealt(stay_table(spark, d))))


def p1_validate_periods(spark, d):
    return s.validate_periods(stay_table(spark, d)).select("stay_id", "ok", "reason")


def p2_plan_days(spark, d):
    return days_of(spark, d).select("stay_id", iso("day"), "day_number", "doc_type")


def p3_plan_counts(spark, d):
    return s.plan_counts(days_of(spark, d))


def p4_sentences(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("stay_id"), F.col("text").alias("narrative"))
    return s.sentence_rows(docs).groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"))


def p8_nearest_days(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stay_id"), F.col("l_linenumber").alias("item"), F.to_date("l_shipdate").alias("anchor"))
    return s.nearest_days(items, days_of(spark, d)).select("stay_id", "item", iso("anchor"), iso("day"))


def p10_period_percent(spark, d):
    return s.period_percent(days_of(spark, d)).select("stay_id", iso("day"), "place", "percent")


def p16_weekend_notes(spark, d):
    return s.weekend_note(days_of(spark, d)).where("weekend_from IS NOT NULL").select("stay_id", iso("day"), iso("weekend_from"))


def p17_weekend_recap(spark, d):
    return s.weekend_recap(days_of(spark, d)).where("recap").select("stay_id", iso("day"))


def points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("point_id"), "embedding", F.when(F.col("vec_id") % 2 == 0, "daily").otherwise("exam_10d").alias("doc_type"), F.concat(F.lit("s"), (F.col("vec_id") % 5).cast("string")).alias("syndrome"),
        F.concat(F.lit("F"), F.col("label").cast("string"), F.lit("x")).alias("diagnosis_class"), F.lit("full").alias("section"),
    )


POINTS = "points AS (SELECT vec_id AS point_id, embedding, CASE vec_id % 2 WHEN 0 THEN 'daily' ELSE 'exam_10d' END AS doc_type, 's' || (vec_id % 5) AS syndrome, 'F' || label || 'x' AS diagnosis_class, 'full' AS section FROM embeddings)"


def asked(spark, d):
    q = points(spark, d).where("point_id % 10 = 0").withColumnRenamed("point_id", "query_id")
    return q.withColumns({"syndrome": F.when(F.col("query_id") % 20 == 0, "s9").otherwise(F.col("syndrome")), "diagnosis_class": F.when(F.col("query_id") % 30 == 0, "").otherwise(F.col("diagnosis_class"))})


ASKED = "asked AS (SELECT point_id AS query_id, embedding, doc_type, CASE WHEN point_id % 20 = 0 THEN 's9' ELSE syndrome END AS syndrome, CASE WHEN point_id % 30 = 0 THEN NULL ELSE diagnosis_class END AS diagnosis_class, section FROM points WHERE point_id % 10 = 0)"
_LEVELS = f"""WITH {POINTS}, {ASKED}, lv AS (SELECT query_id, embedding, 0 AS level, doc_type, syndrome, diagnosis_class, section FROM asked
 UNION ALL SELECT query_id, embedding, 1, doc_type, NULL, diagnosis_class, NULL FROM asked
 UNION ALL SELECT query_id, embedding, 3, NULL, NULL, NULL, NULL FROM asked WHERE diagnosis_class IS NULL)"""
_MET = "lv l JOIN points p ON (l.doc_type IS NULL OR l.doc_type = p.doc_type) AND (l.syndrome IS NULL OR l.syndrome = p.syndrome) AND (l.diagnosis_class IS NULL OR l.diagnosis_class = p.diagnosis_class) AND (l.section IS NULL OR l.section = p.section)"


def e2_l2_normalize(spark, d):
    unit = v.l2_normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("component_sum"))


def e3_cosine_top_k(spark, d):
    plain = points(spark, d).where("point_id % 10 = 0").select(F.col("point_id").alias("query_id"), "embedding", *[F.lit(None).cast("string").alias(f) for f in retrieval.FIELDS])
    return retrieval.cosine_top_k(plain, points(spark, d)).withColumn("score", F.round("score", 6))


def e5_fallback_levels(spark, d):
    return retrieval.fallback_levels(asked(spark, d))


def e6_retrieve_with_fallback(spark, d):
    return retrieval.retrieve_with_fallback(asked(spark, d), points(spark, d)).withColumn("score", F.round("score", 6))


def e8_collection_count(spark, d):
    return points(spark, d).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def s4_upsert_points(spark, d):
    old = points(spark, d).where("point_id % 3 <> 0").select("point_id", "doc_type", "syndrome")
    new = points(spark, d).where("point_id % 2 = 0").select("point_id", F.lit("new").alias("doc_type"), "syndrome", F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"))
    return v.upsert_points(old, new.withColumn("syndrome", F.concat("syndrome", F.lit("-"), F.col("arrival").cast("string"))))


def s7_sample_for_audit(spark, d):
    return v.sample_for_audit(points(spark, d), 25)


QUERIES = {
    f.__name__: f
    for f in (
        r1_normalize_text, r2_detector_counts, r2_all_detectors, r7_protected_text, r9_structured_notes, r5_stem_matches, r10_redact_notes, r11_suspicions, r12_quarantine, r12_documents_held_back, r13_removed_by_type, f1_select_paths, f2_source_ref, c1_split_records, c5_icd_class, c7_syndromes, c8_dynamics, c10_point_id,
        t1_fix_typos, t11_paragraphs, s4_upsert_points, s5_export_batches, s6_export_filename, s7_sample_for_audit, p1_validate_periods, p2_plan_days, p3_plan_counts, p4_sentences, p8_nearest_days, p10_period_percent,
        p16_weekend_notes, p17_weekend_recap, e2_l2_normalize, e3_cosine_top_k, e5_fallback_levels, e6_retrieve_with_fallback, e8_collection_count,
    )
}

_STRUCTURED = "coalesce(text, '')"
for _pattern, _placeholder in _STEPS[-len([n for n in known.DETECTORS if n not in known.ON_REQUEST]):]:
    _STRUCTURED = f"regexp_replace({_STRUCTURED}, '{_pattern}', '{_placeholder}', 'g')"
_KINDS = sorted({known.DETECTORS[n][0] for n in known.DETECTORS if n not in known.ON_REQUEST})
_PLAIN = "replace(lower(trim({0})), 'ё', 'е')"

_Q = "'"
SQL = {
    "r1_normalize_text": "SELECT doc_id, md5(replace(text, chr(13), '') || chr(10) || 'x' || chr(10) || 'y') AS digest FROM documents",
    "r2_detector_counts": "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{known.DETECTORS[n][1]}')) AS BIGINT) AS \"{k}\"" for k, n in NUMBERED.items()) + " FROM documents",
    "r2_all_detectors": f"WITH {VARIED} SELECT doc_ref, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {n}" for n, (_, p) in known.DETECTORS.items()) + " FROM varied",
    "r7_protected_text": f"WITH {VARIED} SELECT doc_ref, CAST(" + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in known.PROTECTED) + " AS BIGINT) AS n FROM varied",
    "r9_structured_notes": f"WITH {VARIED}, found AS (SELECT doc_ref, {_STRUCTURED} AS done, {', '.join(f'len(regexp_extract_all({_STRUCTURED}, {_Q}{chr(92)}[{_MARKS[k]}{chr(92)}]{_Q})) - len(regexp_extract_all(coalesce(text, {_Q}{_Q}), {_Q}{chr(92)}[{_MARKS[k]}{chr(92)}]{_Q})) AS n_{k}' for k in _KINDS)} FROM varied) SELECT doc_ref, done AS text, CAST({' + '.join(f'n_{k}' for k in _KINDS)} AS INT) AS removed_count, concat_ws(',', {', '.join(f'CASE WHEN n_{k} > 0 THEN {_Q}{k}{_Q} END' for k in _KINDS)}) AS types FROM found",
    "r5_stem_matches": f"WITH {VARIED}, words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{CAPITALISED}')) AS word FROM varied), w AS (SELECT word, {_PLAIN.format('word')} AS p FROM words), names AS (SELECT DISTINCT unnest([{', '.join(_Q + n + _Q for n in (*known.USUAL.first_names, *known.USUAL.surnames))}]) AS name), n AS (SELECT name, {_PLAIN.format('name')} AS q FROM names) SELECT word, name FROM w JOIN n ON left(p, 4) = left(q, 4) AND least(length(p), length(q)) >= greatest(4, length(q) - 2, length(p) - 3) AND left(p, greatest(4, length(q) - 2, length(p) - 3)) = left(q, greatest(4, length(q) - 2, length(p) - 3))",
    "r11_suspicions": f"WITH {VARIED} SELECT doc_ref, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{k}' END" for k, p in known.RESIDUAL.items()) + f") AS kinds FROM (SELECT doc_ref, regexp_replace(text, '{known.PLACEHOLDER_MARK}', ' ', 'g') AS x FROM varied)",
    "r10_redact_notes": f"WITH {DONE} SELECT doc_ref, done AS text, CAST({_TOTAL} AS INT) AS removed_count, clean FROM done",
    "r12_quarantine": f"WITH {DONE} SELECT doc_ref, CASE WHEN trim(done, ' ' || chr(9) || chr(10)) = '' THEN 'empty' ELSE 'residual' END AS reason FROM done WHERE NOT clean",
    "r12_documents_held_back": "SELECT doc_id, CASE WHEN empty THEN 'empty' ELSE 'residual' END AS reason FROM (SELECT doc_id, coalesce(regexp_replace(text, '\\s', '', 'g'), '') = '' AS empty, regexp_replace(text, '" + known.PLACEHOLDER_MARK + "', ' ', 'g') AS x FROM documents) WHERE empty OR " + " OR ".join(f"regexp_matches(x, '{p}')" for p in known.RESIDUAL.values()),
    "r13_removed_by_type": f"WITH {DONE} SELECT type, CAST(sum(n) AS BIGINT) AS removed FROM ({REMOVED}) GROUP BY 1 HAVING sum(n) > 0",
    "f1_select_paths": "SELECT page_id, url FROM pages WHERE regexp_matches(split_part(url, '/', -1), '(?i)page=1') OR (list_has_any(string_split(lower(url), '/')[:-2], ['fr', 'de']) AND NOT regexp_matches(split_part(url, '/', -1), '(?i)ref='))",
    "f2_source_ref": "SELECT page_id, 'src_' || substr(sha256(url), 1, 16) AS doc_ref FROM pages",
    "c1_split_records": f"WITH {VARIED}, p AS (SELECT doc_ref, unnest(CASE WHEN regexp_matches(text, '(?m)^\\[(ДАТА|ПЕРИОД)\\]') THEN string_split(regexp_replace(text, '\\n(\\[(ДАТА|ПЕРИОД)\\])', chr(1) || '\\1', 'g'), chr(1)) ELSE regexp_split_to_array(text, '\\n\\s*\\n') END) AS x FROM varied), q AS (SELECT doc_ref, length(regexp_replace(x, '\\s', '', 'g')) AS n FROM p) SELECT doc_ref, count(*) AS records, CAST(sum(n) AS BIGINT) AS chars FROM q WHERE n > 0 GROUP BY 1",
    "c5_icd_class": f"WITH {VARIED} SELECT doc_ref, CASE WHEN regexp_extract(text, '(?:^|[^0-9A-Za-zА-Яа-яЁё_])([A-ZА-Я])\\d\\d', 1) IN ('F', 'Ф') THEN 'F' || regexp_extract(text, '(?:^|[^0-9A-Za-zА-Яа-яЁё_])[A-ZА-Я](\\d)\\d', 1) || 'x' END AS first_class, CASE WHEN regexp_matches(text, '(?i)(?:^|[^0-9A-Za-zА-Яа-яЁё_])[FФ]\\d\\d') THEN 'F' || regexp_extract(text, '(?i)(?:^|[^0-9A-Za-zА-Яа-яЁё_])[FФ](\\d)\\d', 1) || 'x' END AS any_class FROM varied",
    "c7_syndromes": "SELECT c_custkey, CASE WHEN x LIKE 'automobile%' THEN 'automobile' WHEN x LIKE 'build%' THEN 'building' WHEN x LIKE 'auto%' THEN 'car' ELSE x END AS syndrome FROM (SELECT c_custkey, lower(c_mktsegment) || '-form' AS x FROM customer)",
    "c8_dynamics": f"WITH {VARIED} SELECT CASE WHEN text LIKE '%улучш%' THEN 'better' WHEN text LIKE '%ухудш%' THEN 'worse' WHEN text LIKE '%без динамики%' THEN 'same' END AS dynamics, count(*) AS n FROM varied GROUP BY 1",
    "c10_point_id": f"SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT page_id, sha1(unhex('{NAMESPACE.replace('-', '')}') || CAST(sha256(html || chr(1) || 'daily' || chr(1) || 'full' || chr(1) || url) AS BLOB)) AS h FROM pages)",
    "t1_fix_typos": "SELECT item_id, replace(replace(text, 'the', 'teh'), 'teh ', 'THE ') AS text FROM benchmark",
    "t11_paragraphs": r"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), q AS (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM p) SELECT doc_id, greatest(count(*) FILTER (WHERE x <> ''), 1) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM q GROUP BY 1",
    "s4_upsert_points": f"WITH {POINTS} SELECT point_id, CASE WHEN point_id % 2 = 0 THEN 'new' ELSE doc_type END AS doc_type, CASE WHEN point_id % 2 = 0 THEN syndrome || '-2' ELSE syndrome END AS syndrome FROM points WHERE point_id % 2 = 0 OR point_id % 3 <> 0",
    "s5_export_batches": "SELECT l_orderkey AS parent_request_id, string_agg('Day ' || l_linenumber || chr(10) || chr(10) || l_returnflag || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY l_shipdate, l_linenumber, l_returnflag) AS text FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'A' GROUP BY 1",
    "s6_export_filename": "SELECT o_orderkey, 'diary_daily_' || strftime(o_orderdate, '%Y-%m-%d') || '.docx' AS filename FROM orders",
    "s7_sample_for_audit": f"WITH {POINTS} SELECT point_id, doc_type, syndrome, diagnosis_class, section FROM points ORDER BY point_id LIMIT 25",
    "p1_validate_periods": f"WITH {STAYS} SELECT stay_id, reason IS NULL AS ok, reason FROM stays",
    "p2_plan_days": f"WITH {STAYS} SELECT stay_id, CAST(day AS VARCHAR) AS day, day_number, doc_type FROM days",
    "p3_plan_counts": f"WITH {STAYS} SELECT stay_id, count(*) FILTER (WHERE doc_type = 'daily') AS daily, count(*) FILTER (WHERE doc_type = 'exam_10d') AS exams FROM days GROUP BY 1",
    "p4_sentences": r"WITH a AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1))) AS x FROM documents), b AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS x FROM a), c AS (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM b) SELECT doc_id AS stay_id, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM c WHERE x <> '' GROUP BY 1",
    "p8_nearest_days": f"WITH {STAYS}, i AS (SELECT row_number() OVER () AS line, l_orderkey, l_linenumber AS item, CAST(l_shipdate AS DATE) AS anchor FROM lineitem), m AS (SELECT line, stay_id, item, anchor, day FROM i JOIN days ON stay_id = l_orderkey) SELECT stay_id, item, CAST(anchor AS VARCHAR) AS anchor, CAST(arg_min(day, (abs(day - anchor), day)) AS VARCHAR) AS day FROM m GROUP BY line, stay_id, item, m.anchor",
    "p10_period_percent": f"WITH {STAYS}, x AS (SELECT stay_id, day, row_number() OVER (PARTITION BY stay_id ORDER BY day) AS place, count(*) OVER (PARTITION BY stay_id) AS n FROM days) SELECT stay_id, CAST(day AS VARCHAR) AS day, place, CASE WHEN n > 1 THEN round((place - 1) * 100.0 / (n - 1)) ELSE 0.0 END AS percent FROM x",
    "p16_weekend_notes": f"WITH {STAYS} SELECT stay_id, CAST(day AS VARCHAR) AS day, CAST(day - CASE WHEN dayofweek(day) = 0 THEN 1 ELSE 0 END AS VARCHAR) AS weekend_from FROM days WHERE day_number > 3 AND dayofweek(day) IN (0, 6)",
    "p17_weekend_recap": f"WITH {STAYS} SELECT stay_id, CAST(day AS VARCHAR) AS day FROM days WHERE dayofweek(day) = 1 AND day - 2 >= date_from",
    "e2_l2_normalize": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS component_sum FROM embeddings",
    "e3_cosine_top_k": f"WITH {POINTS}, m AS (SELECT q.point_id AS query_id, p.point_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score FROM points q JOIN points p ON q.point_id % 10 = 0) SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, point_id, round(score, 6) AS score FROM m WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 12) DESC, point_id) QUALIFY row_number() OVER w <= 7",
    "e5_fallback_levels": f"WITH {POINTS}, {ASKED} SELECT query_id, 0 AS level, doc_type, syndrome, diagnosis_class, section FROM asked UNION ALL SELECT query_id, 1, doc_type, NULL, diagnosis_class, NULL FROM asked UNION ALL SELECT query_id, 3, NULL, NULL, NULL, NULL FROM asked WHERE diagnosis_class IS NULL",
    "e6_retrieve_with_fallback": f"{_LEVELS}, m AS (SELECT l.query_id, l.level, p.point_id, list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score FROM {_MET}), b AS (SELECT *, min(level) OVER (PARTITION BY query_id) AS best FROM m), c AS (SELECT * FROM b WHERE level = best) SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, point_id, round(score, 6) AS score, level FROM c WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 12) DESC, point_id) QUALIFY row_number() OVER w <= 7",
    "e8_collection_count": f"WITH {POINTS} SELECT doc_type, count(*) AS n FROM points GROUP BY 1",
}
