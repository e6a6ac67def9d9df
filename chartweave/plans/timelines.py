"""Queries of stays told day by day over narratives made from orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.operators import briefs as b
from chartweave.operators import timeline as t
from chartweave.operators.redaction import spread
from chartweave.plans.corpus import STAYS, days_of, iso
from chartweave.plans.history import table

#: Sentences of the narratives; an order's keys choose among them.
SENTENCES = (
    "В первые дни беспокоен, затем стал спокойнее, рисовал в игровой комнате, общался с детьми.",
    "С первых дней плакал и просился домой.",
    "В выходные приезжала мама.",
    "Во вторник осмотрен педагогом.",
    "В субботу и воскресенье смотрел телевизор в игровой.",
    "Встреча с мамой прошла хорошо.",
    "На свидании с отцом был весел.",
    "Получает рисперидон с 04.03 2 мг/сут, от 45.13 нет, с 07.03.96 3 мг/сут.",
    "Перед выпиской ровный.",
    "На 5-й день и на 5 день пел.",
    "Вчера капризничал из-за замечаний.",
    "Ест самостоятельно.",
    "Стаскивает простыни с кроватей, обирает обувь у детей, хаотично бегает по палате.",
    "Состояние стало лучше, стал более послушным.",
    "Речь остается трудной для понимания, остается трудным в общении.",
    "Находится под наблюдением персонала.",
    "С 3.11.1995 по назначению дежурного ходил на прогулку.",
    "В начале и в конце дня бегает по коридору, играет с мячом.",
)


def narrative(order: str = "o_orderkey", customer: str = "o_custkey") -> str:
    """The narrative as SQL that both engines read."""
    parts = [f"CASE WHEN ({order} * {i + 3} + {customer}) % 3 = 0 THEN '{s}' END" for i, s in enumerate(SENTENCES)]
    return f"concat_ws(' ', {', '.join(parts)})"


def told_stays(spark, d, deal=spread):
    o = deal(table(spark, d, "orders"))
    pick = lambda key, *values: F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("stay_id"), F.when(key % 11 != 0, F.expr(narrative())).alias("narrative"), pick(who, "positive", "stable", "wavy", "negative", None).alias("overall_dynamics"), pick(key, "F20", " лёгк УО ", "F71", "не говорит", None).alias("diagnosis"),
        pick(who, "ровный", "", None).alias("final_state"), pick(key, "", "сонапакс с 10.01 и далее", None).alias("key_medications"), pick(who, None, "depressive").alias("leading_syndrome"), pick(key, "male", "").alias("patient_sex"),
        F.array_compact(F.array(F.when(key % 2 == 0, "ecg_eeg"), F.when(who % 2 == 0, "therapy_change"), F.when(who % 3 == 0, "visit"))).alias("notable_events"),
    )


def p6_narrative_facts(spark, d):
    return t.narrative_facts(told_stays(spark, d))


def p8_assign_timed(spark, d):
    return t.assign_timed(told_stays(spark, d), days_of(spark, d)).select("stay_id", "pos", "sentence", iso("day"))


def by_stay(orders):
    """Orders dealt by stay before they have narratives, which then travel no more."""
    return t.dealt(orders, "o_orderkey")


def p14_compile_briefs(spark, d):
    rows = t.compile_briefs(told_stays(spark, d, by_stay), days_of(spark, d))
    joined = [F.array_join(c, "|").alias(c) for c in ("mood_detail", "contact", "observations", "forbidden")]
    return rows.select("stay_id", iso("day"), "phase", "role", "speech_level", "mood", "behavior", *joined, "therapy_today", "include_final_state", "weekend_recap", "weekend_note")


def p14_brief_texts(spark, d):
    """The briefs of all days as texts for prompts."""
    made = t.compile_briefs(told_stays(spark, d, by_stay), days_of(spark, d), kept=("diagnosis", "patient_sex", "final_state"))
    return b.brief_text(made.withColumn("discharge", F.lit(None).cast("string"))).select("stay_id", iso("day"), "brief")


def p16_duty_notes(spark, d):
    return days_of(spark, d).select("stay_id", iso("day"), t.weekend_duty_note(F.col("day"), F.col("day_number")).alias("note")).where("note IS NOT NULL")


def p19_context_for_day(spark, d):
    return t.context_for_day(told_stays(spark, d), days_of(spark, d)).select("stay_id", iso("day"), "context")


def p20_day_answers(spark, d):
    rows = days_of(spark, d).select("stay_id", "day", "doc_type").join(t.sorted_side(told_stays(spark, d)), "stay_id")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("answers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.day_answers(rows).select("stay_id", iso("day"), told.alias("answers"), F.array_join("interventions", ",").alias("interventions"))


def p20_brief_answers(spark, d):
    """Answers of days with a brief laid over them."""
    rows = days_of(spark, d).join(t.sorted_side(told_stays(spark, d)), "stay_id")
    key = F.col("stay_id")
    brief = {
        "behavior": F.when(key % 3 == 0, "restless").when(key % 3 == 1, "violates").otherwise("ordered"), "mood": F.lit("unstable"), "contact": F.array(F.lit("isolated"), F.lit("calm_distance")),
        "mood_detail": F.when(key % 2 == 0, F.array(F.lit("lability"))).otherwise(F.array().cast("array<string>")), "therapy_today": F.lit(None).cast("string"), "weekend_note": t.weekend_duty_note(F.col("day"), F.col("day_number")),
        "observations": F.array_compact(F.array(F.when(key % 4 == 0, "Проявил Агрессию"), F.when(key % 5 == 0, "Капризничал днём"), F.lit("спал"))),
    }
    told = F.array_join(F.transform(F.array_sort(F.map_entries("answers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    kept = F.split(F.lit("additional_info,additional_info_detail,behavior,behavior_detail,contact,mood,mood_detail"), ",")
    out = t.day_answers(rows.withColumns(brief)).withColumn("answers", F.map_filter("answers", lambda k, v: F.array_contains(kept, k)))
    return out.select("stay_id", iso("day"), told.alias("answers"))


QUERIES = {f.__name__: f for f in (p14_brief_texts, p20_brief_answers, p6_narrative_facts, p8_assign_timed, p14_compile_briefs, p16_duty_notes, p19_context_for_day, p20_day_answers)}

_ANY = lambda words: "regexp_matches(low, '" + "|".join(words) + "')"
_NAMED = [f"CASE WHEN {_ANY(words)} THEN {d - 1} END" for d, words in t.WEEKDAY_WORDS.items()]
_TIMED = (*t.WEEKEND_WORDS, *t.VISIT_WORDS, *t.EARLY_WORDS, *t.LATE_WORDS, *(w for words in t.WEEKDAY_WORDS.values() for w in words), *t.OTHER_WORDS)
_SATURDAY = "CASE dayofweek(day) WHEN 6 THEN day WHEN 0 THEN day - 1 END"
_ANSWERS = {
    "appetite": "'preserved'", "attention_memory": "CASE WHEN exam THEN 'no_gross' END", "behavior": "'ordered'", "comorbidities": "CASE WHEN exam THEN 'none' END", "contact": "'calm_distance'", "criticism": "CASE WHEN exam THEN 'formal' END",
    "diagnosis": "CASE k % 5 WHEN 0 THEN 'F20' WHEN 1 THEN 'лёгк УО' WHEN 2 THEN 'F71' WHEN 3 THEN 'не говорит' END", "diary_date": "CAST(day AS VARCHAR)", "dynamics": "CASE c % 5 WHEN 0 THEN 'positive' WHEN 3 THEN 'worsening' ELSE 'no_change' END",
    "events": "CASE WHEN detail <> '' THEN 'therapy_correction' END", "events_detail": "nullif(detail, '')", "intellect": "CASE WHEN exam THEN CASE k % 5 WHEN 1 THEN 'mild_id' WHEN 2 THEN 'reduced' ELSE 'age_norm' END END", "mood": "'even'", "neuro_status": "CASE WHEN exam THEN 'no_acute' END",
    "patient_sex": "CASE WHEN k % 2 = 0 THEN 'male' END", "period_dynamics": "CASE WHEN exam THEN CASE c % 5 WHEN 0 THEN 'improvement' WHEN 2 THEN 'slight_improvement' WHEN 3 THEN 'no_improvement' ELSE 'no_change' END END", "physical_status": "CASE WHEN exam THEN 'unremarkable' END",
    "prescriptions": "CASE WHEN exam THEN 'see_list' END", "productive_symptoms": "'not_detected'", "sleep": "'not_disturbed'", "suicidal": "CASE WHEN exam THEN 'not_detected' END", "syndrome": "CASE WHEN exam THEN CASE WHEN c % 2 = 1 THEN 'depressive' ELSE 'anxious' END END", "thinking": "CASE WHEN exam THEN 'no_gross' END", "tolerance": "'good'",
}
SQL = {
    "p16_duty_notes": f"WITH {STAYS}, x AS (SELECT stay_id, day, {_SATURDAY} AS a FROM days WHERE day_number > 3 AND dayofweek(day) IN (0, 6)) SELECT stay_id, CAST(day AS VARCHAR) AS day, 'за период выходных дней с ' || day(a) || CASE WHEN month(a) = month(a + 1) THEN '' ELSE strftime(a, '.%m') END || '-' || day(a + 1) || strftime(a + 1, '.%m') || ' под наблюдением дежурного мед персонала.' AS note FROM x",
    "p19_context_for_day": f"""WITH {STAYS}, n AS (SELECT o_orderkey AS stay_id, string_split(replace({narrative()}, '. ', '.' || chr(1)), chr(1)) AS xs FROM orders WHERE o_orderkey % 11 <> 0),
 s AS (SELECT stay_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS pos FROM n), l AS (SELECT *, lower(x) AS low FROM s),
 r AS (SELECT *, NOT {_ANY(_TIMED)} AS always, {_ANY(t.WEEKEND_WORDS)} AS weekend, [{', '.join(_NAMED)}] AS named, {_ANY(t.VISIT_WORDS)} OR regexp_matches(low, 'родительск дн|на свидан') OR (regexp_matches(low, '{t.MEETING}') AND regexp_matches(low, '{t.RELATIVE}')) AS visit, {_ANY(t.EARLY_WORDS)} AS early, {_ANY(t.LATE_WORDS)} AS late, regexp_extract(low, 'на\\s+(\\d+)[- ]?[йо]?\\s*день', 1) AS number, contains(low, 'вчера') AS before FROM l),
 d AS (SELECT *, count(*) OVER (PARTITION BY stay_id) AS total FROM days),
 k AS (SELECT d.stay_id, d.day, x, pos, always, always OR CASE WHEN weekend THEN dayofweek(day) IN (0, 6) WHEN len(list_filter(named, lambda v: v IS NOT NULL)) > 0 THEN coalesce(list_contains(named, CAST(dayofweek(day) AS INT)), false) WHEN visit THEN dayofweek(day) = 3 WHEN early THEN day_number <= 3 WHEN late THEN day_number >= total - 1 WHEN number <> '' THEN day_number = TRY_CAST(number AS INT) WHEN before THEN day_number >= 2 ELSE true END AS fits FROM d LEFT JOIN r USING (stay_id))
 SELECT stay_id, CAST(day AS VARCHAR) AS day, coalesce(string_agg(x, ' ' ORDER BY NOT always, pos) FILTER (WHERE fits), '') AS context FROM k GROUP BY 1, 2""",
    "p20_brief_answers": f"""WITH {STAYS}, x AS (SELECT stay_id, day, stay_id % 3 AS b, {_SATURDAY} AS a, day_number FROM days), y AS (SELECT *, CASE WHEN a IS NOT NULL AND day_number > 3 THEN 'за период выходных дней с ' || CASE WHEN month(a) = month(a + 1) THEN day(a) || '-' || strftime(a + 1, '%-d.%m') ELSE strftime(a, '%-d.%m') || '-' || strftime(a + 1, '%-d.%m') END || ' под наблюдением дежурного мед персонала.' END AS note FROM x)
 SELECT stay_id, CAST(day AS VARCHAR) AS day, concat_ws(';', CASE WHEN note IS NOT NULL THEN 'additional_info=present;additional_info_detail=' || note END, 'behavior=' || CASE b WHEN 0 THEN 'restless' WHEN 1 THEN 'violates' ELSE 'ordered' END,
  CASE WHEN b < 2 AND (stay_id % 4 = 0 OR stay_id % 5 = 0) THEN 'behavior_detail=' || concat_ws(',', CASE WHEN stay_id % 4 = 0 THEN 'aggression' END, CASE WHEN stay_id % 5 = 0 THEN 'protest' END) END, 'contact=isolated,calm_distance', 'mood=unstable', CASE WHEN stay_id % 2 = 0 THEN 'mood_detail=lability' END) AS answers FROM y""",
    "p20_day_answers": f"""WITH {STAYS}, x AS (SELECT d.stay_id, day, doc_type = 'exam_10d' AS exam, o_orderkey AS k, o_custkey AS c FROM days d JOIN orders ON o_orderkey = d.stay_id),
 y AS (SELECT *, concat_ws(', ', CASE WHEN k % 2 = 0 THEN 'инструментальное обследование (ЭКГ/ЭЭГ)' END, CASE WHEN c % 2 = 0 THEN 'изменение терапии' END, CASE WHEN c % 3 = 0 THEN 'visit' END) AS seen FROM x),
 z AS (SELECT *, CASE WHEN exam THEN concat_ws(' ', CASE WHEN seen <> '' THEN 'В данный период: ' || seen || '.' END, CASE WHEN k % 3 = 1 THEN 'Терапия: сонапакс с 10.01 и далее.' END) ELSE '' END AS detail FROM y)
 SELECT stay_id, CAST(day AS VARCHAR) AS day, concat_ws(';', {', '.join(f"'{k}=' || {v}" for k, v in sorted(_ANSWERS.items()))}) AS answers, CASE WHEN exam THEN concat_ws(',', CASE WHEN k % 2 = 0 THEN 'ecg,eeg' END, CASE WHEN c % 2 = 0 THEN 'lab' END) ELSE '' END AS interventions FROM z""",
}
