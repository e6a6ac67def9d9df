"""What a planned day is like, stay parameters inside answers, and prompts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.operators import text as t
from chartweave.operators.chunks import NO_SAMPLES
from chartweave.operators.stays import period_percent

# Up to which share of the period a phase lasts; the first three days are admission.
PHASES = ((35, "field"), (55, "titration"), (80, "improving"))
LAST_PHASE, FIRST_PHASE, FIRST_DAYS = "residual", "admission", 3


def day_phase_role(days: DataFrame) -> DataFrame:
    """``days`` with ``place``, ``percent`` of the period (100 if it has one day), ``phase`` and
    ``role``: exams, then events on the last day and every third one, quiet days between."""
    rows = period_percent(days)
    last = F.max("place").over(_stay())
    percent = F.when(last == 1, F.lit(100.0)).otherwise(F.col("percent"))
    by_share = F.coalesce(*[F.when(F.col("percent") < F.lit(top), F.lit(name)) for top, name in PHASES], F.lit(LAST_PHASE))
    phase = F.when(F.col("day_number") <= FIRST_DAYS, FIRST_PHASE).otherwise(by_share)
    event = (F.col("place") == last) | ((F.col("place") - 1) % 3 == 0)
    role = F.when(F.col("doc_type") == "exam_10d", "exam").when(event, "event").otherwise("quiet")
    return rows.withColumn("percent", percent).withColumns({"phase": phase, "role": role})


def _stay():
    from pyspark.sql import Window

    return Window.partitionBy("stay_id")


def interpolate_state(days: DataFrame, dynamics: str = "dynamics") -> DataFrame:
    """``days`` (phase, role, dynamics of the stay) with ``mood``, ``mood_detail`` and
    ``behavior`` of every day."""
    phase, told = F.col("phase"), F.coalesce(F.col(dynamics), F.lit(""))
    late, early = phase.isin("improving", "residual"), phase.isin("admission", "field")
    even = (told == "stable") | (~told.isin("negative") & late)
    mood = F.when(even, "even").otherwise("unstable")
    detail = (
        F.when(told == "negative", F.array(F.lit("irritability")))
        .when(even, F.array().cast("array<string>"))
        .when((told == "wavy") | ~early, F.array(F.lit("lability")))
        .otherwise(F.array(F.lit("irritability"), F.lit("lability")))
    )
    behavior = (
        F.when((phase == "admission") | ((phase == "field") & (F.col("role") == "event")), "restless")
        .when(phase == "residual", "ordered")
        .otherwise("minor_remarks")
    )
    return days.withColumns({"mood": mood, "mood_detail": detail, "behavior": behavior})


#: Fixed value: the entry of the answers that holds a stay's parameters.
META_KEY = "__batch_meta__"
NEEDED, OPTIONAL = ("admission_date", "date_from", "date_to"), ("estimated_discharge", "director_context", "session_title")


def unpack_batch_meta(requests: DataFrame, answers: str = "answers", key: str = META_KEY) -> DataFrame:
    """``requests`` with the parameters of a stay out of its answers' JSON, as strings. All are
    null unless the three dates are strings; the others are '' unless they are strings."""
    whole = F.try_parse_json(F.col(answers))

    def string(name: str) -> Column:
        value = F.try_variant_get(whole, f"$.{key}.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(whole, f"$.{key}.{name}", "string"))

    given = F.lit(True)
    for name in NEEDED:
        given = given & string(name).isNotNull()
    return requests.withColumns({n: F.when(given, string(n)) for n in NEEDED} | {n: F.when(given, F.coalesce(string(n), F.lit(""))) for n in OPTIONAL})


def assemble_prompts(responses: DataFrame, lines: DataFrame, samples: DataFrame, prose: DataFrame) -> DataFrame:
    """(response_id, system, user): the type's prose and skeleton (``prose``: doc_type, system,
    skeleton, no_lines, no_samples), the day's brief where ``responses`` has one; the samples
    (rank, block) and the answers (ord, line) as bullets. A response has few of both."""

    def listed(rows: DataFrame, order: str, value: str, mark: str, between: str, name: str) -> DataFrame:
        entries = F.sort_array(F.collect_list(F.struct(F.col(order), F.concat(F.lit(mark), F.col(value)).alias("entry"))))
        return rows.where(F.col(value) != "").groupBy("response_id").agg(F.array_join(F.transform(entries, lambda e: e["entry"]), between).alias(name))

    rows = responses.join(F.broadcast(prose), "doc_type")
    rows = rows.join(listed(lines, "ord", "line", "- ", "\n", "_lines"), "response_id", "left").join(listed(samples, "rank", "block", "", "\n\n", "_samples"), "response_id", "left")
    brief = F.col("brief") if "brief" in responses.columns else F.lit(None).cast("string")
    system = F.concat_ws("\n\n", "system", "skeleton", F.nullif(brief, F.lit("")))
    user = F.concat_ws("\n\n", F.coalesce("_samples", "no_samples"), F.coalesce("_lines", "no_lines"))
    return rows.select("response_id", system.alias("system"), user.alias("user"))


#: Prose of prompts, in our own words, with the captions of the forms: what a deployment does
#: not give itself.
PROSE = {
    "daily": ("Ты пишешь ежедневный осмотр врача по ответам опросника. Держись строк бланка и их порядка, пиши только то, что следует из ответов и брифа дня.", ("Дата:", "Жалобы:", "Психический статус:", "Соматический статус:", "Диагноз:", "Назначения:", "Дополнительные сведения о заболевании:")),
    "exam_10d": ("Ты пишешь осмотр за десять дней с этапным эпикризом по ответам опросника. Держись строк бланка и их порядка, эпикриз охватывает период до этого дня.", ("Дата:", "Жалобы:", "Психический статус (его изменение):", "Диагноз:", "Синдром:", "Назначения:", "План лечения:", "Этапный эпикриз:")),
}
NO_LINES = "- (ответы не предоставлены)"


def default_prose(spark: SparkSession) -> DataFrame:
    """The table that ``assemble_prompts`` takes, from ``PROSE``."""
    rows = [(kind, system, "\n".join(captions), NO_LINES, NO_SAMPLES) for kind, (system, captions) in PROSE.items()]
    return spark.createDataFrame(rows, "doc_type string, system string, skeleton string, no_lines string, no_samples string")


# Words of a brief, our own. What stands for a missing diagnosis is a fixed value.
PHASE_WORDS = {"admission": "первые сутки, адаптация", "field": "поведение неустойчиво, лечение ещё не держит", "titration": "терапия подбирается", "improving": "на лечении спокойнее", "residual": "остаются отдельные трудности"}
ROLE_WORDS = {"quiet": "тихий, одно-два наблюдения", "event": "событийный, два-три наблюдения", "exam": "осмотр за десять дней с эпикризом"}
CALENDAR_WORDS = {"weekday": "будний день", "wednesday": "среда, день встреч с родственниками", "saturday": "суббота, выходной", "sunday": "воскресенье, выходной", "monday": "понедельник"}
NO_DIAGNOSIS = "[ОСНОВНОЙ_ДИАГНОЗ]"
SEX_WORDS = {"male": "Пиши о пациенте в мужском роде.", "female": "Пиши о пациентке в женском роде."}
#: Forbidden items that a brief names, and characters of each.
FORBIDDEN_ITEMS, FORBIDDEN_CHARS = 12, 180


def brief_text(rows: DataFrame, name: str = "brief") -> DataFrame:
    """``rows`` (a brief's columns, ``periods``: days of the period, and of the stay: diagnosis,
    patient_sex, final_state, discharge) with the brief as one text for a prompt: a line for
    each thing that the day's note must hold, keep to or leave out. Nulls and blanks leave
    their line out or take the line for what is not known; no line is empty."""

    def given(column: Column | str) -> Column:
        return F.nullif(t.trim_space(F.coalesce(column, F.lit(""))), F.lit(""))

    def named(words: dict[str, str], column: str) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.col(column)), F.col(column))

    def bullets(head: str, items: Column) -> Column:
        some = F.filter(items, lambda x: F.coalesce(x.rlike(r"(?U)\S"), F.lit(False)))
        return F.when(F.size(some) > 0, F.concat(F.lit(head), F.array_join(F.transform(some, lambda x: F.concat(F.lit("\n• "), x)), "")))

    line = lambda head, value: F.concat(F.lit(head), value, F.lit("."))
    weekend, note, monday = F.col("calendar").isin("saturday", "sunday"), given("weekend_note"), F.col("calendar") == "monday"
    lines = [
        F.concat(F.lit("Сутки в стационаре: "), F.col("day_number").cast("string"), F.lit("; день периода: "), F.col("place").cast("string"), F.lit(" из "), F.col("periods").cast("string"), F.lit(" ("), F.format_string("%.0f", F.col("percent").cast("double")), F.lit("%).")),
        line("Фаза: ", named(PHASE_WORDS, "phase")), line("День: ", named(ROLE_WORDS, "role")), line("Календарь: ", named(CALENDAR_WORDS, "calendar")),
        F.when(weekend & note.isNotNull(), F.concat(F.lit("В дополнительные сведения о заболевании внеси дословно: «"), note, F.lit("» — и только туда."))),
        F.when(weekend & note.isNull(), F.lit("Выходной первых трёх дней: дополнительных сведений о заболевании нет.")),
        F.when(monday, F.when(F.coalesce("weekend_recap", F.lit(False)), "Скажи одной-двумя фразами о прошедших выходных, если они следуют из наблюдений.").otherwise("О выходных не пиши: в этом периоде их ещё не было.")),
        F.concat(F.lit("Диагноз дословно: "), F.coalesce(given("diagnosis"), F.lit(NO_DIAGNOSIS)), F.lit(". Других кодов не подставляй.")),
        F.when(F.coalesce(F.col("speech_level"), F.lit("unknown")) != "unknown", line("Уровень речи: ", F.col("speech_level"))),
        F.try_element_at(F.create_map(*[F.lit(x) for pair in SEX_WORDS.items() for x in pair]), F.coalesce("patient_sex", F.lit(""))),
        F.when(given("discharge").isNotNull(), line("Ориентировочная выписка: ", given("discharge"))),
        bullets("Сегодня опиши только это:", F.col("observations")),
        F.coalesce(line("Назначения сегодня меняются: ", given("therapy_today")), F.lit("Назначения: см. лист назначений; о смене схемы не пиши.")),
        F.when(F.coalesce("include_final_state", F.lit(False)), line("Состояние к концу периода: ", given("final_state"))).otherwise(F.lit("Состояния к выписке сегодня не называй.")),
        bullets("Сегодня не повторяй и не пересказывай:", F.transform(F.slice("forbidden", 1, FORBIDDEN_ITEMS), lambda x: F.substring(x, 1, FORBIDDEN_CHARS))),
        F.lit("Не выдумывай событий, встреч, прогулок, консультаций и смены лечения, которых здесь нет."),
    ]
    return rows.withColumn(name, F.array_join(F.array_compact(F.array(*lines)), "\n"))
