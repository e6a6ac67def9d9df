"""Normalising text and reading metadata out of it, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.operators.history import trim_space

#: Spaces that become a blank, and marks that vanish.
HARD_SPACES, NO_WIDTH = "   ", "﻿​"


def normalize_text(text: Column) -> Column:
    """Hard spaces to blanks, zero-width marks out, line ends to \\n."""
    plain = F.translate(text, HARD_SPACES + NO_WIDTH, " " * len(HARD_SPACES))
    return F.regexp_replace(plain, "\r\n?", "\n")


def fix_typos(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    for wrong, right in pairs:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def source_ref(path: Column) -> Column:
    """A reference that hides the path: src_ and 16 digits of its SHA-256."""
    return F.concat(F.lit("src_"), F.substring(F.sha2(path, 256), 1, 16))


def select_paths(files: DataFrame, name_pattern: str, exclude_pattern: str, folders: list[str], path: str = "path") -> DataFrame:
    """Files whose name matches, or that lie in one of the folders and whose name is not excluded."""
    parts = F.split(F.lower(F.col(path)), "/")
    name = F.element_at(F.split(F.col(path), "/"), -1)
    named = name.rlike("(?iu)" + name_pattern)
    inside = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(f.lower()) for f in folders]))
    return files.where(named | (inside & ~name.rlike("(?iu)" + exclude_pattern)))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a line: ``pos`` from 0 and ``line``."""
    return docs.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


#: What ends a line besides \\n.
LINE_ENDS = "\r\n|[\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"


def split_records(docs: DataFrame, key: str, marker: str, text: str = "text") -> DataFrame:
    """(key, record, text): a record starts at each line that matches ``marker`` (anchored by
    ^); text before the first one is a record of its own; a document without a marked line
    falls at blank lines. Blank records go, numbers of the others stay. Every row is cut by
    itself, so rows that repeat a key or have none do not mix. No shuffle."""
    whole = F.regexp_replace(F.col(text), LINE_ENDS, "\n")
    start = marker.removeprefix("^")
    parts = F.when(whole.rlike(f"(?m)^(?:{start})"), F.split(whole, f"\n(?={start})")).otherwise(F.split(whole, r"\n\s*\n"))
    return docs.select(F.col(key), F.posexplode(parts).alias("record", text)).where(trim_space(F.col(text)) != "")


def count_headings(text: Column, heading: str) -> Column:
    """Lines that are section headings."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(heading)))


def classify_record(text: Column, heading: str, exam_signal: str, least: int = 40) -> Column:
    """exam_10d with the signal and two headings, daily otherwise; null below ``least`` characters."""
    exam = text.rlike(exam_signal) & (count_headings(text, heading) >= 2)
    return F.when(F.length(text) < least, F.lit(None)).when(exam, "exam_10d").otherwise("daily")


def icd_class_first(text: Column) -> Column:
    """Class of the first code of a letter and two digits, if that letter is F (Latin or Cyrillic)."""
    code = F.regexp_extract(text, r"(?U)\b([A-ZА-Я])(\d)\d(?:\.\d+)?\b", 1)
    digit = F.regexp_extract(text, r"(?U)\b([A-ZА-Я])(\d)\d(?:\.\d+)?\b", 2)
    return F.when(code.isin("F", "Ф"), F.concat(F.lit("F"), digit, F.lit("x")))


def diagnosis_class_any(text: Column) -> Column:
    """Class of the first F code anywhere, in any case."""
    digit = F.regexp_extract(text, r"(?iuU)\b[FФ](\d)\d", 1)
    return F.when(digit != "", F.concat(F.lit("F"), digit, F.lit("x")))


def normalize_stems(value: Column, stems: list[tuple[str, str]]) -> Column:
    """The canonical form of the longest stem that starts the value; other values in lower
    case; null and blank values are null."""
    low = F.lower(trim_space(value))
    rules = [F.when(F.startswith(low, F.lit(stem)), F.lit(form)) for stem, form in sorted(stems, key=lambda x: -len(x[0]))]
    return F.when(low != "", F.coalesce(*rules, low))


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that is found."""
    return F.coalesce(*[F.when(text.rlike("(?iu)" + p), F.lit(v)) for p, v in rules])


def point_id(text: Column, doc_type: Column, section: Column, source: Column, namespace: str) -> Column:
    """UUID of version 5 over the digest of text, type, section and source."""
    digest = F.sha2(F.concat_ws("\u0001", text, doc_type, section, source), 256)
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(digest, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a paragraph (``pos``, ``paragraph``): parts between blank lines, trimmed; a
    text without any is one empty paragraph."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), trim_space), lambda p: p != "")
    return docs.select("*", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))).alias("pos", "paragraph")).drop(text)


def export_batch_text(children: DataFrame) -> DataFrame:
    """(parent_request_id, text): finished children with content, oldest first, each header,
    blank line, body, between rules. A parent has a bounded number of days."""
    rows = children.where((F.col("status") == "done") & (F.col("content") != ""))
    block = F.concat(F.col("header"), F.lit("\n\n"), F.col("content"), F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("created_at", "id", block.alias("block"))))
    return rows.groupBy("parent_request_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n---\n\n").alias("text"))


def export_filename(doc_type: Column, day: Column, extension: str = "docx") -> Column:
    return F.concat(F.lit("diary_"), doc_type, F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit("." + extension))


#: The months as they stand in a date.
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()


def exam_stamp(diary_date: Column, title: Column, created_at: Column) -> Column:
    """The day of the examination in its official form: the date of the answers (ISO or
    day.month.year), else that in the title, else the day the document was made."""

    def dotted(text: Column) -> Column:
        return F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{2}\.\d{2}\.\d{4})", 1), F.lit("")), "dd.MM.yyyy")

    iso = F.try_to_date(F.regexp_extract(diary_date, r"^\d{4}-\d{2}-\d{2}$", 0), "yyyy-MM-dd")
    day = F.coalesce(iso, dotted(diary_date), dotted(title), F.to_date(created_at))
    return official_date(day)


def official_date(day: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.concat(F.lit("«"), F.date_format(day, "dd"), F.lit("» "), month, F.lit(" "), F.date_format(day, "yyyy"), F.lit(" г."))


def rewrite_date_headers(text: Column) -> Column:
    """Lines of a date and a time in digits in their official form; no such day, no change."""
    header = r"^(\d{2}\.\d{2}\.\d{4})\s+время:\s+(\d{1,2}):(\d{2})$"

    def rewritten(line: Column) -> Column:
        plain = trim_space(F.replace(line, F.lit("**"), F.lit("")))
        part = lambda n: F.regexp_extract(plain, header, n)
        day = F.try_to_date(F.nullif(part(1), F.lit("")), "dd.MM.yyyy")
        return F.coalesce(F.concat(official_date(day), F.lit(" время: "), F.lpad(part(2), 2, "0"), F.lit(" час. "), part(3), F.lit(" мин.")), line)

    # most lines have no time: they are not taken apart
    timed = lambda x: F.contains(F.replace(x, F.lit("**"), F.lit("")), F.lit("время:"))
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(timed(line), rewritten(line)).otherwise(line)), "\n")


def case_number_line(text: Column, case_number: Column, daily: Column) -> Column:
    """Texts that are not daily notes with one case-number line: in place of the first there
    is, the others go; else in front. Without a number the line stays open."""
    bare = trim_space(F.regexp_replace(F.coalesce(case_number, F.lit("")), r"^\s*ИБ [№N]", ""))
    line = F.concat(F.lit("ИБ №"), F.when(F.contains(bare, F.lit("[")), "").otherwise(bare))
    lines = F.split(text, "\n")
    own = lambda x: x.rlike(r"(?iu)^\s*ИБ [№N]")
    first = F.array_position(F.transform(lines, own), F.lit(True))
    placed = F.filter(F.transform(lines, lambda x, i: F.when(~own(x), x).when(i + 1 == first, line)), lambda x: x.isNotNull())
    return F.when(daily, text).when(first > 0, F.array_join(placed, "\n")).otherwise(F.concat(line, F.lit("\n"), text))


def build_substitutions(documents: DataFrame, doctors: DataFrame, day: Column, clock: str = "10 час. 00 мин.") -> DataFrame:
    """``documents`` (doctor_id, case_number) with ``substitutions``, a map from placeholders to
    the official date, the time and the fields of the doctor's profile; blank fields are left
    out, a position does not repeat that the doctor attends."""
    d = doctors.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("full_name", "position", "head_full_name", "head_position", "head_institution")])
    rows = documents.join(d, F.col("doctor_id") == F.col("_id"), "left")
    position = F.regexp_replace("_position", r"(?iu)^\s*лечащий\s+врач\s*[,.\-–—:]?\s*", "")
    fields = {"[ДАТА]": official_date(day), "[ВРЕМЯ]": F.lit(clock), "[ФИО_ВРАЧА]": F.col("_full_name"), "[ДОЛЖНОСТЬ_ВРАЧА]": position, "[ФИО_ЗАВ_ОТДЕЛЕНИЕМ]": F.col("_head_full_name"), "[ДОЛЖНОСТЬ_ЗАВ_ОТДЕЛЕНИЕМ]": F.col("_head_position"), "[ЛУ]": F.col("_head_institution"), "[НОМЕР_ИБ]": F.col("case_number")}
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), trim_space(v).alias("value")) for k, v in fields.items()]), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return rows.withColumn("substitutions", F.map_from_entries(entries)).select(*documents.columns, "substitutions")


def batch_filename(documents: DataFrame, by: str, day: str, extension: str = "docx") -> DataFrame:
    """(by, filename) of a combined export: its first and last day, no personal data."""
    span = documents.groupBy(by).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return span.select(by, F.concat(F.lit("diaries_batch_"), F.date_format("a", "yyyy-MM-dd"), F.lit("_to_"), F.date_format("b", "yyyy-MM-dd"), F.lit("." + extension)).alias("filename"))


def apply_substitutions(text: Column, values: Column, stamp: Column, clock: str = "10 час. 00 мин.") -> Column:
    """Placeholders of the map ``values`` filled, date and time by ``stamp`` and ``clock``
    before all others; blank values are skipped, unknown placeholders stay."""
    fixed = F.replace(F.replace(text, F.lit("[ДАТА]"), stamp), F.lit("[ВРЕМЯ]"), F.lit(clock))
    pairs = F.filter(F.coalesce(F.map_entries(values), F.array().cast("array<struct<key:string,value:string>>")), lambda e: (e["key"] != "") & (F.coalesce(e["value"], F.lit("")) != ""))
    return F.aggregate(F.array_sort(pairs), fixed, lambda done, e: F.replace(done, e["key"], e["value"]))
