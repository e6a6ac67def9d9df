"""Cutting records into chunks with metadata, and the counters of an ingestion run.

Cutting is sequential inside one text, so it is one Arrow-vectorised pass without a shuffle."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.operators import text as t

MOST, OVERLAP, LEAST = 1200, 150, 40


def soft_pieces(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``most`` characters, trimmed; each ends behind the last full stop
    with a blank or the last line end of its second half, where there is one, and the next
    begins ``overlap`` characters before that end."""
    stops = [m.end() for m in re.finditer(r"\.(?= )", text)]  # the blank belongs to the window too
    breaks = [m.end() for m in re.finditer(r"\n", text)]

    def end_of(start: int) -> int:
        limit = start + most
        if limit >= len(text):
            return len(text)
        fit = [*stops[: bisect_right(stops, limit - 1)][-1:], *breaks[: bisect_right(breaks, limit)][-1:]]
        return max([c for c in fit if c - start > most // 2 + 1], default=limit)

    bounds = [(0, end_of(0))]
    while bounds[-1][1] < len(text):
        begin = max(bounds[-1][1] - overlap, bounds[-1][0] + 1)
        bounds.append((begin, end_of(begin)))
    pieces = [text[a:b] if len(bounds) == 1 else text[a:b].strip() for a, b in bounds]
    return [p for p in pieces if p or len(bounds) == 1]


def sections(text: Column, headings: list[tuple[str, str]]) -> Column:
    """array<struct<section, text>>: a line that a heading's pattern starts opens a section,
    what comes before the first is ``full``."""
    any_heading = "|".join(f"(?:{p})" for _, p in headings)
    parts = F.split(text, f"\n(?={any_heading})")
    code = lambda part: F.coalesce(*[F.when(part.rlike(f"^(?:{p})"), F.lit(c)) for c, p in headings], F.lit("full"))
    return F.transform(parts, lambda part: F.struct(code(part).alias("section"), t.trim_space(part).alias("text")))


def record_sections(text: Column, doc_type: Column, headings: list[tuple[str, str]], least: int = LEAST) -> Column:
    """Exams fall into sections, those shorter than ``least`` go; a record without any that
    stays, and every daily one, is one section ``full``."""
    whole = F.array(F.struct(F.lit("full").alias("section"), text.alias("text")))
    long = F.filter(sections(text, headings), lambda s: F.length(s["text"]) >= least)
    return F.when((doc_type == "exam_10d") & (F.size(long) > 0), long).otherwise(whole)


def _cut():
    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if x is None else soft_pieces(x) for x in texts], dtype=object)

    return cut


def soft_split(text: Column) -> Column:
    """array<string>: the soft pieces of a text, null of null."""
    return _cut()(text)


def chunk_documents(docs: DataFrame, key: str, marker: str, headings: list[tuple[str, str]], exam_signal: str, syndrome: str, stems: list[tuple[str, str]], dynamics: list[tuple[str, str]]) -> DataFrame:
    """(key, record, part, pos, doc_type, section, syndrome, diagnosis_class, dynamics, text): the
    chunks of every document. Metadata is read from the whole record. Null, empty and too
    short records have no chunks."""
    any_heading = "|".join(f"(?:{p})" for _, p in headings)
    records = t.split_records(docs, key, marker).withColumn("text", t.trim_space(F.col("text")))
    rows = records.withColumn("doc_type", t.classify_record(F.col("text"), f"^(?:{any_heading})", exam_signal, LEAST)).where("doc_type IS NOT NULL")
    found = F.regexp_extract("text", syndrome, 0)
    meta = rows.withColumns({"syndrome": t.normalize_stems(found, stems), "diagnosis_class": t.icd_class_first(F.col("text")), "dynamics": t.first_rule(F.col("text"), dynamics)})
    parts = meta.select("*", F.posexplode(record_sections(F.col("text"), F.col("doc_type"), headings)).alias("_part", "_s")).drop("text")
    # most sections are one piece; only long ones are cut outside Spark's expressions
    long = F.length("_s.text") > MOST
    pieces = F.when(long, _cut()(F.when(long, F.col("_s.text")))).otherwise(F.array("_s.text"))
    each = parts.select("*", F.posexplode(pieces).alias("_piece", "_text"))
    return each.select(key, "record", F.col("_part").alias("part"), F.col("_piece").alias("pos"), "doc_type", "_s.section", "syndrome", "diagnosis_class", "dynamics", F.col("_text").alias("text"))


def ingest_stats(docs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Counters of a run, one row: ``docs`` after redaction (text, clean), and the chunks made."""
    bare = t.trim_space(F.coalesce("text", F.lit(""))) == ""
    passed = F.coalesce(F.col("clean"), F.lit(False))
    seen = docs.agg(F.count(F.lit(1)).alias("seen"), F.count_if(~bare).alias("extracted"), F.count_if(bare).alias("skipped_extract"), F.count_if(~bare & ~passed).alias("blocked_pii"))
    made = chunks.agg(F.count(F.lit(1)).alias("chunks_built"), F.count_distinct(key).alias("documents_cut"))
    counters = [F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in seen.columns], [F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in made.columns]
    return seen.select(F.inline(F.array(*counters[0]))).unionByName(made.select(F.inline(F.array(*counters[1]))))


# The layout of samples in a prompt, without any and with blank ones only.
SAMPLE_TAGS, SAMPLE_HEAD = ("syndrome", "diagnosis_class", "dynamics"), "--- Образец %d%s ---\n%s"
NO_SAMPLES, BLANK_SAMPLES = "(образцы из корпуса отсутствуют — опирайся только на шаблон и ответы опросника)", "(образцы пусты)"


def format_samples(samples: DataFrame, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """(by, block): retrieved samples (text, syndrome, diagnosis_class, dynamics) in rank order,
    each under its number and what is known of it; blank ones are left out and keep their
    number. A query has at most k samples. A query without any has no row here: its block is
    ``NO_SAMPLES``."""
    known = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}="), F.col(c))) for c in SAMPLE_TAGS])), ", ")
    text = t.trim_space(F.coalesce("text", F.lit("")))
    entry = F.when(text != "", F.format_string(SAMPLE_HEAD, F.col(rank), F.when(known != "", F.concat(F.lit(" ("), known, F.lit(")"))).otherwise(""), text))
    ordered = F.sort_array(F.collect_list(F.when(entry.isNotNull(), F.struct(F.col(rank), entry.alias("entry")))))
    block = F.array_join(F.transform(ordered, lambda x: x["entry"]), "\n\n")
    return samples.groupBy(by).agg(block.alias("_block")).select(by, F.when(F.col("_block") == "", BLANK_SAMPLES).otherwise(F.col("_block")).alias("block"))


def label_counts(removed: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, removed): counts by type under the labels people read; several types can share
    one, zero sums are left out. Types without a label keep their code."""
    named = removed.join(labels, "type", "left").withColumn("label", F.coalesce("label", "type"))
    return named.groupBy("label").agg(F.sum("removed").alias("removed")).where("removed > 0")


def recall_report(expected: DataFrame, found: DataFrame, key: str, redacted: DataFrame | None = None) -> DataFrame:
    """(key, expected, recall, missed) a document: the share of expected types that were found.
    With ``redacted`` (key, text) also ``leaked``: how many of the expected raw ``value``s
    still stand in the document's text."""
    hits = expected.select(key, "type").distinct().join(found.select(key, "type").distinct().withColumn("_hit", F.lit(True)), [key, "type"], "left")
    missed = F.sort_array(F.collect_list(F.when(F.col("_hit").isNull(), F.col("type"))))
    report = hits.groupBy(key).agg(F.count(F.lit(1)).alias("expected"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"), missed.alias("missed"))
    if redacted is None:
        return report
    held = expected.where("value <> ''").select(key, "value").distinct().join(redacted.select(key, "text"), key)
    leaked = held.groupBy(key).agg(F.count_if(F.contains(F.col("text"), F.col("value"))).alias("leaked"))
    return report.join(leaked, key, "left").withColumn("leaked", F.coalesce("leaked", F.lit(0)))


def normalize_title(title: Column, suffix: str, renames: list[tuple[str, str]]) -> Column:
    """A title without its status suffixes, with older words renamed."""
    bare = F.regexp_replace(title, f"(?iu)(?:{suffix})+$", "")
    for old, new in renames:
        bare = F.replace(bare, F.lit(old), F.lit(new))
    return t.trim_space(bare)


def speech_level(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The level of the first rule that matches, ``unknown`` without one."""
    return F.coalesce(t.first_rule(text, rules), F.lit("unknown"))


def anchor_dates(items: DataFrame, position: Column, length: Column, start: str = "date_from", stop: str = "date_to") -> Column:
    """The day an item belongs near: its own date; else by its place in the text, a share of
    the period as large as the share of the text before it."""
    share = F.coalesce(F.try_divide(position, length), F.lit(0.0))
    return F.coalesce(F.col("own_date"), F.date_add(start, F.round(share * F.datediff(stop, start)).cast("int")))


def line_kinds(docs: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(key, pos, kind, label, value): lines are blank, ``labelled`` (a known label and a
    colon) or text."""
    rows = t.lines(docs.select(key, "text")).drop("text")
    head = F.regexp_extract("line", r"^\s*([^:]+?)\s*:", 1)
    known = F.lower(head).isin(*[x.lower() for x in labels])
    kind = F.when(t.trim_space(F.col("line")) == "", "blank").when(known, "labelled").otherwise("text")
    value = F.when(known, F.regexp_replace("line", r"^[^:]*:", "")).otherwise(F.col("line"))
    return rows.select(key, "pos", kind.alias("kind"), F.when(known, head).alias("label"), t.trim_space(value).alias("value"))
