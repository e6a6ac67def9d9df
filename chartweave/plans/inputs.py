"""Queries of what comes in: files, pages asked for, entities from outside, answers, sections,
soft pieces, faults of a questionnaire, ids seen before; and their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from chartweave.operators import answers as a
from chartweave.operators import chunks as c
from chartweave.operators import history as h
from chartweave.operators import redaction as r
from chartweave.plans.corpus import VARIED, varied_notes
from chartweave.plans.history import table
from chartweave.sources import files
from chartweave.sources.scratch import shared_folder
from chartweave.streaming import streams


def s1_scan_corpus(spark, d):
    """The folder's own files, without their content."""
    found = files.scan_corpus(spark, d, ("parquet",))
    return found.select(F.regexp_extract("path", r"([^/]+(?:\.parquet/[^/]+)?)$", 1).alias("name"), "suffix", "length")


def _office(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    for batch in batches:
        rows = []
        for number, text in zip(batch["doc_id"], batch["text"], strict=True):
            out = io.BytesIO()
            lines = (escape("".join(ch for ch in line if ch.isprintable())) for line in (text or "").split("\n"))
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(f'<w:p><w:r><w:t>{x}</w:t></w:r></w:p>' for x in lines)}</w:body></w:document>")
            rows.append((str(number), "docx", out.getvalue() if number % 10 else b"broken"))
        yield pd.DataFrame(rows, columns=["path", "suffix", "content"])


def s2_extract_text(spark, d):
    """Documents packed as office files, every tenth broken, and their text taken out again."""
    packed = table(spark, d, "documents").select("doc_id", "text").mapInPandas(_office, "path string, suffix string, content binary")
    return files.extract_text(packed).select("path", F.md5("text").alias("digest"), "extract_error")


def f10_clamp_pages(spark, d):
    limit, offset = F.col("o_orderkey") % 300 - 20, F.col("o_custkey") % 10 - 5
    clamped = h.clamped_page(limit, offset)
    return table(spark, d, "orders").select("o_orderkey", clamped["limit"].cast("int").alias("limit"), clamped["offset"].cast("int").alias("offset"))


def r8_outside_entities(spark, d):
    """Words that a model found stand for persons; one overlaps a longer date, one is protected."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("зубру дали "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" отдых, F20.0"))
    found = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("person").alias("type")), F.struct(F.lit(13).alias("start"), F.lit(15).alias("end"), F.lit("person").alias("type")), F.struct(F.lit(29).alias("start"), F.when(key % 2 == 0, 31).otherwise(34).alias("end"), F.lit("person").alias("type")))
    docs = table(spark, d, "orders").select("o_orderkey", text.alias("text"), F.when(key % 3 > 0, found).otherwise(F.slice(found, 1, 0)).alias("found"))
    return r.redact_documents(r.spread(docs), entities="found").select("o_orderkey", "text", "removed_count")


def r15_redact_answers(spark, d):
    o = table(spark, d, "orders")
    pick = F.array(F.lit("ему 14 лет"), F.lit("спал ровно"), F.lit(None).cast("string"), F.lit(" "), F.lit("тел. 8 812 123-45-67"))
    rows = o.select((F.col("o_custkey")).alias("response_id"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("qid"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 4).cast("int")).alias("idx"), F.lit("custom").alias("kind"), F.lit(None).cast("string").alias("code"), F.get(pick, (F.col("o_orderkey") % 5).cast("int")).alias("custom_text"))
    passed, _ = r.redact_answers(r.spread(rows))
    return passed.select("response_id", "qid", "idx", "custom_text")


PARTS = [("complaints", "Жалобы"), ("diagnosis", "Диагноз")]


def c3_split_sections(spark, d):
    found = varied_notes(spark, d).where("text IS NOT NULL").select("doc_ref", F.posexplode(c.sections(F.col("text"), PARTS)).alias("place", "s"))
    return found.select("doc_ref", "place", "s.section", "s.text")


def c4_soft_split(spark, d):
    docs = r.spread(table(spark, d, "documents").select("doc_id", "text"))
    pieces = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(c.soft_split(F.col("text"))).alias("place", "piece"))
    return pieces.select("doc_id", "place", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


def q12_schema_faults(spark, d):
    """Parts as a questionnaire full of faults."""
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "select").when(F.col("p_size") % 3 == 1, "boolean").otherwise("text")
    questions = p.select(F.col("p_brand").alias("doc_type"), F.col("p_name").alias("qid"), kind.alias("qtype"))
    options = p.where("p_size % 4 = 0").select(F.col("p_name").alias("qid"), F.col("p_type").alias("value"))
    value = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, F.col("p_type")).otherwise("true")
    child = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("no "), "p_name")).otherwise(F.col("p_name"))
    return a.check_schema(questions, options, p.select(F.col("p_name").alias("parent_qid"), value.alias("if_value"), child.alias("child_qid"))).distinct()


def w2_seen_points(spark, d):
    """Ids of events as they come, each once, whatever the time between."""
    rows = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    base = f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}"
    streams.stream_new_points(rows.select(F.concat_ws("-", "user_id", "event_type").alias("point_id")), base, buckets=8).awaitTermination()
    return streams.seen_points(spark, base)


QUERIES = {f.__name__: f for f in (s1_scan_corpus, s2_extract_text, f10_clamp_pages, r8_outside_entities, r15_redact_answers, c3_split_sections, c4_soft_split, q12_schema_faults, w2_seen_points)}

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_DONE = "CASE o_orderkey % 5 WHEN 0 THEN 'ему [ВОЗРАСТ]' WHEN 1 THEN 'спал ровно' WHEN 3 THEN ' ' WHEN 4 THEN 'тел. [ТЕЛЕФОН]' END"
# the end of the piece that begins behind ``start`` characters
_END = f"""CASE WHEN {{0}} + {c.MOST} >= n THEN n ELSE coalesce(list_max(list_filter([list_max(list_filter(stops, lambda x: x < {{0}} + {c.MOST})), list_max(list_filter(breaks, lambda x: x <= {{0}} + {c.MOST}))], lambda x: x - {{0}} > {c.MOST // 2 + 1})), {{0}} + {c.MOST}) END"""
SQL = {
    "s2_extract_text": r"SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 <> 0 THEN md5(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) END AS digest, CASE WHEN doc_id % 10 = 0 THEN 'BadZipFile' END AS extract_error FROM documents",
    "f10_clamp_pages": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 300 - 20 BETWEEN 1 AND 200 THEN o_orderkey % 300 - 20 ELSE 20 END AS INT) AS \"limit\", CAST(greatest(o_custkey % 10 - 5, 0) AS INT) AS \"offset\" FROM orders",
    "r8_outside_entities": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN '[ФИО]' ELSE 'зубру' END || ' дали [ДАТА] отдых, F20.0' AS text, CASE WHEN o_orderkey % 3 > 0 THEN 2 ELSE 1 END AS removed_count FROM orders",
    "r15_redact_answers": f"SELECT o_custkey AS response_id, 'q' || o_orderkey AS qid, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 4 AS INT) END AS idx, {_DONE} AS custom_text FROM orders",
    "c3_split_sections": f"WITH {VARIED}, p AS (SELECT doc_ref, string_split(regexp_replace(text, '\\n(Жалобы|Диагноз)', chr(1) || '\\1', 'g'), chr(1)) AS xs FROM varied WHERE text IS NOT NULL), e AS (SELECT doc_ref, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS place FROM p) SELECT doc_ref, CAST(place AS INT) AS place, CASE WHEN x LIKE 'Жалобы%' THEN 'complaints' WHEN x LIKE 'Диагноз%' THEN 'diagnosis' ELSE 'full' END AS section, {_TRIM.format('x')} AS text FROM e",
    "c4_soft_split": rf"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS line, doc_id, text, length(text) AS n, string_split(text, '') AS cs FROM documents WHERE text IS NOT NULL),
 m AS (SELECT line, doc_id, text, n, list_filter(range(1, n), lambda i: cs[i] = '.' AND cs[i + 1] = ' ') AS stops, list_filter(range(1, n + 1), lambda i: cs[i] = chr(10)) AS breaks FROM t),
 w AS (SELECT line, 0 AS k, 0 AS s, {_END.format("0")} AS e FROM m UNION ALL SELECT w.line, w.k + 1, greatest(w.e - {c.OVERLAP}, w.s + 1), {_END.format(f"greatest(w.e - {c.OVERLAP}, w.s + 1)")} FROM w JOIN m USING (line) WHERE w.e < m.n),
 p AS (SELECT m.doc_id, line, w.k, CASE WHEN max(w.k) OVER (PARTITION BY line) = 0 THEN text ELSE {_TRIM.format("text[w.s + 1:w.e]")} END AS piece, max(w.k) OVER (PARTITION BY line) = 0 AS alone FROM w JOIN m USING (line))
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY line ORDER BY k) - 1 AS INT) AS place, CAST(length(piece) AS INT) AS chars, md5(piece) AS digest FROM p WHERE alone OR piece <> ''""",
    "q12_schema_faults": """WITH q AS (SELECT p_brand AS doc_type, p_name AS qid, CASE p_size % 3 WHEN 0 THEN 'select' WHEN 1 THEN 'boolean' ELSE 'text' END AS qtype FROM part), o AS (SELECT p_name AS qid, p_type AS value FROM part WHERE p_size % 4 = 0),
 c AS (SELECT p_name AS parent_qid, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN p_type ELSE 'true' END AS if_value, CASE WHEN p_size % 7 = 0 THEN 'no ' || p_name ELSE p_name END AS child_qid FROM part)
 SELECT 'duplicate_id' AS problem, qid, doc_type AS detail FROM q GROUP BY doc_type, qid HAVING count(*) > 1 UNION SELECT 'no_options', qid, qtype FROM q WHERE qtype = 'select' AND qid NOT IN (SELECT qid FROM o)
 UNION SELECT 'dangling_child', parent_qid, child_qid FROM c WHERE child_qid NOT IN (SELECT qid FROM q) UNION SELECT 'empty_trigger', parent_qid, child_qid FROM c WHERE if_value = ''
 UNION SELECT 'unknown_trigger', parent_qid, if_value FROM c WHERE if_value <> '' AND NOT EXISTS (SELECT 1 FROM o WHERE o.qid = parent_qid AND o.value = if_value) AND NOT (if_value IN ('true', 'false') AND EXISTS (SELECT 1 FROM q WHERE q.qid = parent_qid AND qtype = 'boolean'))""",
    "w2_seen_points": "SELECT DISTINCT user_id || '-' || event_type AS point_id FROM events",
}
