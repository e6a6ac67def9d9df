"""Queries of chunks, reports and streams over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chartweave.operators import chunks as c
from chartweave.operators import redaction as r
from chartweave.operators import stays as s
from chartweave.operators import text as t
from chartweave.functions import personal_data as known
from chartweave.plans.corpus import DONE, NOTES, REMOVED, VARIED, notes, varied_notes
from chartweave.plans.history import THREADS, table
from chartweave.sources.scratch import stash
from chartweave.streaming import streams

HEADINGS = [("complaints", r"Общее"), ("diagnosis", r"\[ДАТА\]")]
MARKER = r"^\[(?:ДАТА|ПЕРИОД)\]"
DYNAMICS = [("улучш", "better"), ("ухудш", "worse"), ("без динамики", "same")]
LABELS = [("date", "dates"), ("period", "dates"), ("phone", "phones")]


def c9_chunk_documents(spark, d):
    docs = r.spread(table(spark, d, "documents").select("doc_id", "text"))
    return c.chunk_documents(docs, "doc_id", MARKER, HEADINGS, "осмотр", "тревожн", [("тревожн", "тревожный")], DYNAMICS)


def c9_chunk_notes(spark, d):
    """Notes are short, so each record of 40 characters or more is one chunk."""
    return c.chunk_documents(notes(spark, d), "doc_ref", MARKER, HEADINGS, "осмотр", "тревожн", [("тревожн", "тревожный")], DYNAMICS).select("doc_ref", "doc_type", "section", "syndrome", "diagnosis_class", "dynamics", "text")


def _redacted(spark, d):
    """Redacted notes, written once for the queries that read them more than once."""
    return stash(r.redact_documents(varied_notes(spark, d, r.spread)).select("doc_ref", "text", "removed_by_type", "clean"), "redacted")


def c12_ingest_stats(spark, d):
    docs = _redacted(spark, d)
    return c.ingest_stats(docs, t.paragraphs(r.gate_split(docs)[0].select("doc_ref", "text")), "doc_ref")


def e7_format_samples(spark, d):
    """Turns as samples; users' ones are blank in every third conversation, the first in all."""
    s = table(spark, d, "conversations")
    blank = (F.col("turn") == 1) | ((F.col("conv_id") % 3 == 0) & (F.col("turn") != 2))
    rows = s.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.when(blank, " ").otherwise(F.col("text")).alias("text"), F.col("role").alias("syndrome"), F.when(F.col("turn") % 2 == 0, "F2x").alias("diagnosis_class"), F.when(F.col("turn") % 2 == 1, "").otherwise("same").alias("dynamics"))
    return c.format_samples(rows.distinct())


def r14_label_counts(spark, d):
    return c.label_counts(r.removed_by_type_report(r.redact_documents(varied_notes(spark, d, r.spread))), spark.createDataFrame(LABELS, "type string, label string"))


def r16_recall_report(spark, d):
    marked = _redacted(spark, d)
    found = marked.select("doc_ref", F.explode("removed_by_type").alias("type", "n"))
    raw = varied_notes(spark, d).where("text IS NOT NULL")
    values = {"date": F.regexp_extract("text", r"\d\d\.\d\d\.\d{4}", 0), "patient": F.lit("Иванов"), "doc_number": F.regexp_extract("text", r"\d{8}", 0), "age": F.lit("14 лет"), "id_doc": F.regexp_extract("text", r"4010 \d{6}", 0)}
    wanted = raw.select("doc_ref", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), v.alias("value")) for k, v in values.items()])).alias("w")).select("doc_ref", "w.*")
    report = c.recall_report(wanted, found, "doc_ref", marked)
    return report.select("doc_ref", "expected", F.round("recall", 6).alias("recall"), F.array_join("missed", ",").alias("missed"), "leaked")


def h8_normalize_titles(spark, d):
    o = table(spark, d, "orders")
    raw = F.concat("o_orderpriority", F.lit(" old"), F.when(F.col("o_orderkey") % 2 == 0, " (FAILED)").otherwise(" (failed) (failed)"))
    return o.select("o_orderkey", c.normalize_title(raw, r"\s*\(failed\)", [("old", "new")]).alias("title"))


def p18_speech_levels(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", c.speech_level(F.col("text"), [("zzz", "sounds"), ("stra", "words"), ("the", "expanded")]).alias("level"))


def p9_anchor_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date_from"), F.date_add(F.to_date("o_orderdate"), 20).alias("date_to"), F.when(F.col("o_orderkey") % 3 == 0, F.to_date(F.lit("1999-09-09"))).alias("own_date"))
    near = c.anchor_dates(o, (F.col("o_orderkey") % 10).cast("double"), F.lit(10.0))
    return o.select("o_orderkey", F.date_format(near, "yyyy-MM-dd").alias("anchor"))


def t9_line_kinds(spark, d):
    docs = varied_notes(spark, d).where("text IS NOT NULL").withColumn("text", F.concat(F.lit("Diagnosis : one: two \n \n"), "text"))
    return c.line_kinds(docs, "doc_ref", ["diagnosis", "жалобы", "Мать"]).groupBy("doc_ref", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"), F.sum(F.length("value")).alias("chars"))


# anchored: a look-ahead tried at every character costs the square of a sentence's length
RULES = [(r"(?s)^(?=.*\bthe\b)(?=.*\band\b)", "contrast"), ("stra", "skip"), ("the", "early")]


def p6_extract_facts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("stay_id"), F.col("text").alias("narrative"))
    return s.extract_facts(s.classify_sentences(s.sentence_rows(docs), RULES, "later")).groupBy("stay_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").cast("long").alias("places"), F.sum(F.length("fact")).alias("chars"))


def p7_dated_snippets(spark, d):
    rows = notes(spark, d).select(F.col("doc_ref").alias("stay_id"), F.concat("text", F.lit(", 5.3 second mark, 31.02.24 no such day, 1.2 short")).alias("narrative"))
    return s.dated_snippets(rows, F.lit(2001)).select("stay_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "snippet")


def _observed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stay_id"), F.to_date("l_shipdate").alias("day"), F.concat("l_returnflag", F.lit("-"), (F.col("l_partkey") % 4).cast("string")).alias("item"), F.col("l_linenumber").alias("pos"))


def p13_take_unused(spark, d):
    seen = _observed(spark, d)
    return s.take_unused(seen.select("stay_id", "day").distinct(), seen.select("stay_id", "item", "pos")).select("stay_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "item")


def p15_forbidden_items(spark, d):
    return s.forbidden_items(_observed(spark, d)).select("stay_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.array_join(F.array_sort("forbidden"), ",").alias("forbidden"))


def t2_exam_stamps(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey") % 4
    given = F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).when(key == 2, F.lit("2024-02-31"))
    return o.select("o_orderkey", t.exam_stamp(given, F.when(key == 2, F.lit("Day of 09.03.2020")).otherwise(F.lit("Day")), F.col("o_orderdate")).alias("stamp"))


def t3_substitutions(spark, d):
    c_ = table(spark, d, "customer")
    values = F.create_map(F.lit("[NAME]"), F.col("c_name"), F.lit("[HEAD]"), F.lit(""), F.lit("[ДАТА]"), F.lit("never"))
    return c_.select("c_custkey", t.apply_substitutions(F.lit("[ДАТА] [ВРЕМЯ] [NAME] [HEAD] [OTHER]"), values, F.lit("day")).alias("text"))


def _events(spark, d):
    kept = spark.read.parquet(f"{d}/events.parquet").schema
    # event times need a zone; sums are told in the session's zone again
    return spark.readStream.schema(kept).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def w2_dedup_points(spark, d):
    seen = _events(spark, d).select("ts", F.concat_ws("-", "user_id", "event_type").alias("point_id"))
    return streams.run_available(streams.dedup_points(seen), "points").select("point_id")


def w5_removed_counts(spark, d):
    rows = _events(spark, d).select("ts", F.col("event_type").alias("type"), F.lit(1).alias("n"))
    done = streams.run_available(streams.removed_counts(rows), "removed")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "type", "removed")


def w3_stream_threads(spark, d):
    """Conversations as they come: a message is an event, every third one a read too."""
    rows = spark.readStream.schema(spark.read.parquet(f"{d}/conversations.parquet").schema).parquet(f"{d}/conversations.parquet*")
    side = F.when(F.col("role") == "user", "user").otherwise("support")
    read = F.when(F.col("turn") % 3 == 1, F.when(F.col("turn") % 2 == 1, "admin_read").otherwise("user_read"))
    told = rows.select(F.col("conv_id").alias("thread_id"), F.col("turn").cast("long").alias("at"), F.col("turn").cast("long").alias("id"), F.col("text").alias("body"), F.explode(F.array_compact(F.array(side, read))).alias("kind"))
    base = f"{streams.shared_folder(spark)}/threads-{uuid.uuid4().hex}"
    streams.stream_threads(told, base).awaitTermination()
    return streams.current_threads(spark, base)


def w4_stream_sessions(spark, d):
    kind = F.when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "error", "logout").when(F.col("event_type") == "purchase", "refresh").otherwise("use")
    rows = _events(spark, d).select(F.floor(F.col("event_id") / 3).alias("session_id"), F.col("user_id").cast("long").alias("doctor_id"), kind.alias("kind"), "ts")
    done = streams.run_available(streams.stream_sessions(rows), "sessions")
    return done.select("session_id", "doctor_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("issued_at", "closed_at")], "reason")


QUERIES = {f.__name__: f for f in (w3_stream_threads, w4_stream_sessions, c9_chunk_documents, c9_chunk_notes, c12_ingest_stats, e7_format_samples, h8_normalize_titles, p6_extract_facts, p7_dated_snippets, p9_anchor_dates, p13_take_unused, p15_forbidden_items, p18_speech_levels, r14_label_counts, r16_recall_report, t2_exam_stamps, t3_substitutions, t9_line_kinds, w2_dedup_points, w5_removed_counts)}

SQL = {
    "c9_chunk_notes": f"""WITH {NOTES}, p AS (SELECT doc_ref, unnest(string_split(replace(replace(text, chr(10) || '[ДАТА]', chr(1) || '[ДАТА]'), chr(10) || '[ПЕРИОД]', chr(1) || '[ПЕРИОД]'), chr(1))) AS text FROM notes)
 SELECT doc_ref, 'daily' AS doc_type, 'full' AS section, CAST(NULL AS VARCHAR) AS syndrome, CASE WHEN text LIKE '%Диагноз: F%' THEN 'F' || regexp_extract(text, 'F(\\d)', 1) || 'x' END AS diagnosis_class, CASE WHEN text LIKE '%улучш%' THEN 'better' WHEN text LIKE '%без динамики%' THEN 'same' END AS dynamics, text FROM p WHERE length(text) >= 40""",
    "c12_ingest_stats": rf"WITH {DONE}, x AS (SELECT clean, trim(done, ' ' || chr(9) || chr(10)) = '' AS bare, greatest(len(list_filter(regexp_split_to_array(done, '\n\s*\n'), lambda p: trim(p, ' ' || chr(9) || chr(10)) <> '')), 1) AS parts FROM done), n AS (SELECT count(*) AS a, count(*) FILTER (WHERE NOT bare) AS b, count(*) FILTER (WHERE bare) AS c, count(*) FILTER (WHERE NOT bare AND NOT clean) AS d, CAST(coalesce(sum(parts) FILTER (WHERE clean), 0) AS BIGINT) AS e, count(*) FILTER (WHERE clean) AS f FROM x) SELECT unnest(['seen', 'extracted', 'skipped_extract', 'blocked_pii', 'chunks_built', 'documents_cut']) AS counter, unnest([a, b, c, d, e, f]) AS value FROM n",
    "e7_format_samples": rf"""WITH s AS (SELECT DISTINCT conv_id, turn, role, CASE WHEN turn = 1 OR (conv_id % 3 = 0 AND turn <> 2) THEN '' ELSE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') END AS text FROM conversations),
 e AS (SELECT conv_id, turn, CASE WHEN text <> '' THEN '--- Образец ' || (turn + 1) || CASE WHEN turn % 2 = 0 THEN ' (' || CASE WHEN coalesce(role, '') <> '' THEN 'syndrome=' || role || ', ' ELSE '' END || 'diagnosis_class=F2x, dynamics=same)' WHEN coalesce(role, '') <> '' THEN ' (syndrome=' || role || ')' ELSE '' END || ' ---' || chr(10) || text END AS entry FROM s)
 SELECT conv_id AS query_id, coalesce(string_agg(entry, chr(10) || chr(10) ORDER BY turn, entry), '{c.BLANK_SAMPLES}') AS block FROM e GROUP BY 1""",
    "h8_normalize_titles": "SELECT o_orderkey, o_orderpriority || ' new' AS title FROM orders",
    "p9_anchor_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1999-09-09' ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 * 2 AS INT) AS VARCHAR) END AS anchor FROM orders",
    "p18_speech_levels": "SELECT doc_id, CASE WHEN lower(text) LIKE '%zzz%' THEN 'sounds' WHEN lower(text) LIKE '%stra%' THEN 'words' WHEN lower(text) LIKE '%the%' THEN 'expanded' ELSE 'unknown' END AS level FROM documents",
    "r14_label_counts": f"WITH {DONE}, removed AS ({REMOVED}) SELECT CASE WHEN type IN ('date', 'period') THEN 'dates' WHEN type = 'phone' THEN 'phones' ELSE type END AS label, CAST(sum(n) AS BIGINT) AS removed FROM removed GROUP BY 1 HAVING sum(n) > 0",
    "r16_recall_report": rf"WITH {DONE}, w AS (SELECT doc_ref, done, unnest(['date', 'patient', 'doc_number', 'age', 'id_doc']) AS type, unnest([n_date, n_patient, n_doc_number, n_age, n_id_doc]) > 0 AS hit, unnest([regexp_extract(text, '\d\d\.\d\d\.\d{{4}}'), 'Иванов', regexp_extract(text, '\d{{8}}'), '14 лет', regexp_extract(text, '4010 \d{{6}}')]) AS value FROM done WHERE text IS NOT NULL) SELECT doc_ref, count(*) AS expected, round(count(*) FILTER (WHERE hit) / 5.0, 6) AS recall, coalesce(string_agg(type, ',' ORDER BY type) FILTER (WHERE NOT hit), '') AS missed, count(*) FILTER (WHERE value <> '' AND contains(done, value)) AS leaked FROM w GROUP BY 1",
    "p6_extract_facts": r"""WITH r AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), '[\x01\n]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS xs FROM documents), e AS (SELECT doc_id AS stay_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM r),
 k AS (SELECT stay_id, pos, CASE WHEN regexp_matches(lower(x), '\bthe\b') AND regexp_matches(lower(x), '\band\b') THEN 'contrast' WHEN lower(x) LIKE '%stra%' THEN 'skip' WHEN lower(x) LIKE '%the%' THEN 'early' ELSE 'later' END AS kind, regexp_replace(x, '[.;]+$', '') AS fact FROM e),
 f AS (SELECT stay_id, kind, min(pos) AS pos, arg_min(fact, pos) AS fact FROM k WHERE kind <> 'skip' GROUP BY stay_id, kind, lower(substr(fact, 1, 48))) SELECT stay_id, kind, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places, CAST(sum(length(fact)) AS BIGINT) AS chars FROM f GROUP BY 1, 2""",
    "p7_dated_snippets": f"""WITH {NOTES} SELECT doc_ref AS stay_id, regexp_replace(text, '(?s)^.*?(\\d\\d)\\.(\\d\\d)\\.(\\d{{4}}).*$', '\\3-\\2-\\1') AS day, regexp_replace(text, '(?s)^.*?\\d\\d\\.\\d\\d\\.\\d{{4}} ', '') || ',' AS snippet FROM notes UNION ALL SELECT doc_ref, '2001-03-05', 'second mark,' FROM notes""",
    "p13_take_unused": "WITH x AS (SELECT l_orderkey AS stay_id, CAST(l_shipdate AS DATE) AS day, l_returnflag || '-' || (l_partkey % 4) AS item, l_linenumber AS pos FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY pos, item) AS n FROM (SELECT stay_id, item, min(pos) AS pos FROM x GROUP BY 1, 2)), y AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY day) AS n FROM (SELECT DISTINCT stay_id, day FROM x)) SELECT y.stay_id, CAST(day AS VARCHAR) AS day, item FROM y JOIN p ON y.stay_id = p.stay_id AND y.n = p.n",
    "p15_forbidden_items": "WITH x AS (SELECT DISTINCT l_orderkey AS stay_id, CAST(l_shipdate AS DATE) AS day, l_returnflag || '-' || (l_partkey % 4) AS item FROM lineitem), y AS (SELECT DISTINCT stay_id, day FROM x) SELECT y.stay_id, CAST(y.day AS VARCHAR) AS day, coalesce(string_agg(DISTINCT o.item, ',' ORDER BY o.item), '') AS forbidden FROM y LEFT JOIN x o ON o.stay_id = y.stay_id AND o.day <> y.day AND NOT EXISTS (SELECT 1 FROM x z WHERE z.stay_id = y.stay_id AND z.day = y.day AND z.item = o.item) GROUP BY y.stay_id, y.day",
    "t2_exam_stamps": f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN '«09» марта 2020 г.' ELSE '«' || strftime(o_orderdate, '%d') || '» ' || {t.MONTHS!r}[month(o_orderdate)] || strftime(o_orderdate, ' %Y г.') END AS stamp FROM orders",
    "t3_substitutions": "SELECT c_custkey, 'day 10 час. 00 мин. ' || c_name || ' [HEAD] [OTHER]' AS text FROM customer",
    "t9_line_kinds": rf"WITH {VARIED}, l AS (SELECT doc_ref, unnest(string_split('Diagnosis : one: two ' || chr(10) || ' ' || chr(10) || text, chr(10))) AS line FROM varied WHERE text IS NOT NULL), h AS (SELECT doc_ref, line, regexp_extract(line, '^\s*([^:]+?)\s*:', 1) AS head FROM l), k AS (SELECT doc_ref, line, head, lower(head) IN ('diagnosis', 'жалобы', 'мать') AS known, regexp_matches(line, '^\s*$') AS bare FROM h) SELECT doc_ref, CASE WHEN bare THEN 'blank' WHEN known THEN 'labelled' ELSE 'text' END AS kind, count(*) AS n, max(head) FILTER (WHERE known) AS label, CAST(sum(length(regexp_replace(CASE WHEN known THEN regexp_replace(line, '^[^:]*:', '') ELSE line END, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS chars FROM k GROUP BY 1, 2",
    "w2_dedup_points": "SELECT DISTINCT user_id || '-' || event_type AS point_id FROM events",
    "w5_removed_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS type, count(*) AS removed FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)",
    "w3_stream_threads": f"WITH {THREADS} SELECT * FROM threads",
    "w4_stream_sessions": """WITH e AS (SELECT event_id // 3 AS session_id, user_id, ts, event_type = 'signup' AS begun FROM events WHERE event_type IN ('signup', 'error', 'purchase')),
 x AS (SELECT session_id, arg_min(user_id, ts) FILTER (WHERE begun) AS doctor_id, min(ts) FILTER (WHERE begun) AS a, min(ts) FILTER (WHERE NOT begun) AS b FROM e GROUP BY 1),
 y AS (SELECT session_id, doctor_id, a, CASE WHEN b < a + INTERVAL 3 DAY THEN greatest(a, b) END AS b FROM x WHERE a IS NOT NULL)
 SELECT session_id, doctor_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS issued_at, strftime(coalesce(b, a + INTERVAL 3 DAY), '%Y-%m-%d %H:%M:%S') AS closed_at, CASE WHEN b IS NULL THEN 'expired' ELSE 'revoked' END AS reason FROM y
 WHERE b IS NOT NULL OR a + INTERVAL 3 DAY + INTERVAL 2 HOUR < (SELECT max(ts) FROM events WHERE event_type IN ('signup', 'error', 'purchase'))""",
}
