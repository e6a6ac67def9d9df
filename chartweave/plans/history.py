"""Queries of chartweave.operators.history over the driver's tables, and their SQL.

Orders stand for requests, line items for the children of a batch, customers for doctors,
conversations for support threads, events for sessions, feedback and audit counters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.operators import history as h
from chartweave.operators import paging

# -- tables ------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Top-level requests (orders) and their children (line items)."""
    top = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doctor_id"), F.lit(None).cast("long").alias("parent_request_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "done").otherwise("pending").alias("status"),
        F.col("o_orderpriority").alias("title_safe"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 7).alias("anonymizer_removed_count"),
        F.concat(F.lit("model-"), (F.col("o_custkey") % 3).cast("string")).alias("llm_model_used"),
    )
    kids = table(spark, d, "lineitem").select(
        (F.lit(1_000_000_000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit(None).cast("long").alias("doctor_id"), F.col("l_orderkey").alias("parent_request_id"),
        F.when(F.col("l_linestatus") == "F", "failed").otherwise("done").alias("status"), F.col("l_returnflag").alias("title_safe"), F.col("l_shipdate").alias("created_at"),
        F.lit(0).cast("long").alias("anonymizer_removed_count"), F.lit("model-0").alias("llm_model_used"),
    )
    return top.unionByName(kids)


REQUESTS = """requests AS (
 SELECT o_orderkey AS id, o_custkey AS doctor_id, CAST(NULL AS BIGINT) AS parent_request_id,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'pending' END AS status, o_orderpriority AS title_safe, o_orderdate AS created_at,
  o_orderkey % 7 AS anonymizer_removed_count, 'model-' || (o_custkey % 3) AS llm_model_used FROM orders
 UNION ALL
 SELECT 1000000000 + l_orderkey * 10 + l_linenumber, NULL, l_orderkey, CASE l_linestatus WHEN 'F' THEN 'failed' ELSE 'done' END, l_returnflag, l_shipdate, 0, 'model-0' FROM lineitem)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("text "), F.col("o_orderkey").cast("string")).alias("content_anonymized"), (F.col("o_orderkey") % 500).alias("tokens_used"), F.lit("daily").alias("document_type_code")
    )


DOCUMENTS = "docs AS (SELECT o_orderkey AS request_id, 'text ' || o_orderkey AS content_anonymized, o_orderkey % 500 AS tokens_used, 'daily' AS document_type_code FROM orders WHERE o_orderkey % 3 = 0)"


def doctors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("position"),
        (F.col("c_acctbal") > 0).alias("is_active"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), F.when(F.col("role") == "user", "user").otherwise("support").alias("sender_role"),
        F.col("text").alias("body"), F.col("conv_id").alias("sender_id"),
    )


def threads(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    reads = m.where("created_at % 3 = 1").select("thread_id", F.when(F.col("created_at") % 2 == 1, "admin").otherwise("user").alias("who"), F.col("created_at").alias("read_at"))
    return h.fold_threads(m, reads)


THREADS = r"""msgs AS (SELECT conv_id AS thread_id, turn AS created_at, CASE WHEN role = 'user' THEN 'user' ELSE 'support' END AS sender_role, text AS body FROM conversations),
 reads AS (SELECT thread_id, max(created_at) FILTER (WHERE created_at % 2 = 1) AS a, max(created_at) FILTER (WHERE created_at % 2 = 0) AS u FROM msgs WHERE created_at % 3 = 1 GROUP BY 1),
 folded AS (SELECT m.thread_id, max(created_at) AS last_message_at, arg_max(body, created_at) AS body,
   count(*) FILTER (WHERE sender_role = 'user' AND (a IS NULL OR created_at > a)) AS unread_by_admin,
   count(*) FILTER (WHERE sender_role = 'support' AND (u IS NULL OR created_at > u)) AS unread_by_user
  FROM msgs m LEFT JOIN reads r ON m.thread_id = r.thread_id GROUP BY 1),
 threads AS (SELECT thread_id, last_message_at, CASE WHEN length(flat) <= 140 THEN flat ELSE substr(flat, 1, 140) || '…' END AS last_message_preview, unread_by_admin, unread_by_user
  FROM (SELECT *, regexp_replace(regexp_replace(body, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS flat FROM folded))"""


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of feedback: request by event, doctor by user."""
    return table(spark, d, "events").select(
        (F.col("event_id") % 997).alias("request_id"), F.col("user_id").alias("doctor_id"), F.col("event_id").alias("id"), F.floor(F.col("value") % 7).cast("int").alias("rating"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit(" \n")).alias("comment"), F.col("props").alias("quote"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )


FEEDBACK = "fb AS (SELECT event_id % 997 AS request_id, user_id AS doctor_id, event_id AS id, CAST(floor(value % 7) AS INT) AS rating, event_type AS comment, trim(props) AS quote, ts FROM events)"


def session_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "error", "logout").when(F.col("event_type") == "purchase", "refresh").otherwise("use")
    return table(spark, d, "events").select((F.col("event_id") % 500).alias("session_id"), F.col("user_id").alias("doctor_id"), kind.alias("kind"), "ts", F.col("event_id").alias("id"))


SESSIONS = """log AS (SELECT event_id % 500 AS session_id, user_id AS doctor_id, event_id AS id, ts,
 CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' WHEN 'purchase' THEN 'refresh' ELSE 'use' END AS kind FROM events)"""

# -- queries -----------------------------------------------------------------------------


def h1_history_list(spark, d):
    return h.history_list(requests(spark, d), limit=50, offset=10).select("id", "doctor_id", "title_safe", "status", "created_at", "children_count", "total")


def h1_children_of_all(spark, d):
    return h.with_children(requests(spark, d)).select("id", "title_safe", "children_count")


def h1_page_directory(spark, d):
    """All pages of 20 of every doctor's requests, by their first key."""
    rows = paging.page_directory(h.top_level_only(requests(spark, d)), "doctor_id", paging.NEWEST, 20)
    return rows.select("doctor_id", "page", "total", "rows", "created_at", F.col("id").alias("first_id"))


def h1_history_after(spark, d):
    """The page behind a key in the middle of the year."""
    key = {"created_at": datetime(1996, 7, 1), "id": 0}
    return paging.history_after(requests(spark, d), None, key, 200).select("id", "doctor_id", "created_at", "children_count")


def h2_history_detail(spark, d):
    return h.history_detail(h.top_level_only(requests(spark, d)), documents(spark, d)).select("id", "status", "content_anonymized", "tokens_used")


def h3_history_children(spark, d):
    """Every second child has a document."""
    made = table(spark, d, "lineitem").where("l_linenumber % 2 = 0").select((F.lit(1_000_000_000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string")).alias("text"))
    docs = made.groupBy("request_id").agg(F.min("text").alias("content_anonymized"), F.lit(1).cast("long").alias("tokens_used"))
    return h.history_children(requests(spark, d), docs).select("parent_request_id", "id", "position", "content_anonymized")


def h4_merge_documents(spark, d):
    new = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(
        F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("exam_10d").alias("document_type_code"), F.lit("new").alias("content_anonymized"), F.lit(1).cast("long").alias("tokens_used")
    )
    return h.merge_documents(documents(spark, d), new)


def h5_patch_requests(spark, d):
    patches = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 8 == 0, "").otherwise("renamed").alias("title_safe"), F.lit("").alias("status"))
    return h.patch_requests(h.top_level_only(requests(spark, d)), patches).select("id", "title_safe", "status")


def h6_delete_cascade(spark, d):
    ids = table(spark, d, "orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("id"))
    left = h.delete_cascade(requests(spark, d), ids, {"documents": documents(spark, d)})
    return left["requests"].select(F.lit("request").alias("kind"), "id").unionByName(left["documents"].select(F.lit("document").alias("kind"), F.col("request_id").alias("id")))


def h7_batch_status(spark, d):
    return h.batch_status(requests(spark, d))


def h9_status_labels(spark, d):
    return requests(spark, d).groupBy(h.status_label(F.col("status")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def h10_feedback_latest(spark, d):
    return h.feedback_latest(feedback(spark, d)).select("request_id", "doctor_id", "rating", "quote", "created_at", "updated_at")


def h11_feedback_inbox(spark, d):
    rows = h.feedback_inbox(h.feedback_latest(feedback(spark, d)), doctors(spark, d), h.top_level_only(requests(spark, d)))
    return rows.select("request_id", "doctor_id", "display_name", "title_safe", "rating", "updated_at")


def h12_fold_threads(spark, d):
    return threads(spark, d)


def h14_thread_inbox(spark, d):
    t = threads(spark, d).withColumn("doctor_id", F.col("thread_id") % 100)
    rows = h.thread_inbox(t, doctors(spark, d))
    return h.page(rows, F.col("unread_by_admin").desc(), F.col("last_message_at").desc(), F.col("thread_id"), limit=50, usual=50, most=100).select("thread_id", "display_name", "unread_by_admin", "last_message_at")


def h15_support_summary(spark, d):
    return h.support_summary(threads(spark, d))


def h16_thread_messages(spark, d):
    m = messages(spark, d).withColumn("sender_id", F.col("thread_id") % 100)
    return h.thread_messages(m, doctors(spark, d)).select("thread_id", "position", "display_name", "sender_role", F.length("body").alias("chars"))


def h17_rotate_sessions(spark, d):
    return h.rotate_sessions(session_events(spark, d))


def h17_last_logins(spark, d):
    return h.last_logins(session_events(spark, d))


def h18_update_profiles(spark, d):
    patches = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.concat(F.lit("Dr "), "c_name")).alias("full_name"), F.lit(None).cast("string").alias("position"))
    return h.update_profiles(doctors(spark, d), patches).select("id", "display_name", "full_name", "position")


def h19_upload_log(spark, d):
    p = table(spark, d, "pages")
    uploads = p.select(F.col("page_id").alias("id"), F.col("url").alias("original_filename"))
    results = p.where("page_id % 4 <> 0").select(
        F.col("page_id").alias("upload_id"), (F.col("page_id") % 5 == 0).alias("blocked"), F.when(F.col("page_id") % 7 == 0, "broken").alias("error"), F.floor(F.length("html") / F.lit(1200)).alias("chunks")
    )
    return h.upload_log(uploads, results).select("id", "original_filename", "status", "chunks_count")


def h20_usage_rollup(spark, d):
    return h.usage_rollup(requests(spark, d), documents(spark, d))


def h21_register_doctors(spark, d):
    c = table(spark, d, "customer")
    incoming = c.select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 9 == 0, "nobody").otherwise(F.concat(F.lit("  User"), (F.col("c_custkey") % 400).cast("string"), F.lit("@Example.org "))).alias("email"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_name")).alias("display_name"))
    existing = c.where("c_custkey < 30").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("email"))
    return h.register_doctors(existing, incoming).select("row_id", "email", F.trim("display_name").alias("display_name"), "reason")


def f4_owner_top_level(spark, d):
    return h.scope_to_owner(h.top_level_only(requests(spark, d)), 42).select("id", "doctor_id", "status")


def f5_validate_feedback(spark, d):
    return h.validate_feedback(feedback(spark, d)).groupBy("ok", "reason", "comment").agg(F.count(F.lit(1)).alias("n"))


def f6_validate_message(spark, d):
    rows = messages(spark, d).withColumn("body", F.when(F.col("created_at") % 4 == 3, " \n ").otherwise(F.repeat("body", 9)))
    return h.validate_message(rows).select("thread_id", "id", "ok", "reason")


def f7_validate_upload(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, ".DOCX").otherwise(".pdf")).alias("path"), ((F.length("html") - 1000) * 9000).alias("length"))
    return h.validate_upload(rows).select("page_id", "ok", "reason")


def f8_active_sessions(spark, d):
    s = h.rotate_sessions(session_events(spark, d).withColumn("session_id", F.col("id"))).withColumn("expires_at", F.col("issued_at") + F.expr("INTERVAL 3 DAYS"))
    return h.active_sessions(s, doctors(spark, d), F.lit("2024-01-02 12:00:00").cast("timestamp")).select("session_id", "doctor_id")


def f9_search_titles(spark, d):
    return h.search_titles(h.top_level_only(requests(spark, d)), "urg").select("id", "title_safe")


def f9_search_many_titles(spark, d):
    """Texts of documents as titles; searched for are all first words of the benchmark's items."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.split("text", " ")[0].alias("query"))
    titles = rows.withColumn("title_safe", F.left("text", F.lit(80)))
    return paging.search_many_titles(titles, paging.title_index(titles), asked).select("query", "id", F.md5("title").alias("title"))


def h13_message_preview(spark, d):
    return messages(spark, d).select("thread_id", "id", h.message_preview(F.col("body")).alias("preview"))


def p21_days_to_resume(spark, d):
    planned = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stay_id"), F.col("l_linenumber").alias("day"))
    kids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stay_id"), F.col("l_linenumber").alias("day"), F.when(F.col("l_linestatus") == "F", "done").otherwise("failed").alias("status"), F.when(F.col("l_returnflag") == "A", "text").otherwise(" ").alias("content"))
    return h.days_to_resume(planned, kids)


QUERIES = {
    f.__name__: f
    for f in (
        h1_history_list, h1_children_of_all, h1_page_directory, h1_history_after, f9_search_many_titles, h2_history_detail, h3_history_children, h4_merge_documents, h5_patch_requests, h6_delete_cascade, h7_batch_status, h9_status_labels,
        h10_feedback_latest, h11_feedback_inbox, h12_fold_threads, h13_message_preview, h14_thread_inbox, h15_support_summary, h16_thread_messages, h17_rotate_sessions, h17_last_logins,
        h18_update_profiles, h19_upload_log, h20_usage_rollup, h21_register_doctors, f4_owner_top_level, f5_validate_feedback, f6_validate_message, f7_validate_upload, f8_active_sessions,
        f9_search_titles, p21_days_to_resume,
    )
}

_COUNTS = "kids AS (SELECT parent_request_id AS p, count(*) AS n FROM requests WHERE parent_request_id IS NOT NULL GROUP BY 1)"
_DOCTORS = "doctors AS (SELECT c_custkey AS id, c_name AS display_name FROM customer)"
_LATEST = f"{FEEDBACK}, latest AS (SELECT request_id, doctor_id, arg_max(rating, (ts, id)) AS rating, arg_max(quote, (ts, id)) AS quote, min(ts) AS created_at, max(ts) AS updated_at FROM fb GROUP BY 1, 2)"

SQL = {
    "h1_history_list": f"WITH {REQUESTS}, {_COUNTS} SELECT id, doctor_id, title_safe, status, created_at, coalesce(n, 0) AS children_count, (SELECT count(*) FROM orders) AS total FROM requests LEFT JOIN kids ON p = id WHERE parent_request_id IS NULL ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10",
    "h1_children_of_all": f"WITH {REQUESTS}, {_COUNTS} SELECT id, title_safe, coalesce(n, 0) AS children_count FROM requests LEFT JOIN kids ON p = id WHERE parent_request_id IS NULL",
    "h1_page_directory": f"WITH {REQUESTS}, n AS (SELECT doctor_id, created_at, id, row_number() OVER (PARTITION BY doctor_id ORDER BY created_at DESC, id DESC) - 1 AS k, count(*) OVER (PARTITION BY doctor_id) AS total FROM requests WHERE parent_request_id IS NULL) SELECT doctor_id, k // 20 AS page, total, least(20, total - k) AS rows, created_at, id AS first_id FROM n WHERE k % 20 = 0",
    "h1_history_after": f"WITH {REQUESTS}, {_COUNTS} SELECT id, doctor_id, created_at, coalesce(n, 0) AS children_count FROM requests LEFT JOIN kids ON p = id WHERE parent_request_id IS NULL AND (created_at, id) < (TIMESTAMP '1996-07-01', 0) ORDER BY created_at DESC, id DESC LIMIT 200",
    "f9_search_many_titles": "SELECT q.query, d.doc_id AS id, md5(left(d.text, 80)) AS title FROM (SELECT DISTINCT lower(trim(split_part(text, ' ', 1))) AS query FROM benchmark WHERE text IS NOT NULL) q JOIN documents d ON contains(lower(left(d.text, 80)), q.query)",
    "h2_history_detail": f"WITH {REQUESTS}, {DOCUMENTS} SELECT id, status, content_anonymized, tokens_used FROM requests LEFT JOIN docs ON request_id = id WHERE parent_request_id IS NULL",
    "h3_history_children": f"WITH {REQUESTS}, made AS (SELECT 1000000000 + l_orderkey * 10 + l_linenumber AS request_id, min(l_returnflag || '-' || l_linenumber) AS content FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1) SELECT parent_request_id, id, row_number() OVER (PARTITION BY parent_request_id ORDER BY created_at, id) AS position, coalesce(content, '') AS content_anonymized FROM requests LEFT JOIN made ON request_id = id WHERE parent_request_id IS NOT NULL",
    "h4_merge_documents": f"WITH {DOCUMENTS}, inc AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'exam_10d' END AS t FROM orders WHERE o_orderkey % 5 = 0) SELECT coalesce(inc.request_id, docs.request_id) AS request_id, coalesce(nullif(t, ''), document_type_code) AS document_type_code, CASE WHEN inc.request_id IS NOT NULL THEN 'new' ELSE content_anonymized END AS content_anonymized, CASE WHEN inc.request_id IS NOT NULL THEN 1 ELSE tokens_used END AS tokens_used FROM docs FULL JOIN inc ON docs.request_id = inc.request_id",
    "h5_patch_requests": f"WITH {REQUESTS} SELECT id, CASE WHEN id % 4 = 0 AND id % 8 <> 0 THEN 'renamed' ELSE title_safe END AS title_safe, status FROM requests WHERE parent_request_id IS NULL",
    "h6_delete_cascade": f"WITH {REQUESTS}, {DOCUMENTS} SELECT 'request' AS kind, id FROM requests WHERE coalesce(parent_request_id, id) % 10 <> 3 OR (parent_request_id IS NOT NULL AND parent_request_id NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'document', request_id FROM docs WHERE request_id % 10 <> 3",
    "h7_batch_status": f"WITH {REQUESTS} SELECT parent_request_id, count(*) AS days, count(*) FILTER (WHERE status = 'failed') AS failed_days, CASE WHEN count(*) = count(*) FILTER (WHERE status = 'failed') THEN 'failed' ELSE 'done' END AS status, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN ' · ошибок: ' || count(*) FILTER (WHERE status = 'failed') ELSE '' END AS title_suffix FROM requests WHERE parent_request_id IS NOT NULL GROUP BY 1",
    "h9_status_labels": f"WITH {REQUESTS} SELECT CASE status WHEN 'done' THEN 'Готово' WHEN 'failed' THEN 'Ошибка' ELSE 'В работе' END AS label, count(*) AS n FROM requests GROUP BY 1",
    "h10_feedback_latest": f"WITH {_LATEST} SELECT * FROM latest",
    "h11_feedback_inbox": f"WITH {_LATEST}, {_DOCTORS} SELECT request_id, doctor_id, display_name, o_orderpriority AS title_safe, rating, updated_at FROM latest JOIN doctors d ON d.id = doctor_id JOIN orders ON o_orderkey = request_id",
    "h12_fold_threads": f"WITH {THREADS} SELECT * FROM threads",
    "h13_message_preview": r"SELECT conv_id AS thread_id, turn AS id, CASE WHEN length(flat) <= 140 THEN flat ELSE substr(flat, 1, 140) || '…' END AS preview FROM (SELECT *, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS flat FROM conversations)",
    "h14_thread_inbox": f"WITH {THREADS}, {_DOCTORS} SELECT thread_id, display_name, unread_by_admin, last_message_at FROM threads JOIN doctors d ON d.id = thread_id % 100 ORDER BY unread_by_admin DESC, last_message_at DESC, thread_id LIMIT 50",
    "h15_support_summary": f"WITH {THREADS} SELECT CAST(sum(unread_by_admin) AS BIGINT) AS unread_messages, count(*) FILTER (WHERE unread_by_admin > 0) AS unread_threads FROM threads",
    "h16_thread_messages": f"WITH {THREADS}, {_DOCTORS} SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY created_at) AS position, display_name, sender_role, length(body) AS chars FROM msgs JOIN doctors d ON d.id = thread_id % 100",
    "h17_rotate_sessions": f"WITH {SESSIONS} SELECT session_id, min(doctor_id) AS doctor_id, min(ts) AS issued_at, bool_or(kind IN ('refresh', 'logout')) AS revoked, arg_max(kind, (ts, id)) AS last_event FROM log GROUP BY 1",
    "h17_last_logins": f"WITH {SESSIONS} SELECT doctor_id, max(ts) AS last_login_at FROM log WHERE kind = 'login' GROUP BY 1",
    "h18_update_profiles": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'Dr ' || c_name ELSE c_name END AS display_name, CASE WHEN c_custkey % 3 <> 0 THEN c_name WHEN c_custkey % 2 = 0 THEN ' ' ELSE 'Dr ' || c_name END AS full_name, c_mktsegment AS position FROM customer",
    "h19_upload_log": "SELECT page_id AS id, url AS original_filename, CASE WHEN page_id % 4 = 0 THEN 'processing' WHEN page_id % 5 = 0 THEN 'pii_blocked' WHEN page_id % 7 = 0 THEN 'failed' ELSE 'ingested' END AS status, CASE WHEN page_id % 4 = 0 THEN 0 ELSE CAST(floor(length(html) / 1200) AS BIGINT) END AS chunks_count FROM pages",
    "h20_usage_rollup": f"WITH {REQUESTS}, {DOCUMENTS} SELECT llm_model_used, count(*) AS requests, CAST(sum(anonymizer_removed_count) AS BIGINT) AS removed, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS tokens FROM requests LEFT JOIN docs ON request_id = id GROUP BY 1",
    "h21_register_doctors": "WITH x AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 9 = 0 THEN 'nobody' ELSE 'user' || (c_custkey % 400) || '@example.org' END AS email, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS n FROM customer), y AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY row_id) AS nth FROM x) SELECT row_id, email, coalesce(n, email) AS display_name, CASE WHEN email = 'nobody' THEN 'bad' WHEN email IN (SELECT 'user' || c_custkey || '@example.org' FROM customer WHERE c_custkey < 30) THEN 'exists' WHEN nth > 1 THEN 'repeated' END AS reason FROM y",
    "f4_owner_top_level": f"WITH {REQUESTS} SELECT id, doctor_id, status FROM requests WHERE parent_request_id IS NULL AND doctor_id = 42",
    "f5_validate_feedback": f"WITH {FEEDBACK} SELECT rating BETWEEN 1 AND 5 AS ok, CASE WHEN rating BETWEEN 1 AND 5 THEN NULL ELSE 'rating' END AS reason, comment, count(*) AS n FROM fb GROUP BY 1, 2, 3",
    "f6_validate_message": r"SELECT conv_id AS thread_id, turn AS id, reason IS NULL AS ok, reason FROM (SELECT *, CASE WHEN turn % 4 = 3 THEN 'empty' WHEN length(regexp_replace(repeat(text, 9), '^\s+|\s+$', '', 'g')) = 0 THEN 'empty' WHEN length(regexp_replace(repeat(text, 9), '^\s+|\s+$', '', 'g')) > 4000 THEN 'too_long' END AS reason FROM conversations)",
    "f7_validate_upload": "SELECT page_id, reason IS NULL AS ok, reason FROM (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'extension' WHEN length(html) <= 1000 THEN 'empty' WHEN (length(html) - 1000) * 9000 > 15728640 THEN 'too_large' END AS reason FROM pages)",
    "f8_active_sessions": f"WITH {SESSIONS}, s AS (SELECT id AS session_id, doctor_id, ts AS issued_at, kind IN ('refresh', 'logout') AS revoked FROM log) SELECT session_id, doctor_id FROM s WHERE NOT revoked AND TIMESTAMP '2024-01-02 12:00:00' < issued_at + INTERVAL 3 DAY AND doctor_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "f9_search_titles": "SELECT o_orderkey AS id, o_orderpriority AS title_safe FROM orders WHERE contains(lower(o_orderpriority), 'urg')",
    "p21_days_to_resume": "SELECT l_orderkey AS stay_id, l_linenumber AS day FROM lineitem p WHERE NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = p.l_orderkey AND c.l_linenumber = p.l_linenumber AND c.l_linestatus = 'F' AND c.l_returnflag = 'A')",
}
