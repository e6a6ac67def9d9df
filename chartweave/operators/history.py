"""Relational history: requests with children, documents, feedback, inbox, sessions, uploads.

All operators are joins and aggregates over tables; dimension tables join by Spark's own
choice of strategy, and lists end in a sort with the id as last key and a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp_page(limit: int, offset: int, usual: int = 20, most: int = 200) -> tuple[int, int]:
    """A page's limit and offset: a limit outside 1..most becomes the usual one, a negative
    offset 0."""
    return (limit if 0 < limit <= most else usual), max(offset, 0)


def clamped_page(limit: Column, offset: Column, usual: int = 20, most: int = 200) -> Column:
    """``clamp_page`` for columns: struct<limit, offset>; nulls count as outside."""
    fine = F.coalesce(limit.between(1, most), F.lit(False))
    return F.struct(F.when(fine, limit).otherwise(F.lit(usual)).alias("limit"), F.greatest(F.coalesce(offset, F.lit(0)), F.lit(0)).alias("offset"))


def page(df: DataFrame, *order: Column, limit: int = 20, offset: int = 0, usual: int = 20, most: int = 200) -> DataFrame:
    """One page of ``df`` in the given order; Spark keeps limit + offset rows per task."""
    limit, offset = clamp_page(limit, offset, usual, most)
    rows = df.orderBy(*order)
    return (rows.offset(offset) if offset else rows).limit(limit)


def top_level_only(requests: DataFrame) -> DataFrame:
    return requests.where("parent_request_id IS NULL")


def scope_to_owner(requests: DataFrame, owner) -> DataFrame:
    return requests.where(F.col("doctor_id") == F.lit(owner))


def children_counts(requests: DataFrame) -> DataFrame:
    """(parent_request_id, children_count); rows without a parent never reach the shuffle."""
    return requests.where("parent_request_id IS NOT NULL").groupBy("parent_request_id").agg(F.count(F.lit(1)).alias("children_count"))


def with_children(requests: DataFrame) -> DataFrame:
    """Top-level requests with their number of children, null texts as ''."""
    counts = children_counts(requests).withColumnRenamed("parent_request_id", "_parent")
    rows = top_level_only(requests).join(counts, F.col("id") == F.col("_parent"), "left").drop("_parent")
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title_safe", "llm_model_used") if c in requests.columns}
    return rows.withColumns(blank | {"children_count": F.coalesce("children_count", F.lit(0))})


def history_list(requests: DataFrame, owner=None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest top-level requests with children count; ``total`` is the number before paging."""
    mine = scope_to_owner(requests, owner) if owner is not None else requests
    rows = with_children(mine)
    total = top_level_only(mine).agg(F.count(F.lit(1)).alias("total"))
    return page(rows, F.col("created_at").desc(), F.col("id").desc(), limit=limit, offset=offset).crossJoin(F.broadcast(total))


def history_detail(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests with their document, null where there is none."""
    side = documents.select(F.col("request_id").alias("_request"), "content_anonymized", "tokens_used")
    return requests.join(side, F.col("id") == F.col("_request"), "left").drop("_request")


def history_children(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Children with ``position`` in their parent, oldest first; content '' if there is none."""
    kids = history_detail(requests.where("parent_request_id IS NOT NULL"), documents)
    order = Window.partitionBy("parent_request_id").orderBy("created_at", "id")
    return kids.withColumns({"content_anonymized": F.coalesce("content_anonymized", F.lit("")), "position": F.row_number().over(order)})


def merge_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One document a request: incoming content and tokens win, an empty type keeps the old."""
    a = existing.select("request_id", *[F.col(c).alias(f"_old_{c}") for c in ("document_type_code", "content_anonymized", "tokens_used")])
    rows = a.join(incoming, "request_id", "full")
    come = F.col("content_anonymized").isNotNull()
    return rows.select(
        "request_id",
        F.coalesce(F.nullif(F.col("document_type_code"), F.lit("")), F.col("_old_document_type_code")).alias("document_type_code"),
        F.when(come, F.col("content_anonymized")).otherwise(F.col("_old_content_anonymized")).alias("content_anonymized"),
        F.when(come, F.col("tokens_used")).otherwise(F.col("_old_tokens_used")).alias("tokens_used"),
    )


def patch_requests(requests: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial update by id: non-empty title and status, non-null answers."""
    p = patches.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_new_{c}") for c in ("title_safe", "status", "answers_anonymized") if c in patches.columns])
    rows = requests.join(p, F.col("id") == F.col("_id"), "left")
    new = {c: F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")) if c != "answers_anonymized" else F.col(f"_new_{c}"), F.col(c)) for c in ("title_safe", "status", "answers_anonymized") if f"_new_{c}" in rows.columns}
    return rows.withColumns(new).select(*requests.columns)


def delete_cascade(requests: DataFrame, ids: DataFrame, dependants: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Requests and dependent tables after deleting the top-level requests among ``ids``:
    their children go too, and rows of dependants (by request_id) with them."""
    gone = top_level_only(requests).join(ids.select("id"), "id", "left_semi").select("id")
    kids = requests.join(gone.withColumnRenamed("id", "parent_request_id"), "parent_request_id", "left_semi").select("id")
    dead = gone.unionByName(kids)
    out = {"requests": requests.join(dead, "id", "left_anti")}
    return out | {k: d.join(dead.withColumnRenamed("id", "request_id"), "request_id", "left_anti") for k, d in dependants.items()}


def batch_status(requests: DataFrame) -> DataFrame:
    """Per parent: days, failed days, failed iff all days failed else done, title suffix."""
    failed = F.count_if(F.col("status") == "failed")
    rows = requests.where("parent_request_id IS NOT NULL").groupBy("parent_request_id").agg(F.count(F.lit(1)).alias("days"), failed.alias("failed_days"))
    suffix = F.when(F.col("failed_days") > 0, F.concat(F.lit(" · ошибок: "), F.col("failed_days").cast("string"))).otherwise(F.lit(""))
    return rows.withColumns({"status": F.when(F.col("failed_days") == F.col("days"), "failed").otherwise("done"), "title_suffix": suffix})


#: Request states and the states that count as in work.
STATUS_LABELS = {
    "done": "Готово",
    "failed": "Ошибка",
    "blocked_pii": "Ошибка",
    "pending": "В работе",
    "anonymizing": "В работе",
    "retrieving": "В работе",
    "generating": "В работе",
}


def status_label(status: Column) -> Column:
    """The shown label of a request's state; unknown states show as they are."""
    known = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, status), status)


def feedback_latest(versions: DataFrame) -> DataFrame:
    """One row for (request_id, doctor_id): last rating, comment and quote, first created_at,
    last updated_at. One aggregate; versions are never sorted."""
    last = F.max_by(F.struct("rating", "comment", "quote"), F.struct("updated_at", "id"))
    rows = versions.groupBy("request_id", "doctor_id").agg(last.alias("x"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    return rows.select("request_id", "doctor_id", "x.rating", "x.comment", "x.quote", "created_at", "updated_at")


def feedback_inbox(feedback: DataFrame, doctors: DataFrame, requests: DataFrame) -> DataFrame:
    """Feedback with its doctor's name and request's title; rows without either are left out."""
    d = doctors.select(F.col("id").alias("doctor_id"), "display_name")
    r = requests.select(F.col("id").alias("request_id"), "title_safe")
    return feedback.join(d, "doctor_id").join(r, "request_id")


def validate_feedback(rows: DataFrame) -> DataFrame:
    """``rows`` with trimmed texts, ``ok`` and ``reason`` (rating 1..5, comment up to 4000 and
    quote up to 2000 characters)."""
    rows = rows.withColumns({c: trim_space(F.coalesce(F.col(c), F.lit(""))) for c in ("comment", "quote")})
    reason = (
        F.when(F.col("rating").isNull() | ~F.col("rating").between(1, 5), "rating")
        .when(F.length("comment") > 4000, "comment_too_long")
        .when(F.length("quote") > 2000, "quote_too_long")
    )
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def validate_message(rows: DataFrame, body: str = "body") -> DataFrame:
    """``rows`` with the trimmed body, ``ok`` and ``reason`` (not empty, up to 4000 characters)."""
    rows = rows.withColumn(body, trim_space(F.coalesce(F.col(body), F.lit(""))))
    reason = F.when(F.col(body) == "", "empty").when(F.length(body) > 4000, "too_long")
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def validate_upload(files: DataFrame, most_bytes: int = 15 * 1024 * 1024, extensions: tuple[str, ...] = ("docx", "odt", "doc")) -> DataFrame:
    """``files`` (path, length) with ``ok`` and ``reason``: extension, emptiness, size."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    reason = F.when(~ext.isin(*extensions), "extension").when(F.col("length") <= 0, "empty").when(F.col("length") > most_bytes, "too_large")
    return files.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def trim_space(text: Column) -> Column:
    """``text`` without white space (in Unicode's sense) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def message_preview(body: Column, most: int = 140) -> Column:
    """White space collapsed, the first ``most`` characters, … if there are more."""
    flat = F.regexp_replace(trim_space(body), r"(?U)\s+", " ")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("…")))


def fold_threads(messages: DataFrame, reads: DataFrame) -> DataFrame:
    """Per thread: last message and preview, messages of the other side after the last read.

    ``reads`` (thread_id, who, read_at) with who in (admin, user). One join of two aggregates'
    inputs on the thread; no range join."""
    last = reads.groupBy("thread_id").agg(
        F.max(F.when(F.col("who") == "admin", F.col("read_at"))).alias("_admin_read"), F.max(F.when(F.col("who") == "user", F.col("read_at"))).alias("_user_read")
    )
    rows = messages.join(last, "thread_id", "left")
    unseen = lambda who, read: F.count_if((F.col("sender_role") == who) & (F.col(read).isNull() | (F.col("created_at") > F.col(read))))
    folded = rows.groupBy("thread_id").agg(
        F.max("created_at").alias("last_message_at"),
        F.max_by("body", F.struct("created_at", "id")).alias("_body"),
        unseen("user", "_admin_read").alias("unread_by_admin"),
        unseen("support", "_user_read").alias("unread_by_user"),
    )
    return folded.select("thread_id", "last_message_at", message_preview(F.col("_body")).alias("last_message_preview"), "unread_by_admin", "unread_by_user")


def thread_inbox(threads: DataFrame, doctors: DataFrame) -> DataFrame:
    """Threads with messages and their doctor, in order of unread and recency (``place``)."""
    d = doctors.select(F.col("id").alias("doctor_id"), "display_name")
    return threads.where("last_message_at IS NOT NULL").join(d, "doctor_id")


def support_summary(threads: DataFrame) -> DataFrame:
    return threads.agg(F.coalesce(F.sum("unread_by_admin"), F.lit(0)).alias("unread_messages"), F.count_if(F.col("unread_by_admin") > 0).alias("unread_threads"))


def thread_messages(messages: DataFrame, doctors: DataFrame) -> DataFrame:
    """Messages with their sender's name and ``position`` in the thread, oldest first."""
    d = doctors.select(F.col("id").alias("sender_id"), "display_name")
    order = Window.partitionBy("thread_id").orderBy("created_at", "id")
    return messages.join(d, "sender_id").withColumn("position", F.row_number().over(order))


def rotate_sessions(events: DataFrame) -> DataFrame:
    """(session_id, doctor_id, issued_at, revoked, last_event) from a log of login, refresh and
    logout events (session_id, doctor_id, kind, ts, id): a session is revoked once it was
    refreshed or logged out, however often that is logged."""
    return events.groupBy("session_id").agg(
        F.min("doctor_id").alias("doctor_id"),
        F.min("ts").alias("issued_at"),
        F.max(F.col("kind").isin("refresh", "logout")).alias("revoked"),
        F.max_by("kind", F.struct("ts", "id")).alias("last_event"),
    )


def last_logins(events: DataFrame) -> DataFrame:
    return events.where("kind = 'login'").groupBy("doctor_id").agg(F.max("ts").alias("last_login_at"))


def active_sessions(sessions: DataFrame, doctors: DataFrame, as_of: Column) -> DataFrame:
    """Sessions neither revoked nor expired at ``as_of``, of active doctors."""
    d = doctors.where("is_active").select(F.col("id").alias("doctor_id"))
    return sessions.where(~F.col("revoked") & (as_of < F.col("expires_at"))).join(d, "doctor_id", "left_semi")


def update_profiles(doctors: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial profile update; a non-empty full name is the display name too."""
    p = patches.select(F.col("id").alias("_id"), F.col("full_name").alias("_full"), F.col("position").alias("_position"))
    rows = doctors.join(p, F.col("id") == F.col("_id"), "left")
    full = F.nullif(trim_space(F.coalesce("_full", F.lit(""))), F.lit(""))
    new = {"full_name": F.coalesce("_full", "full_name"), "display_name": F.coalesce(full, "display_name"), "position": F.coalesce("_position", "position")}
    return rows.withColumns(new).select(*doctors.columns)


def upload_log(uploads: DataFrame, results: DataFrame) -> DataFrame:
    """Uploads with the outcome of their run: blocked → pii_blocked, error → failed, result →
    ingested, none → processing."""
    rows = uploads.join(results.withColumnRenamed("upload_id", "id"), "id", "left")
    status = F.when(F.col("blocked"), "pii_blocked").when(F.col("error").isNotNull(), "failed").when(F.col("chunks").isNotNull(), "ingested").otherwise("processing")
    return rows.withColumns({"status": status, "chunks_count": F.coalesce("chunks", F.lit(0))})


def usage_rollup(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Per model: requests, removed entities, tokens."""
    rows = history_detail(requests, documents)
    return rows.groupBy("llm_model_used").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce("anonymizer_removed_count", F.lit(0))).alias("removed"), F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens")
    )


def register_doctors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` (row_id, email, display_name) with normalised e-mail and ``reason``: bad
    (no @), exists, repeated (earlier in the batch), or null for accepted rows."""
    mail = F.lower(trim_space(F.coalesce("email", F.lit(""))))
    name = F.coalesce(F.nullif(trim_space(F.coalesce("display_name", F.lit(""))), F.lit("")), F.col("email"))
    rows = incoming.withColumn("email", mail).withColumn("display_name", name)
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("email").orderBy("row_id")))
    known = existing.select(F.lower(trim_space(F.col("email"))).alias("_known")).distinct()
    rows = rows.join(known, F.col("email") == F.col("_known"), "left")
    reason = F.when(~F.contains("email", F.lit("@")), "bad").when(F.col("_known").isNotNull(), "exists").when(F.col("_nth") > 1, "repeated")
    return rows.withColumn("reason", reason).drop("_known", "_nth")


def search_titles(rows: DataFrame, query: str, title: str = "title_safe", label: str = "type_label") -> DataFrame:
    """Rows whose title or type label contains the query, whatever the case."""
    q = F.lit(query.strip().lower())
    hit = F.contains(F.lower(F.coalesce(F.col(title), F.lit(""))), q)
    return rows.where(hit | F.contains(F.lower(F.coalesce(F.col(label), F.lit(""))), q) if label in rows.columns else hit)


def days_to_resume(planned: DataFrame, children: DataFrame) -> DataFrame:
    """Planned days (stay_id, day) without a finished child that has content."""
    done = children.where((F.col("status") == "done") & (trim_space(F.coalesce("content", F.lit(""))) != "")).select("stay_id", "day")
    return planned.join(done, ["stay_id", "day"], "left_anti")


def is_automatic_title(title: Column) -> Column:
    """Whether a batch was named by its period: both days and their number, under either word
    for a period and whatever status stands behind it."""
    bare = F.regexp_replace(title, r"(?: · Формируется…| · ошибок: \d+| · Ошибка)+$", "")
    return F.coalesce(trim_space(bare).rlike(r"^(?:Период|Пакет) · \d{2}\.\d{2}\.\d{4}–\d{2}\.\d{2}\.\d{4} \(\d+ дн\.\)$"), F.lit(False))
