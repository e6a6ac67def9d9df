"""Streams that arrive in several micro-batches."""

import io
import zipfile

import numpy as np
import pandas as pd

from chartweave.operators import ingest
from chartweave.plans import notes
from chartweave.streaming import streams


def source(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_threads_over_batches(spark, tmp_path):
    batches = [
        [(1, 1, 1, "user", "first"), (1, 2, 2, "user", "second"), (2, 1, 3, "support", "hello"), (4, 9, 9, "admin_read", None)],
        [(1, 4, 5, "user", " after \n the read"), (1, 3, 4, "admin_read", None), (2, 1, 3, "user", "same time"), (3, 1, 1, "user", None)],
        [(2, 0, 1, "support", "late"), (3, 5, 7, "user_read", None)],
    ]
    stream = source(spark, tmp_path / "in", batches, "thread_id long, at long, id long, kind string, body string")
    base = str(tmp_path / "out")
    streams.stream_threads(stream, base).awaitTermination()
    got = {r.thread_id: tuple(r)[1:] for r in streams.current_threads(spark, base).collect()}
    assert got == {1: (4, "after the read", 1, 0), 2: (1, "same time", 1, 2), 3: (1, None, 1, 0), 4: (None, None, 0, 0)}


def test_sessions_over_batches(spark, tmp_path):
    at = lambda text: pd.Timestamp(text).to_pydatetime()
    batches = [
        [(1, 7, "login", at("2024-01-01 10:00:00")), (2, 8, "login", at("2024-01-01 11:00:00")), (3, 9, "login", at("2024-01-01 12:00:00")), (5, 1, "use", at("2024-01-01 12:00:00"))],
        [(1, 7, "refresh", at("2024-01-02 10:00:00")), (1, 7, "logout", at("2024-01-02 11:00:00"))],
        [(1, 7, "logout", at("2024-01-03 11:00:00")), (3, 9, "login", at("2024-01-03 12:00:00")), (4, 9, "login", at("2024-01-20 00:00:00"))],
    ]
    stream = source(spark, tmp_path / "in", batches, "session_id long, doctor_id long, kind string, ts timestamp")
    done = streams.run_available(streams.stream_sessions(stream), "sessions").orderBy("session_id").collect()
    assert [(r.session_id, r.doctor_id, str(r.closed_at), r.reason) for r in done] == [
        (1, 7, "2024-01-02 10:00:00", "revoked"),
        (2, 8, "2024-01-04 11:00:00", "expired"),
        (3, 9, "2024-01-04 12:00:00", "expired"),
    ]


def test_sessions_are_taken_in_groups(spark, tmp_path):
    """The work of a batch goes by buckets of sessions, not by sessions: one bucket tells all of
    them, in the batches in which each would be told alone."""
    at = lambda text: pd.Timestamp(text).to_pydatetime()
    begun = [(k, k + 1, "login", at("2024-01-01 10:00:00")) for k in range(500)]
    ended = [(k, k + 1, "logout", at("2024-01-02 10:00:00")) for k in range(0, 500, 2)] + [(None, None, "refresh", at("2024-01-02 09:00:00")), (None, None, "login", at("2024-01-02 08:00:00"))]
    stream = source(spark, tmp_path / "in", [begun, ended, [(900, 1, "login", at("2024-01-20 00:00:00"))]], "session_id long, doctor_id long, kind string, ts timestamp")
    done = streams.run_available(streams.stream_sessions(stream, buckets=1), "sessions").collect()
    told = {r.session_id: (r.doctor_id, str(r.closed_at), r.reason) for r in done}
    want = {k: (k + 1, *(("2024-01-02 10:00:00", "revoked") if k % 2 == 0 else ("2024-01-04 10:00:00", "expired"))) for k in range(500)}
    assert len(done) == 501 and told == want | {None: (None, "2024-01-02 09:00:00", "revoked")}


def test_late_reads_clear_by_time(spark, tmp_path):
    """A read that comes late leaves messages newer than itself; every batch writes what it touches."""
    batches = [
        [(1, 5, 1, "user", "a"), (1, 9, 2, "user", "b"), (2, 1, 3, "support", "x")],
        [(1, 6, 0, "admin_read", None)],
        [(1, 4, 3, "user", "older than the read"), (2, 1, 0, "user_read", None)],
        [(2, 7, 9, "support", "y"), (None, 1, 1, "user", "z")],
        [(1, 9, 0, "admin_read", None), (1, 9, 0, "admin_read", None)],
    ]
    stream = source(spark, tmp_path / "in", batches, "thread_id long, at long, id long, kind string, body string")
    base = str(tmp_path / "out")
    streams.stream_threads(stream, base, snapshot_every=2).awaitTermination()
    want = {0: {(1, 2, 0), (2, 0, 1)}, 1: {(1, 1, 0)}, 2: {(1, 1, 0), (2, 0, 0)}, 3: {(2, 0, 1)}, 4: {(1, 0, 0)}}
    held = {n: {(r.thread_id, r.unread_by_admin, r.unread_by_user) for r in spark.read.parquet(f"{base}/changes/batch={n}").collect()} for n in streams._numbers(spark, f"{base}/changes")}
    assert held == {n: want[n] for n in (2, 3, 4)} and streams._numbers(spark, f"{base}/snapshots") == [1, 3]
    assert {tuple(r) for r in streams.current_threads(spark, base).collect()} == {(1, 9, "b", 0, 0), (2, 7, "y", 0, 1)}


def test_points_seen_once_without_a_limit(spark, tmp_path):
    rng = np.random.default_rng(3)
    batches = [[(f"p{k}",) for k in rng.integers(0, 400, 300)] for _ in range(4)] + [[("p1",), ("new",), ("new",), (None,)], [("p1",), ("p2",)]]
    stream = source(spark, tmp_path / "in", batches, "point_id string")
    base = str(tmp_path / "out")
    # filters so small that they err and grow layers
    streams.stream_new_points(stream, base, buckets=4, bits=400).awaitTermination()
    got = [r.point_id for r in streams.seen_points(spark, base).collect()]
    assert len(got) == len(set(got)) and set(got) == {i for b in batches for (i,) in b if i}
    told = {r.batch: r for r in streams.skipped_joins(spark, base).collect()}
    before = set()
    for n, batch in enumerate(batches):
        own = {i for (i,) in batch if i}
        assert told[n].ids == len(own) and told[n].new == len(own - before) and told[n].asked >= len(own & before)
        before |= own
    assert told[0].skipped > 0.9


def office_file(*paragraphs):
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(f'<w:p><w:r><w:t>{p}</w:t></w:r></w:p>' for p in paragraphs)}</w:body></w:document>")
    return out.getvalue()


NOTE = "[ДАТА] Состояние с улучшением, контакт формальный, сон и аппетит достаточные, тел. 8 812 123-45-67."


def test_uploads_to_points(spark, tmp_path, monkeypatch):
    base, folder = str(tmp_path / "out"), tmp_path / "in"
    folder.mkdir()
    monkeypatch.setattr(streams, "MOST_BYTES", 50_000)
    once = {"a.docx": office_file(NOTE), "b.DOCX": office_file("кратко"), "c.docx": b"broken", "d.docx": office_file(" "), "e.txt": b"no", "f.docx": b"", "g.docx": b"x" * 60_000, "h.doc": b"old", "~$a.docx": b"lock"}
    for name, data in once.items():
        (folder / name).write_bytes(data)
    chunk = lambda df: notes._chunks(df.withColumnRenamed("path", "doc_ref")).withColumnRenamed("doc_ref", "path")
    run = lambda: streams.ingest_uploads(streams.uploaded_files(spark, f"file://{folder}"), chunk, lambda: ingest.letter_model, base, buckets=4).awaitTermination()
    run()
    told = lambda: {r.path.rsplit("/", 1)[-1]: r for r in spark.read.parquet(f"{base}/outcomes").collect()}
    # Spark's file source passes over empty files
    assert {k: r.status for k, r in told().items()} == {"a.docx": "ingested", "b.DOCX": "NO_CHUNKS", "c.docx": "EXTRACTION_ERROR", "d.docx": "EMPTY_DOCUMENT", "e.txt": "BAD_REQUEST", "g.docx": "BAD_REQUEST", "h.doc": "EXTRACTION_ERROR"}
    assert told()["a.docx"].chunks == 1 and told()["a.docx"].removed_by_type == {"phone": 1}
    first = streams.uploaded_points(spark, base).collect()
    assert len(first) == 1 and "[ТЕЛЕФОН]" in first[0].text and first[0].source == "user_upload"
    # the same note in another file, and a new one
    (folder / "z.docx").write_bytes(office_file(NOTE))
    (folder / "y.docx").write_bytes(office_file(NOTE.replace("сон", "речь")))
    run()
    assert {r.text for r in streams.uploaded_points(spark, base).collect()} == {NOTE.replace("8 812 123-45-67", "[ТЕЛЕФОН]"), NOTE.replace("8 812 123-45-67", "[ТЕЛЕФОН]").replace("сон", "речь")}


def stored_files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*.parquet")}


def test_store_writes_touched_buckets_only(spark, tmp_path):
    folder = tmp_path / "points"
    point = lambda i, text: (f"id{i}", ["daily", "exam", None][i % 3], text)
    save = lambda rows: streams.upsert_buckets(spark.createDataFrame(rows, "point_id string, doc_type string, text string"), f"file://{folder}", buckets=8)
    rows = lambda: {r.point_id: (r.doc_type, r.text) for r in spark.read.parquet(str(folder)).collect()}
    save([point(i, "old") for i in range(60)])
    before = stored_files(folder)
    assert len({p.rsplit("/", 1)[0] for p in before}) == len(before) > 8
    batch = [point(3, "new"), point(100, "added")]
    for _ in range(2):
        save(batch)
        after = stored_files(folder)
        touched = {p.rsplit("/", 1)[0] for p in set(after) - set(before)}
        assert len(touched) <= 2 and {k: v for k, v in after.items() if k in before} == {k: v for k, v in before.items() if k.rsplit("/", 1)[0] not in touched}
        assert rows() == {i: (k, t) for i, k, t in [*(point(i, "old") for i in range(60) if i != 3), *batch]}
        assert len({p.rsplit("/", 1)[0] for p in after}) == len(after)
    save([])
    assert len(rows()) == 61
