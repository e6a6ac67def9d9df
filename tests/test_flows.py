import io
import re
import zipfile

import numpy as np
from pyspark.sql import functions as F

from chartweave.operators import chunks as c
from chartweave.operators import ingest
from chartweave.plans import corpus, flows, notes
from chartweave.sources import files
from chartweave.streaming import streams

SF = "/root/testdata/sf0.001"


def slow_pieces(text, most=1200, overlap=150):
    """Piece by piece, trying every end from the longest down."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while True:
        end = min(at + most, len(text))
        if end < len(text):
            for e in range(end, at + most // 2 + 1, -1):
                if text[e - 1] == "\n" or (text[e - 1] == "." and e < end and text[e] == " "):
                    end = e
                    break
        if text[at:end].strip():
            out.append(text[at:end].strip())
        if end == len(text):
            return out
        at = max(end - overlap, at + 1)


def test_pieces_are_short_and_lose_nothing():
    text = " ".join(f"Word{i}{'.' if i % 9 == 0 else ''}" for i in range(900))
    pieces = c.soft_pieces(text)
    assert len(pieces) > 4 and all(len(p) <= 1200 for p in pieces)
    at = 0
    for p in pieces:  # every piece lies in the text, and begins before the last one ended
        found = text.find(p)
        assert 0 <= found <= at
        at = found + len(p)
    assert at == len(text)
    # 0-1200, 1050-2250, 2100-3300
    assert c.soft_pieces("") == [""] and [len(p) for p in c.soft_pieces("x" * 3300)] == [1200] * 3
    for most, overlap in ((20, 5), (7, 9), (40, 0)):
        for step in range(3, 12):
            odd = "".join(". " if i % step == 0 else "\n" if i % 17 == 0 else "x" for i in range(300))
            assert c.soft_pieces(odd, most, overlap) == slow_pieces(odd, most, overlap)


def test_sections_of_an_exam(spark):
    text = "lead\nA: one\nmore\nB: two"
    heads = [("a", "A:"), ("b", "B:")]
    row = spark.createDataFrame([(text,)], "text string")
    of = lambda column: [tuple(x) for x in row.select(column.alias("x")).first().x]
    assert of(c.sections(F.col("text"), heads)) == [("full", "lead"), ("a", "A: one\nmore"), ("b", "B: two")]
    assert of(c.record_sections(F.col("text"), F.lit("exam_10d"), heads, 7)) == [("a", "A: one\nmore")]
    assert of(c.record_sections(F.col("text"), F.lit("exam_10d"), heads, 99)) == of(c.record_sections(F.col("text"), F.lit("daily"), heads)) == [("full", text)]


def slow_records(text):
    marked, parts = False, [[]]
    for line in text.splitlines():
        if re.match(flows.MARKER, line):
            marked = True
            parts.append([])
        parts[-1].append(line)
    whole = ["\n".join(p) for p in parts] if marked else re.split(r"\n\s*\n", text)
    return [p for p in whole if p.strip()]


def test_chunks_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((r.doc_id, r.text) for r in flows.c9_chunk_documents(spark, SF).collect())
    want = [(r.doc_id, p) for r in docs.collect() for x in slow_records(r.text or "") if len(x.strip()) >= 40 for p in slow_pieces(x.strip())]
    assert got == sorted(want) and len(got) > docs.count()


def test_records_do_not_mix(spark):
    rows = [(None, "a\r\n[ДАТА] b\u2028c"), (None, "x\n\ny"), (1, "one"), (1, "two\n[ПЕРИОД] three"), (2, None), (3, "")]
    got = {(r.k, r.text) for r in c.t.split_records(spark.createDataFrame(rows, "k int, text string"), "k", flows.MARKER).collect()}
    assert got == {(None, "a"), (None, "[ДАТА] b\nc"), (None, "x"), (None, "y"), (1, "one"), (1, "two"), (1, "[ПЕРИОД] three")}


def test_office_files(spark, tmp_path):
    def packed(name, xml):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, xml)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t> one</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell.format('a')}{cell.format('b')}</w:tr></w:tbl></w:body></w:document>"
    odt = '<x xmlns:t="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><t:p>two</t:p><t:p>three</t:p></x>'
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>first</t></si><si><t> </t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c><v>7</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "in").mkdir()
    for name, data in {"f.xlsx": sheet.getvalue(), "a.DOCX": packed("word/document.xml", doc), "in/b.odt": packed("content.xml", odt), "c.docx": b"broken", "d.doc": packed("x", ""), "~$a.docx": b"", "e.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.extract_error) for r in files.extract_text(files.scan_corpus(spark, f"file://{tmp_path}")).collect()}
    assert got == {"f.xlsx": ("first | 7\nin", None), "a.DOCX": ("one\na | b", None), "b.odt": ("two\nthree", None), "c.docx": (None, "BadZipFile"), "d.doc": (None, "unsupported")}


def test_streamed_documents_equal_the_batch(spark, tmp_path):
    rows = corpus.varied_notes(spark, SF)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = str(tmp_path / "out")
    streams.ingest(stream, "doc_ref", notes._chunks, lambda: ingest.letter_model, base).awaitTermination()
    assert spark.read.parquet(f"{base}/quarantine").select("batch").distinct().count() == 3
    whole = ingest.ingest_corpus(rows, "doc_ref", None, notes._chunks, lambda: ingest.letter_model, source="user_upload")
    kept = ["point_id", "text", "doc_type", "embedding"]
    key = lambda df: sorted(map(str, df.select(*kept).collect()))
    assert key(streams.uploaded_points(spark, base)) == key(whole.points)
    assert spark.read.parquet(f"{base}/quarantine").count() == whole.quarantine.count() > 0
    stats = {r.counter: r.value for r in whole.stats.collect()}
    assert stats["seen"] == rows.count() and stats["skipped_extract"] + stats["blocked_pii"] == whole.quarantine.count()
    again = ingest.ingest_corpus(rows, "doc_ref", whole.points, notes._chunks, lambda: ingest.letter_model, source="user_upload")
    assert again.points.count() == whole.points.count()


def test_vectors_of_texts(spark):
    rows = spark.createDataFrame([("a b b",), (None,), ("",)] * 20, "text string")
    model = ingest.hashing_model(8)
    got = ingest.embed(rows, lambda: ingest.hashing_model(8)).collect()
    want = model(["a b b"])[0]
    assert np.allclose(got[0].embedding, want / np.linalg.norm(want)) and got[1].embedding is None and got[2].embedding == [0.0] * 8
