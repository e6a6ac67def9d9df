"""Corpus folders as tables: listing files, and the text of office documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces of the file formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ODF_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def scan_corpus(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("docx", "odt", "doc", "xlsx")) -> DataFrame:
    """Files under ``root`` with one of the suffixes in any case, lock files left out:
    path, suffix, length, content. The content is read only where it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.where(suffix.isin(*suffixes) & ~name.startswith("~$")).select("path", suffix.alias("suffix"), "length", "content")


def _docx(data: zipfile.ZipFile) -> Iterator[str]:
    body = ElementTree.fromstring(data.read("word/document.xml")).find(f"{WORD}body")

    def said(node) -> str:
        return "".join(x.text or "" for x in node.iter(f"{WORD}t")).strip()

    yield from (said(p) for p in body.findall(f"{WORD}p"))
    for row in body.iter(f"{WORD}tr"):
        yield " | ".join(filter(None, map(said, row.findall(f"{WORD}tc"))))


def _odt(data: zipfile.ZipFile) -> Iterator[str]:
    for p in ElementTree.fromstring(data.read("content.xml")).iter(f"{ODF_TEXT}p"):
        yield "".join(p.itertext()).strip()


def _xlsx(data: zipfile.ZipFile) -> Iterator[str]:
    """Rows of all sheets, cells that are not empty between bars; strings from the shared table."""

    def said(node) -> str:
        return "".join(x.text or "" for x in node.iter(f"{SHEET}t")).strip()

    names = data.namelist()
    shared = [said(x) for x in ElementTree.fromstring(data.read("xl/sharedStrings.xml")).findall(f"{SHEET}si")] if "xl/sharedStrings.xml" in names else []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    for name in sheets:
        for row in ElementTree.fromstring(data.read(name)).iter(f"{SHEET}row"):
            cells = []
            for cell in row.findall(f"{SHEET}c"):
                value = (cell.findtext(f"{SHEET}v") or "").strip()
                cells.append(shared[int(value)] if cell.get("t") == "s" and value else said(cell) if cell.get("t") == "inlineStr" else value)
            yield " | ".join(filter(None, cells))


READERS = {"docx": _docx, "odt": _odt, "xlsx": _xlsx}


def read_history(spark: SparkSession, path: str, types: dict[str, str] | None = None, json: dict[str, str] | None = None, file_format: str = "parquet") -> DataFrame:
    """A table of the relational history with its types: ``types`` casts columns (what cannot be
    cast is null), ``json`` parses columns of JSON text by the schema given for them; text that
    is no JSON is null. Other columns are as they are."""
    rows = spark.read.format(file_format).load(path)
    new = {c: F.col(c).try_cast(t) for c, t in (types or {}).items()} | {c: F.from_json(c, t) for c, t in (json or {}).items()}
    return rows.withColumns(new)


def extract_text(files: DataFrame) -> DataFrame:
    """``path``, ``text`` and ``extract_error``: paragraphs, then table rows with cells
    between bars. A file that cannot be read keeps its row, with a null text and the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, suffix, content in zip(batch["path"], batch["suffix"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as data:
                        rows.append((path, "\n".join(filter(None, READERS[suffix](data))), None))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError, IndexError, ValueError) as error:
                    rows.append((path, None, "unsupported" if suffix not in READERS else type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "extract_error"])

    return files.select("path", "suffix", "content").mapInPandas(run, "path string, text string, extract_error string")
