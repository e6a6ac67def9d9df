"""From raw documents to vector points: redact, hold back, cut, embed, upsert."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators import redaction
from chartweave.operators import text as t
from chartweave.operators import vectors as v
from chartweave.operators.chunks import ingest_stats

#: Texts that a model gets at once.
BATCH = 16
#: Fixed value: the namespace of point ids.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
Model = Callable[[list[str]], np.ndarray]


def hashing_model(dimension: int = 256) -> Model:
    """A model without weights: words fall into components by their CRC, with a sign."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h >> 31 else -1
        return out

    return encode


def letter_model(texts: list[str]) -> np.ndarray:
    """Counts of the letters a to z: a model whose vectors other engines can count too."""
    return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], float).reshape(len(texts), 26)


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v)
    return v / norm if norm > 0 else v


def embed(rows: DataFrame, load: Callable[[], Model], kind: str = "passage", name: str = "", text: str = "text", vector: str = "embedding") -> DataFrame:
    """``rows`` with unit vectors of their texts. ``load`` makes the model, once a task; it gets
    ``BATCH`` texts at a time, of models named e5 with their ``kind`` (passage or query) in
    front. Null texts have null vectors, a text that the model maps to zero stays zero."""
    prefix = f"{kind}: " if "e5" in name.lower() else ""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            given = [prefix + x for x in texts if x is not None]
            made = iter([unit(row) for at in range(0, len(given), BATCH) for row in np.asarray(model(given[at : at + BATCH]), float)])
            yield pd.Series([None if x is None else next(made).tolist() for x in texts], dtype=object)

    return rows.withColumn(vector, run(F.col(text)))


@dataclass
class Ingested:
    """What a run gives: the points as they then are, what was held back, and its counters."""

    points: DataFrame
    quarantine: DataFrame
    stats: DataFrame


def new_points(clean: DataFrame, chunk: Callable[[DataFrame], DataFrame], load: Callable[[], Model], name: str = "", source: str = "corpus", namespace: str = NAMESPACE) -> DataFrame:
    """Points of redacted documents. A point's id follows from text, type, section and source,
    so equal chunks are one point and are embedded once."""
    rows = chunk(clean).withColumn("source", F.lit(source))
    rows = rows.withColumn("point_id", t.point_id(F.col("text"), F.col("doc_type"), F.col("section"), F.col("source"), namespace))
    kept = ["doc_type", "section", "syndrome", "diagnosis_class", "dynamics", "source", "text"]
    # of equal ids the smallest values stand, whatever the order of arrival
    once = rows.groupBy("point_id").agg(F.min(F.struct(*kept)).alias("p")).select("point_id", "p.*")
    return embed(once, load, "passage", name)


def ingest_corpus(docs: DataFrame, key: str, existing: DataFrame | None, chunk: Callable[[DataFrame], DataFrame], load: Callable[[], Model], name: str = "", source: str = "corpus", **redact) -> Ingested:
    """The whole way from documents (key, text) to points. A document that the gate holds back
    has no chunks; documents without text count as not extracted. Points of ``existing`` with
    the same id are replaced. Documents are redacted whole, before they are cut; nothing but
    the ids of points and their chunks is shuffled."""
    done = redaction.redact_documents(docs, **redact)
    clean, quarantine = redaction.gate_split(done)
    fresh = new_points(clean.select(key, "text"), chunk, load, name, source)
    points = fresh if existing is None else v.upsert_points(existing, fresh.withColumn("arrival", F.lit(0)))
    return Ingested(points, quarantine.select(key, "reason"), ingest_stats(done, chunk(clean.select(key, "text")), key))
