"""Language identification by mixture inference.

Languages are learned as distributions of byte trigrams inside words. A document is a
mixture: each word comes from one language, with the likelihood of its trigrams.
Expectation-maximisation estimates the proportions; the set of languages is chosen by the
likelihood less a penalty for every language, by taking languages out one at a time. The
language with the largest proportion is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.llm._shared import LOWER, append_columns, steps, text_bytes

#: Buckets of hashed trigrams.
BUCKETS = 1 << 16
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter (with word borders), the index of the first
    trigram of each word, and the row of each word. Words are runs of letters: a-z in any
    case and all bytes from 128 on."""
    c = _LETTERS[LOWER[data]].astype(np.uint32)
    before, after = np.zeros_like(c), np.zeros_like(c)
    before[1:], after[:-1] = c[:-1], c[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = 0
    after[inner - 1] = 0
    at = np.flatnonzero(c)
    bucket = (before[at] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ after[at] * np.uint32(0xC2B2AE3D)) >> np.uint32(4)
    bucket = (bucket * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    first = np.flatnonzero(before[at] == 0)
    row = np.searchsorted(offsets, at[first], side="right") - 1
    return bucket.astype(np.int64), first, row


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities (language x bucket) from (text, lang) rows,
    over all rows. Counts are summed in the tasks before the shuffle; the table that reaches
    the driver and the workers has BUCKETS numbers for each language, however many rows there are.

    Rows with a null text or language teach nothing, empty texts name their language only by
    rows of others; repeated rows count again. Without rows there are no languages. Languages
    are ordered by their names, so ties later go to the first of these."""
    kind = "lang string, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for low, high in steps(offsets):
                own = offsets[low : high + 1] - offsets[low]
                bucket, first, row = trigrams(data[offsets[low] : offsets[high]], own)
                of = np.repeat(row, np.diff(np.r_[first, len(bucket)]))
                for lang in set(langs[low:high]):
                    mine = (langs[low:high] == lang)[of]
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    counts[lang] += np.bincount(bucket[mine], minlength=BUCKETS)
        for lang, n in counts.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(n[k])], names=["lang", "bucket", "n"])

    named = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    rows = named.mapInArrow(run, kind).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(rows["lang"].unique())
    table = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        table[i, mine["bucket"].to_numpy()] = mine["n"].to_numpy()
    table += 0.05
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def mixture(loglik: np.ndarray, penalty: float, rounds: int = 12) -> np.ndarray:
    """Proportions of the languages from the words' log-likelihoods (word x language): EM,
    then languages go while the penalised likelihood rises."""

    def em(active: np.ndarray) -> tuple[float, np.ndarray]:
        p = np.full(len(active), 1 / len(active))
        like = scaled[:, active]
        for _ in range(rounds if len(active) > 1 else 0):
            joint = like * p
            p = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        return float(np.log(np.maximum(like @ p, 1e-300)).sum()) - penalty * len(active), p

    scaled = np.exp(loglik - loglik.max(axis=1, keepdims=True)) + 1e-30
    active = np.arange(loglik.shape[1])
    value, p = em(active)
    while len(active) > 1:
        rest = np.delete(active, p.argmin())
        other, q = em(rest)
        if other < value:
            break
        value, active, p = other, rest, q
    out = np.zeros(loglik.shape[1])
    out[active] = p
    return out


def proportions(words: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions of every row from the log-likelihoods of its words (word x language).

    The likelihood is concave in the proportions. So from the one best language it can rise
    by at most words * (largest mean likelihood ratio - 1); where that does not pay for a
    second language, the mixture is that language, and only other rows need the rounds."""
    n = np.diff(bounds)
    out = np.zeros((len(n), words.shape[1]))
    filled = np.flatnonzero(n)
    if not len(filled):
        return out
    sums = np.add.reduceat(words, bounds[:-1][filled], axis=0)
    best = sums.argmax(axis=1)
    of = np.repeat(np.arange(len(filled)), n[filled])
    ratios = np.exp(np.minimum(words - words[np.arange(len(words)), best[of]][:, None], 50))
    gain = np.add.reduceat(ratios, bounds[:-1][filled], axis=0).max(axis=1) - n[filled]
    out[filled, best] = 1
    for k in np.flatnonzero(gain > penalty):
        i = filled[k]
        out[i] = mixture(words[bounds[i] : bounds[i + 1]], penalty)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict_languages(docs: DataFrame, langs: list[str], table: np.ndarray, text: str = "text", penalty: float = 6.0) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the language's proportion) and ``lang_mix``
    (map of proportions above zero).

    Null texts and texts without a letter get ``und``, score 0 and an empty map; so does every
    text if nothing was learned. Letters of scripts never seen count like any bytes. Ties go
    to the first language in order. No shuffle."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(batch.schema.get_field_index(text))
        data, offsets = text_bytes(column)
        preds, scores, mixes = [], [], []
        for low, high in steps(offsets):
            own = offsets[low : high + 1] - offsets[low]
            bucket, first, row = trigrams(data[offsets[low] : offsets[high]], own)
            bounds = np.searchsorted(row, np.arange(high - low + 1))
            words = np.add.reduceat(rows[bucket], first, axis=0) if len(first) else np.zeros((0, len(langs)))
            mixed = proportions(words.astype(np.float64), bounds, penalty) if langs else np.zeros((high - low, 0))
            for i, p in enumerate(mixed):
                raw = data[offsets[low + i] : offsets[low + i + 1]]
                if bounds[i] == bounds[i + 1] or not langs or (raw.max() >= 128 and not has_letter(column[low + i].as_py())):
                    preds.append("und"), scores.append(0.0), mixes.append([])
                    continue
                best = int(p.argmax())
                preds.append(langs[best]), scores.append(float(min(p[best], 1.0)))
                mixes.append([(langs[k], float(p[k])) for k in np.flatnonzero(p > 0)])
        return [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))]

    rows = np.ascontiguousarray(table.T)
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("lang_mix", T.MapType(T.StringType(), T.DoubleType())),
    ]
    return append_columns(docs, fields, run)


def held_out(doc_id: Column) -> Column:
    """Whether a document never takes part in learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(3) == F.lit(1), F.lit(False))
