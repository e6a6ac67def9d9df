"""Document quality from line labels of a linear-chain conditional random field.

Every line is good or bad. A line's features and those of the lines before and after it give
its scores; a transition matrix ties neighbours. Labels exist for documents only, so in
training every line of a document carries the document's label. Forward-backward marginals,
weighted by the lines' lengths, sum to a document's raw score, and a logistic curve fitted on
the training documents turns it into a score of which ``THRESHOLD`` is the best place to cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.llm._shared import append_columns, span_hashes, steps, text_bytes, without, word_spans

THRESHOLD = 0.7
#: Labelled documents that the classifier is fitted on at most.
TRAINING_DOCUMENTS = 4000
_ASCII = np.arange(256)
_UPPER = ((_ASCII >= 65) & (_ASCII <= 90)).astype(np.int64)
_LETTER = (((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122) | (_ASCII >= 128)).astype(np.int64)
_DIGIT = ((_ASCII >= 48) & (_ASCII <= 57)).astype(np.int64)
_STOP = np.isin(_ASCII, [ord(c) for c in ".,;:?"]).astype(np.int64)
_SPACE = np.isin(_ASCII, [9, 10, 11, 12, 13, 32]).astype(np.int64)
_ODD = np.isin(_ASCII, [ord(c) for c in "#$%&*@^~=+<>{}[]\\_|/"]).astype(np.int64)
_SHOUT = (_ASCII == ord("!")).astype(np.int64)
_PIPE = (_ASCII == ord("|")).astype(np.int64)
_CLASSES = np.stack([_UPPER, _LETTER, _DIGIT, _STOP, _SPACE, _ODD, _SHOUT, _PIPE], axis=1).astype(np.float32)
_CUTS = np.array([0.02, 0.1, 0.3], np.float32)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of rows end to end, their lengths in bytes (at least 1), and the
    index of each row's first line (n + 1 values). An empty text is one empty line."""
    breaks = np.flatnonzero(data == 10) + 1
    # a break at the very end of a row opens an empty last line of that row, before the next row
    first = np.searchsorted(breaks, offsets[1:], side="right")
    first = np.r_[0, first] + np.arange(len(offsets))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    starts = np.empty(first[-1], np.int64)
    at = first[:-1]
    inner = np.ones(first[-1], bool)
    inner[at] = False
    starts[at] = offsets[:-1]
    starts[inner] = breaks
    ends = np.r_[starts[1:], offsets[-1]] if len(starts) else starts
    ends = np.minimum(ends, offsets[1:][row])
    size = (ends - starts).astype(np.float32)
    sums = np.zeros((len(starts), _CLASSES.shape[1]), np.float32)
    for k in range(_CLASSES.shape[1]):
        run = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_CLASSES[data, k], out=run[1:], dtype=np.int32)
        sums[:, k] = run[ends] - run[starts]
    w_start, w_end, _ = word_spans(data, offsets)
    hashes = span_hashes(data, w_start, w_end)
    word_line = np.searchsorted(starts, w_start, side="right") - 1
    n_words = np.bincount(word_line, minlength=len(starts)).astype(np.float32)
    again = np.zeros(len(hashes), bool)
    for lag in (1, 2, 3, 4):
        again[lag:] |= (hashes[lag:] == hashes[:-lag]) & (word_line[lag:] == word_line[:-lag])
    n_again = np.bincount(word_line[again], minlength=len(starts)).astype(np.float32)
    order = np.lexsort((hashes, word_line))
    h, ln = hashes[order], word_line[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (ln[1:] != ln[:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(ln[new], minlength=len(starts)).astype(np.float32)
    solid = np.maximum(size - sums[:, 4], 1)
    letters = np.maximum(sums[:, 1], 1)
    words = np.maximum(n_words, 1)
    ratios = np.stack(
        [sums[:, 0] / letters, sums[:, 1] / solid, sums[:, 2] / solid, sums[:, 3] / words, sums[:, 5] / words, sums[:, 6] / words, sums[:, 7] / words, n_again / words, 1 - distinct / words], axis=1
    )
    parts = [
        np.ones((len(starts), 1), np.float32),
        np.minimum(ratios, 2),
        *[(ratios > c).astype(np.float32) for c in _CUTS],
        np.log1p(size)[:, None] / 8,
        np.log1p(n_words)[:, None] / 6,
        (letters / words)[:, None].clip(0, 20) / 10,
        (n_words < 1)[:, None].astype(np.float32),
    ]
    base = np.concatenate(parts, axis=1).astype(np.float32)
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([base, before, after], axis=1), np.maximum(size, 1), first


def marginals(scores: np.ndarray, first: np.ndarray, ties: np.ndarray, pairs: bool = False):
    """P(good) of every line by forward-backward, all rows side by side, longest first; with
    ``pairs`` also the expected transitions and the log partition sums."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    lens, at = lengths[order], first[:-1][order]
    top = int(lens[0]) if len(lens) else 0
    active = [int(np.searchsorted(-lens, -t, side="left")) for t in range(top)]
    alpha, beta = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    emit = np.stack([np.zeros(len(scores)), scores], axis=1)
    for t in range(top):
        k = at[: active[t]] + t
        if t:
            alpha[k] = np.logaddexp(alpha[k - 1, :1] + ties[0], alpha[k - 1, 1:] + ties[1])
        alpha[k] += emit[k]
    for t in range(top - 2, -1, -1):
        k = at[: active[t + 1]] + t
        ahead = beta[k + 1] + emit[k + 1]
        beta[k] = np.logaddexp(ahead[:, :1] + ties[:, 0], ahead[:, 1:] + ties[:, 1])
    total = alpha + beta
    log_z = np.logaddexp(total[:, 0], total[:, 1])
    good = np.exp(total[:, 1] - log_z)
    if not pairs:
        return good
    expected = np.zeros((2, 2))
    inner = np.ones(len(scores), bool)
    inner[first[:-1]] = False
    k = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(alpha[k - 1, a] + ties[a, b] + emit[k, b] + beta[k, b] - log_z[k]).sum()
    return good, expected


@dataclass
class LineCRF:
    """Fitted weights: of the features, of transitions, and of the curve to a score."""

    weights: np.ndarray
    ties: np.ndarray
    slope: float
    shift: float

    def raw(self, column: pa.Array) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, one value for every text."""
        data, offsets = text_bytes(column)
        out = []
        for low, high in steps(offsets):
            x, size, first = line_features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            good = marginals(x @ self.weights, first, self.ties)
            out.append(np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1]))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, column: pa.Array) -> np.ndarray:
        raw = np.clip(self.raw(column), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(raw / (1 - raw)) + self.shift)))


def fit(texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.08, decay: float = 1e-4) -> LineCRF:
    """Maximum likelihood by full-batch adaptive steps. Documents of both labels weigh alike
    in sum. Without documents of both labels every text scores the share of good ones."""
    y = np.array(labels, float)
    x0, _, _ = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return LineCRF(np.zeros(x0.shape[1]), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    parts = [line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in steps(offsets)]
    x = np.concatenate([p[0] for p in parts])
    first = np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]
    label = np.repeat(y, np.diff(first))
    per = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum()) / np.diff(first)
    weight = np.repeat(per, np.diff(first))
    del parts
    # the matrix of features stays as it is in every round: single precision, one copy
    w, ties = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    same = np.array([[((label == 0) * 1.0).sum() - (y == 0).sum(), 0], [0, (label == 1).sum() - (y == 1).sum()]])
    for step in range(1, rounds + 1):
        good, expected = marginals(x @ w.astype(np.float32), first, ties, pairs=True)
        gradient = np.r_[x.T @ (weight * (label - good)).astype(np.float32) - decay * w, ((same - expected) / max(same.sum(), 1)).ravel() * 0.1 - decay * ties.ravel()]
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, ties = w + move[:-4], ties + move[-4:].reshape(2, 2)
    model = LineCRF(w, ties, 1.0, 0.0)
    raw = np.clip(model.raw(pa.array(texts, pa.string())), 1e-6, 1 - 1e-6)
    z = np.log(raw / (1 - raw))
    # the cut with the fewest weighted errors goes to THRESHOLD
    order = np.argsort(z)
    bad, fine = np.cumsum((y == 0)[order]), np.cumsum((y == 1)[order])
    right = bad / bad[-1] + 1 - fine / fine[-1]
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = int(best[len(best) // 2])
    cut = (z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2
    slope = 2.0 / max(np.std(z), 1e-6)
    return LineCRF(w, ties, float(slope), float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut))


def held_out(doc_id: Column) -> Column:
    """Whether a document never takes part in learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(4) == F.lit(2), F.lit(False))


MODEL = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("weights", "ties")] + [T.StructField(n, T.DoubleType()) for n in ("slope", "shift")])


def fit_on_labels(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> LineCRF:
    """Fit on at most ``most`` labelled documents outside the held-out part, half of them of
    either label where there are enough, chosen by a hash of their ids. Whole texts; null is
    empty. The ids are chosen on the narrow table, one task fits on their texts, and only the
    weights reach the driver.

    A doc_id with several labels counts as the lower one, one that stands on several rows has
    its smallest text. Null ids and labels other than 0 and 1 take no part; without documents
    of both labels the model gives every text the share of good ones (0.5 without any)."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(most // 2) for q in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(ids, F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy("doc_id", "_quality").agg(F.min("_text").alias("_text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        rows.sort()
        m = fit([t for _, _, t in rows], [q for _, q, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tolist()]), pa.array([m.ties.ravel().tolist()]), pa.array([m.slope]), pa.array([m.shift])], names=MODEL.fieldNames())

    fitted = texts.repartition(1).mapInArrow(learn, MODEL).first()
    if fitted is None:
        return fit([], [])
    return LineCRF(np.array(fitted["weights"]), np.array(fitted["ties"]).reshape(2, 2), fitted["slope"], fitted["shift"])


def score_documents(docs: DataFrame, model: LineCRF, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on). Null and empty
    texts are scored as one empty line; the score follows from the text alone, so repeated rows
    agree; columns of the new names (any case) are replaced; an empty table stays empty. No shuffle."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(model.score(batch.column(batch.schema.get_field_index(text))), pa.float64())]

    scored = append_columns(without(docs, predicted), [T.StructField(score, T.DoubleType())], run)
    return scored.withColumn(predicted, (F.col(score) >= F.lit(THRESHOLD)).cast("int"))
