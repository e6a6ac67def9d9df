"""Toxicity of whole texts by a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

A text is lower-cased, what stands between letters becomes one space, and runs of 3 to 6
characters are hashed into ``BUCKETS`` features, each present or absent. From labelled texts
Spark counts, per feature, the documents of either label that hold it; the smoothed log ratio
of both shares scales the feature (Wang and Manning, 2012). A logistic regression is fitted on
the scaled features of a bounded sample, its curve on margins of texts left out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.llm._shared import append_columns, drop, stash, without

THRESHOLD = 0.5
#: Labelled documents that the classifier is fitted on at most, half of them of either label where there are enough.
TRAINING_DOCUMENTS = 4000
SIZES = (3, 4, 5, 6)
BITS = 18
BUCKETS = 1 << BITS
#: A feature takes part from so many training documents and so large a ratio on.
LEAST_DOCUMENTS, LEAST_RATIO = 4, 0.7
#: A text's margin is divided by this power of the number of its features: long texts hold more by chance.
DAMPING = 0.25
RIDGE = 1e-4
#: Characters that one numpy step works on; a longer text makes a step of its own.
_STEP = 1 << 18
_SPACE = 32
#: Odd numbers of the hash of a run of characters.
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def held_out(doc_id: Column) -> Column:
    """Whether a document never takes part in learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(5) == F.lit(0), F.lit(False))


def _characters(texts: list[str]) -> np.ndarray:
    """Code points of all texts end to end: a 0 before each, letters lower-cased, one space
    for what stands between them."""
    joined = "".join("\0 " + t.replace("\0", " ").lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points >= 97) & (points <= 122) | (points >= 0xC0)
    mark = points == 0
    goes_on = np.r_[True, letter[:-1] | mark[:-1]]
    kept = letter | mark | goes_on
    return np.where(letter | mark, points, _SPACE)[kept]


def _buckets(points: np.ndarray) -> np.ndarray:
    """Bucket of the run of each size that begins at each character; -1 where it holds a mark or the end."""
    out = np.full((len(SIZES), len(points)), -1, np.int32)
    points = points.astype(np.uint64)
    marks = np.flatnonzero(points == 0)
    with np.errstate(over="ignore"):
        code = np.zeros(len(points), np.uint64)
        for n in range(1, min(max(SIZES), len(points)) + 1):
            m = len(points) - n + 1
            code = code[:m] * np.uint64(_BASE) + points[n - 1 :]
            if n in SIZES:
                own = out[SIZES.index(n)]
                own[:m] = ((code ^ (code >> np.uint64(29))) * np.uint64(_SPREAD) >> np.uint64(64 - BITS)).astype(np.int32)
                for back in range(n):
                    own[marks[marks >= back] - back] = -1
    return out


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every feature that a text has, each once, in order of rows; only
    ``wanted`` buckets (flags) where given."""
    counts, found, at = [], [], 0
    last = np.zeros(BUCKETS, np.int32)

    def once(own: np.ndarray) -> np.ndarray:
        place = np.arange(len(own), dtype=np.int32)
        last[own] = place
        return own[last[own] == place]

    def chosen(buckets: np.ndarray) -> np.ndarray:
        own = buckets[buckets >= 0]
        return once(own if wanted is None else own[wanted[own]])

    while at < len(texts):
        end, total = at + 1, len(texts[at])
        while end < len(texts) and total + len(texts[end]) <= _STEP:
            total += len(texts[end])
            end += 1
        points = _characters(texts[at:end])
        if end == at + 1:
            # windows that overlap by one character less than the longest run
            parts = [chosen(_buckets(points[k : k + _STEP + max(SIZES) - 1])[:, :_STEP]) for k in range(0, len(points), _STEP)]
            found.append(once(np.concatenate(parts)) if len(parts) > 1 else parts[0])
            counts.append(len(found[-1]))
        else:
            buckets = _buckets(points)
            starts = np.r_[np.flatnonzero(points == 0), len(points)]
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                found.append(chosen(buckets[:, low:high]))
                counts.append(len(found[-1]))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.repeat(np.arange(len(texts)), counts), np.concatenate(found)


@dataclass
class ToxicityModel:
    """Weight of every bucket (fitted weight times ratio; 0: takes no part) and the curve from margin to score."""

    weights: np.ndarray
    shift: float
    slope: float
    base: float

    def margin(self, texts: list[str]) -> np.ndarray:
        row, bucket = features(texts, self.weights != 0)
        held = np.bincount(row, minlength=len(texts)).clip(1)
        return np.bincount(row, weights=self.weights[bucket], minlength=len(texts)) / held**DAMPING + self.shift

    def score(self, texts: list[str]) -> np.ndarray:
        return _logistic(self.slope * self.margin(texts) + self.base)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_count_ratios(with_label: np.ndarray, without_label: np.ndarray, n_with: int, n_without: int) -> np.ndarray:
    """Log of the ratio of the shares of both labels' documents that hold each feature,
    smoothed by one document; 0 for features that are too rare or too even."""
    ratio = np.log((with_label + 1) / (n_with + 2)) - np.log((without_label + 1) / (n_without + 2))
    return np.where((with_label + without_label >= LEAST_DOCUMENTS) & (np.abs(ratio) >= LEAST_RATIO), ratio, 0.0)


class _Sparse:
    """Rows of present features, scaled by ``ratio`` and damped by how many a row holds; kept
    by rows and by columns as indices only."""

    def __init__(self, counts: np.ndarray, column: np.ndarray, ratio: np.ndarray):
        self.ratio, self.damp, self.column = ratio, counts.clip(1) ** -DAMPING, column
        self.row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[np.argsort(column, kind="stable")]
        by_column = np.bincount(column, minlength=len(ratio))
        self.filled, self.used = np.flatnonzero(counts), np.flatnonzero(by_column)
        self.row_starts = (np.cumsum(counts) - counts)[self.filled]
        self.column_starts = (np.cumsum(by_column) - by_column)[self.used]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.damp))
        if len(self.column):
            out[self.filled] = np.add.reduceat((w * self.ratio).astype(np.float32)[self.column], self.row_starts)
        return out * self.damp

    def gather(self, pull: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ratio))
        if len(self.row):
            out[self.used] = np.add.reduceat((pull * self.damp).astype(np.float32)[self.row], self.column_starts)
        return out * self.ratio


def _regress(x: _Sparse, y: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; the step follows from the
    largest curvature, found by power iteration."""
    n = len(x.ratio)
    top, curvature = np.ones(n), 1.0
    for _ in range(12):
        top = x.gather(weight * x.times(top / max(np.linalg.norm(top), 1e-30)))
        curvature = float(np.linalg.norm(top))
    step = 1 / (0.3 * (curvature + weight.sum()) + RIDGE)
    w, b, look_w, look_b, pace = np.zeros(n), 0.0, np.zeros(n), 0.0, 1.0
    for _ in range(rounds):
        pull = weight * (y - _logistic(x.times(look_w) + look_b))
        new_w = look_w + step * (x.gather(pull) - RIDGE * look_w)
        new_b = look_b + step * float(pull.sum())
        new_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = (pace - 1) / new_pace
        look_w, look_b = new_w + ahead * (new_w - w), new_b + ahead * (new_b - b)
        w, b, pace = new_w, new_b, new_pace
    return w, b


def _curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to labels, by Newton steps with a small ridge."""
    scale = max(float(np.std(margin)), 1e-9)
    x, a, b = margin / scale, 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * x + b)
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * x).sum() - 1e-3 * a, g.sum()])
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        a, b = max(a + move[0], 1e-3), b + move[1]
    return a / scale, b


def even_model(share: float) -> ToxicityModel:
    """Every text scores the share of label 1."""
    share = float(np.clip(share, 0.01, 0.99))
    return ToxicityModel(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))


def fit(labels: list[int], held: list[np.ndarray], ratios: np.ndarray, share: float, rounds: int = 200) -> ToxicityModel:
    """Fit on labels and the buckets that each text of the sample holds (only those with a
    ratio). ``share`` is the share of label 1 among all labelled documents: the curve is
    fitted for it, on margins that each half of the rows gets from a fit on the other."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return even_model(share)
    used = np.flatnonzero(ratios)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    x = _Sparse(np.array([len(h) for h in held]), place[np.concatenate(held)], ratios[used])
    even = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    rank = np.where(y > 0, np.cumsum(y), np.cumsum(1 - y)).astype(int)
    margin = np.zeros(len(y))
    for half in (0, 1):
        inside = rank % 2 == half
        w, b = _regress(x, y, np.where(inside, even * 2, 0.0), rounds)
        margin[~inside] = (x.times(w) + b)[~inside]
    slope, base = _curve(margin, y, len(y) * even * 2 * np.where(y > 0, share, 1 - share))
    w, b = _regress(x, y, even, rounds)
    weights = np.zeros(BUCKETS)
    weights[used] = w * ratios[used]
    return ToxicityModel(weights, b, slope, base)


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, float]:
    """The bounded sample (doc_id, label, text), written out, and the share of label 1 among all labels."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    order = F.xxhash64(F.lit(13), "doc_id")
    chosen = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(most // 2) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_id"), "label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("_id"))
    return stash(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxicity"), 0.5 if share is None else float(share)


def feature_counts(sample: DataFrame) -> DataFrame:
    """``bucket``, ``toxic``, ``clean``: documents of either label that hold a feature. Tasks
    count their own rows first, so at most ``BUCKETS`` rows of each are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), int)
            row, bucket = features(batch.column(1).to_pylist())
            for k in (0, 1):
                sums[k] += np.bincount(bucket[labels[row] == k], minlength=BUCKETS)
        seen = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[1, seen]), pa.array(sums[0, seen])], names=["bucket", "toxic", "clean"])

    counted = sample.select("label", "text").mapInArrow(count, "bucket int, toxic long, clean long")
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


_MODEL = T.StructType([T.StructField(n, T.ArrayType(kind)) for n, kind in (("buckets", T.IntegerType()), ("weights", T.DoubleType()), ("curve", T.DoubleType()))])


def fit_on_labels(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> ToxicityModel:
    """Fit on at most ``most`` labelled documents outside the held-out part, half of them of
    either label where there are enough, chosen by a hash of their ids; whole texts, null is
    empty. All tasks count features over the sample's texts; the ratios (at most ``BUCKETS``
    numbers) reach the driver; one task fits on the sample's selected features, of which a
    text has ``BUCKETS`` at most however long it is; only weights come back.

    A doc_id with several labels counts as toxic if one says so, one that stands on several
    rows has its smallest text. Null ids and labels other than 0 and 1 take no part; without
    documents of both labels every text scores the share of toxic ones (0.5 without any)."""
    sample, share = _labelled(docs, labels, most)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        drop(sample)
        return even_model(share)
    counts = feature_counts(sample).toPandas()
    sums = np.zeros((2, BUCKETS))
    sums[0, counts["bucket"]], sums[1, counts["bucket"]] = counts["clean"], counts["toxic"]
    ratios = log_count_ratios(sums[1], sums[0], sizes[1], sizes[0])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket = features(batch.column(2).to_pylist(), ratios != 0)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket))], names=["doc_id", "label", "held"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, y, held) for b in batches for i, y, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)]
        rows.sort(key=lambda r: r[0])
        model = fit([y for _, y, _ in rows], [held.values.to_numpy() for _, _, held in rows], ratios, share)
        used = np.flatnonzero(model.weights)
        parts = [used.astype(np.int32), model.weights[used], np.array([model.shift, model.slope, model.base])]
        yield pa.RecordBatch.from_arrays([pa.array([p], kind) for p, kind in zip(parts, (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=_MODEL.fieldNames())

    chosen = sample.select("doc_id", "label", "text").mapInArrow(select, T.StructType([sample.schema["doc_id"], sample.schema["label"], T.StructField("held", T.ArrayType(T.IntegerType()))]))
    fitted = chosen.repartition(1).mapInArrow(learn, _MODEL).first()
    drop(sample)
    weights = np.zeros(BUCKETS)
    weights[fitted["buckets"]] = fitted["weights"]
    return ToxicityModel(weights, *fitted["curve"])


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on). Null and empty
    texts hold no feature and score what the model gives to none; the score follows from the
    text alone, so repeated rows agree; columns of the new names (any case) are replaced; an
    empty table stays empty. Whole texts, no shuffle."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(model.score([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]), pa.float64())]

    scored = append_columns(without(docs, predicted), [T.StructField(score, T.DoubleType())], run)
    return scored.withColumn(predicted, (F.col(score) >= F.lit(THRESHOLD)).cast("int"))
