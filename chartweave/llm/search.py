"""Exact top-k search by BM25 with dynamic pruning, per shard, merged exactly.

Statistics (documents, mean length, document frequencies) are global. Texts are taken apart
once, into digests and counts of terms. One document of sixteen is searched first: a query's
k-th best score there is its floor for the others. A shard is up to ``shard_rows`` documents of
a task: its rare terms by term, all its terms by document, and the impacts of its frequent terms
(in more than a sixteenth of its documents) as dense rows. Queries that ask for like frequent
terms multiply them together, in single precision; each adds up the postings of its rare terms.
What comes out is a document's score but for rounding, whose bound is known: documents that
can reach the floor or the k-th best of the shard are scored whole in double precision, the
others go. Each shard's best k are merged by score.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower
case, and are held as 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm._shared import LOWER, STEP_ROWS, span_hashes, stash, steps, text_bytes, word_spans

K1, B = 1.2, 0.75
#: A term is frequent in a shard if more than one of so many documents, and more than so many, hold it.
RARE, BLOCK = 16, 64
#: One of so many documents is searched before the others.
AHEAD = 16
#: Queries whose frequent terms are added up at once.
QUERIES = 64
#: Decimals of a score; sums in another order agree in them.
DECIMALS = 9
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Step by step over the rows: the step's first row, its rows' lengths in terms, and row,
    term and count of every distinct term of a row, in order of row and term."""
    every, offsets = text_bytes(column)
    for low, high in steps(offsets, 1 << 20):
        data = LOWER[every[offsets[low] : offsets[high]]]
        own = offsets[low : high + 1] - offsets[low]
        starts, ends, first = word_spans(data, own, _BETWEEN)
        term = span_hashes(data, starts, ends).view(np.int64)
        length = np.diff(first)
        row = np.repeat(np.arange(high - low), length)
        order = np.lexsort((term, row))
        term, row = term[order], row[order]
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])]) if len(term) else np.zeros(0, int)
        yield low, length, row[new], term[new], np.diff(np.r_[new, len(term)])


def term_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, length, terms, counts): of each document its length in terms, its distinct terms
    (digests, 8 bytes each) and their counts (4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, length, row, term, count in term_counts(batch.column(1)):
                at = np.searchsorted(row, np.arange(len(length) + 1))
                packed = [pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x, size in ((term, 8), (count.astype(np.int32), 4))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(length)), pa.array(length, pa.int64()), *packed], names=["doc_id", "length", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, length long, terms binary, counts binary")


def postings_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every distinct term of rows of ``term_rows``."""

    def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        size, column = np.dtype(kind).itemsize, column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return raw[at[0] : at[-1]].view(kind), np.diff(at) // size

    (term, many), (count, _) = flat(batch.column(2), np.int64), flat(batch.column(3), np.int32)
    return np.repeat(np.arange(batch.num_rows), many), term, count


def statistics(rows: DataFrame) -> tuple[DataFrame, int, float]:
    """(term, df) over all documents of ``term_rows``, their number and the mean number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, held = [], [], 0
        seen = length = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            t, n = np.concatenate(terms), np.concatenate(counts)
            order = np.argsort(t, kind="stable")
            t, n = t[order], n[order]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            return t[first], np.add.reduceat(n, first)

        def out(t: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(t), 100_000):
                part = t[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[at : at + 100_000]), pa.nulls(len(part), pa.int64())], names=["term", "df", "length"])

        for batch in batches:
            for low in range(0, batch.num_rows, STEP_ROWS):
                step = batch.slice(low, STEP_ROWS)
                seen += step.num_rows
                length += int(step.column(1).to_numpy().sum())
                _, term, _ = postings_of(step)
                if len(term):
                    t, n = np.unique(term, return_counts=True)
                    terms.append(t), counts.append(n)
                    held += len(t)
                if held > 3_000_000:
                    t, n = merged()
                    terms, counts, held = [t], [n], len(t)
                    if held > 2_000_000:
                        yield from out(t, n)
                        terms, counts, held = [], [], 0
        if terms:
            yield from out(*merged())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([seen]), pa.array([length])], names=["term", "df", "length"])

    counted = stash(rows.mapInArrow(run, "term long, df long, length long"), "search-terms")
    whole = counted.where("length IS NOT NULL").agg(F.sum("df"), F.sum("length")).first()
    n = whole[0] or 0
    return counted.where("length IS NULL").groupBy("term").agg(F.sum("df").alias("df")), n, (whole[1] or 0) / n if n else 0.0


class Shard:
    """The index of some documents, over the terms that the queries ask for: their rare terms
    by term, all by document, and the impacts of their frequent terms as dense rows."""

    def __init__(self, ids: np.ndarray, parts: list[tuple], length: np.ndarray, words: int, mean_length: float):
        n = len(ids)
        self.ids, self.repeats = ids, len(np.unique(ids)) < n
        doc, self.word, tf = (np.concatenate(x) for x in zip(*parts))
        parts.clear()  # the postings are held once
        norm = K1 * (1 - B + B * length / mean_length) if mean_length else np.ones(n)
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.impact = norm[doc]
        self.impact += tf
        np.divide(tf * (K1 + 1), self.impact, out=self.impact)
        df = np.bincount(self.word, minlength=words)
        frequent = np.flatnonzero(df > max(n // RARE, BLOCK))
        self.column = np.full(words, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), n), np.float32)
        # sums of positive numbers in single precision are wrong by a smaller share than this
        self.slack = 1 - (len(frequent) + 16) * 2.0**-23
        column = self.column[self.word]
        at = np.flatnonzero(column >= 0)
        self.dense[column[at], doc[at]] = self.impact[at]
        df[frequent] = 0
        self.start = np.r_[0, np.cumsum(df)]
        at = np.flatnonzero(column < 0)
        del column
        at = at[np.argsort(self.word[at], kind="stable")]
        # a posting's document and impact stand in one place of memory: as real and imaginary part
        self.rare = np.empty(len(at), np.complex64 if n < 1 << 24 else np.complex128)
        self.rare.real, self.rare.imag = doc[at], self.impact[at]

    def gather(self, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of weighted impacts of the rare words' postings for every document."""
        a, n = self.start[words], self.start[words + 1] - self.start[words]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]))
        at += np.repeat(a - (ends - n), n)
        rows = self.rare.take(at)
        return np.bincount(rows.real.astype(np.int64), weights=rows.imag * np.repeat(weights, n), minlength=len(self.ids)).astype(float, copy=False)

    def scores(self, docs: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents; both sides have their words in order."""
        out = np.zeros(len(docs))
        for i, (a, b) in enumerate(zip(self.first[docs].tolist(), self.first[docs + 1].tolist())):
            own = self.word[a:b]
            at = own.searchsorted(words)
            at[at == b - a] = 0
            hit = own[at] == words
            out[i] = (weights[hit] * self.impact[a + at[hit]]).sum()
        return out

    def ranked(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best; ties to smaller ids, of rows that repeat an id the best."""
        ids, scores = self.ids[docs], np.round(scores, DECIMALS)
        order = np.lexsort((ids, -scores))
        if self.repeats:
            order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
        order = order[:k]
        return ids[order], scores[order]

    def best(self, bounds: np.ndarray, words: np.ndarray, weights: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query its number, and ids and scores of the k best documents with a positive
        score that reach its floor. Query i has the words from bounds[i] to bounds[i + 1]."""
        # queries whose weightiest frequent term is the same ask for the same columns, mostly
        own = [slice(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        order = np.argsort([self.column[words[q][np.argmax(weights[q] * (self.column[words[q]] >= 0))]] for q in own], kind="stable").tolist()
        for low in range(0, len(order), QUERIES):
            part = order[low : low + QUERIES]
            asked = np.zeros((len(part), len(self.dense) + 1), np.float32)
            for i, q in enumerate(part):
                asked[i, self.column[words[own[q]]]] = weights[own[q]]
            # rare terms have column -1
            used = np.flatnonzero(asked[:, :-1].any(axis=0))
            sums = asked[:, used] @ self.dense[used]
            for i, q in enumerate(part):
                yield q, *self.best_of(words[own[q]], weights[own[q]], sums[i], floors[q], k)

    def best_of(self, words: np.ndarray, weights: np.ndarray, frequent: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        most = self.gather(words, weights)
        most += frequent
        docs = np.flatnonzero(most >= floor * self.slack - 1e-8) if floor > 0 else np.flatnonzero(most)
        if not len(docs):
            return self.ids[:0], most[:0]
        if len(docs) > 8 * k and self.repeats:
            promising = docs[np.argpartition(-most[docs], 4 * k)[: 4 * k]]
            _, found = self.ranked(promising, self.scores(promising, words, weights), k)
            docs = docs[most[docs] >= found[-1] * self.slack - 1e-8] if len(found) == k else docs
        elif len(docs) > k and not self.repeats:
            docs = docs[most[docs] >= np.partition(most[docs], len(docs) - k)[len(docs) - k] * self.slack**2 - 1e-8]
        scores = self.scores(docs, words, weights)
        ids, scores = self.ranked(docs, scores, k)
        return ids[scores > 0], scores[scores > 0]


def top_k(docs: DataFrame, is_query: Column, k: int = 10, shard_rows: int = 12_000, query_block: int = 8192) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row for which ``is_query`` holds the ``k``
    best rows of the whole table, itself included, by BM25 with k1 = 1.2, b = 0.75 and
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a term that a query holds n times counts n
    times. Scores are rounded to 9 decimals.

    Whole texts on both sides. Rows whose score is 0 are not found, so null, empty and
    wordless texts neither ask nor answer. Ties go to the smaller doc_id. Rows with a null
    doc_id count in the statistics only; rows that repeat a doc_id are found once, with
    their best score, and ask once, with the first text in order. An empty table gives no
    rows. Queries go to all shards in blocks of ``query_block``, whose size bounds what is
    broadcast at once."""
    spark = docs.sparkSession
    schema = "query_id long, doc_id long, score double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a share of the documents is searched first: what it finds is a floor for all others
    ahead = F.pmod(F.xxhash64("doc_id"), F.lit(AHEAD)) == 0
    parts = [stash(term_rows(docs.where(on)), "search-docs") for on in (ahead, ~ahead)]
    frequencies, n, mean_length = statistics(parts[0].unionByName(parts[1]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, _, row, term, count in term_counts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[low + row]), pa.array(term), pa.array(count)], names=["query_id", "term", "n"])

    queries = docs.where(F.col("doc_id").isNotNull() & is_query).groupBy("doc_id").agg(F.min("text").alias("text"))
    weight = F.col("n") * F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    asked = stash(queries.mapInArrow(ask, "query_id long, term long, n long").join(frequencies, "term").select("query_id", "term", weight.alias("weight")), "search-queries")
    blocks = max(1, -(-asked.select("query_id").distinct().count() // query_block))
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        # about query_block queries at most reach the driver and the executors at a time
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == F.lit(block)).toArrow()
        vocabulary, word = np.unique(rows["term"].to_numpy(), return_inverse=True)
        q_ids, weights = rows["query_id"].to_numpy(), rows["weight"].to_numpy()
        del rows
        order = np.lexsort((word, q_ids))
        q_ids, word, weights = q_ids[order], word[order].astype(np.int32), weights[order]
        first = np.flatnonzero(np.r_[True, q_ids[1:] != q_ids[:-1]]) if len(q_ids) else np.zeros(0, int)
        own = q_ids[first]
        shared = spark.sparkContext.broadcast((vocabulary, own, np.r_[first, len(q_ids)], word, weights))
        floors = np.zeros(len(own))
        for part in parts:
            floor = spark.sparkContext.broadcast(floors)

            def search(batches: Iterator[pa.RecordBatch], shared=shared, floor=floor) -> Iterator[pa.RecordBatch]:
                vocabulary, queries, bounds, words, weights = shared.value
                ids: list[np.ndarray] = []
                postings: list[tuple] = []
                lengths: list[np.ndarray] = []

                def answer() -> pa.RecordBatch:
                    shard = Shard(np.concatenate(ids), postings, np.concatenate(lengths).astype(float), len(vocabulary), mean_length)
                    q_col, d_col, s_col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                    for q, best, scores in shard.best(bounds, words, weights, floor.value, k):
                        q_col.append(np.full(len(best), queries[q])), d_col.append(best), s_col.append(scores)
                    ids.clear(), lengths.clear()
                    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (q_col, d_col, s_col)], names=["query_id", "doc_id", "score"])

                held = 0
                for batch in batches if len(queries) else ():
                    for low in range(0, batch.num_rows, STEP_ROWS):
                        step = batch.slice(low, STEP_ROWS)
                        row, term, count = postings_of(step)
                        at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
                        hit = vocabulary[at] == term
                        ids.append(step.column(0).to_numpy()), lengths.append(step.column(1).to_numpy())
                        postings.append(((row[hit] + held).astype(np.int32), at[hit].astype(np.int32), count[hit]))
                        held += step.num_rows
                        if held >= shard_rows:
                            yield answer()
                            held = 0
                if held:
                    yield answer()

            rows = part.where("doc_id IS NOT NULL")
            shards = max(spark.sparkContext.defaultParallelism, -(-n // shard_rows // (AHEAD if part is parts[0] else 1)))
            # answers are written before the next step, and what was sent out for them is let go
            answers = stash(rows.coalesce(shards).mapInArrow(search, schema), "search-found")
            found = found.unionByName(answers)
            if part is parts[0]:
                last = best_of_each(answers, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
                floors = floors.copy()
                floors[np.searchsorted(own, last["query_id"].to_numpy())] = last["score"].to_numpy()
            floor.destroy()
        shared.destroy()
    return best_of_each(found, k).select("query_id", "rank", "doc_id", "score")


def best_of_each(found: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query, each once, with their ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    once = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
