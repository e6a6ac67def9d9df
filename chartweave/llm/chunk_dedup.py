"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes: h = (h << 1) + gear[byte]; the tested bits depend on the
last 16 bytes only, so the same passage is cut at the same places wherever it stands, and an
insertion shifts cuts near it alone. Cuts fall behind white space (in scripts without spaces
behind any character of three bytes or more), so chunks hold whole words. Digests are taken
of windows: the fewest chunks side by side, from every chunk forwards and backwards, that
have ``min_words`` words. A window whose digest stands in an earlier document is a passage
that one document holds as a whole; overlapping or touching windows are one repeated span.
Chunks that stand in different documents make no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.llm._shared import SPACE, append_columns, join_unique, spare, span_hashes, stash, steps, text_bytes, word_spans

MIN_BYTES, MAX_BYTES = 16, 256
#: One in so many word ends (characters, without spaces) is a cut.
CUT_WORDS, CUT_CHARS = 4, 16
WINDOW = 16
_GEAR = np.random.Generator(np.random.PCG64(31337)).integers(1, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last 16 bytes at every byte, by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return h


def chunk_bounds(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text, the last being its length."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    h = gear_hashes(raw) >> np.uint32(WINDOW + 4)
    space = SPACE[raw]
    ahead = np.r_[raw[1:], np.uint8(0x20)]
    cut = space & ~SPACE[ahead] & (h % np.uint32(CUT_WORDS) == 0)
    if raw.max() >= 0xE0:
        wide = np.zeros(n, bool)
        lead = np.flatnonzero(raw >= 0xE0)
        last = np.minimum(lead + np.where(raw[lead] >= 0xF0, 3, 2), n - 1)
        wide[last] = True
        cut |= wide & (h % np.uint32(CUT_CHARS) == 0)
    out, start = [], 0
    for end in (np.flatnonzero(cut) + 1).tolist():
        while end - start > MAX_BYTES:
            start = _forced(raw, start + MAX_BYTES)
            out.append(start)
        if end - start >= MIN_BYTES:
            out.append(end)
            start = end
    while n - start > MAX_BYTES:
        start = _forced(raw, start + MAX_BYTES)
        out.append(start)
    if start < n:
        out.append(n)
    return np.array(out, np.int64)


def _forced(raw: np.ndarray, at: int) -> int:
    """The last start of a character up to ``at``."""
    while raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of rows end to end start; in scripts without spaces (Thai, Lao, Burmese,
    Khmer, kana, Han) every character is a word."""
    words = word_spans(raw, offsets)[0]
    if not len(raw) or raw.max() < 0xE0:
        return words
    second = np.r_[raw[1:], np.uint8(0)]
    pair = raw.astype(np.uint16) << 8 | second
    bare = (pair >= 0xE0B8) & (pair <= 0xE0BB) | (pair >= 0xE180) & (pair <= 0xE182) | (pair >= 0xE19E) & (pair <= 0xE19F)
    bare |= (pair >= 0xE2BA) & (pair <= 0xE9BF) | (pair >= 0xEFA4) & (pair <= 0xEFAB) | (pair >= 0xF0A0) & (pair <= 0xF0B3)
    return np.union1d(words, np.flatnonzero(bare))


def chunk_windows(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunks of the windows. ``starts`` and ``ends`` count the words before
    and up to the end of every chunk, ``first`` and ``last`` are the chunks of its row."""
    every = np.arange(len(starts))
    to = np.searchsorted(ends, starts + min_words)
    since = np.searchsorted(starts, ends - min_words, side="right") - 1
    ahead = to <= last
    back = since >= first
    back[back] = to[since[back]] != every[back]
    return np.r_[every[ahead], since[back]], np.r_[to[ahead], every[back]]


WINDOWS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "text_key", "digest", "place", "words")])


def text_key(text: Column) -> Column:
    """A hash of a text: with the doc_id it tells rows apart that repeat a doc_id."""
    return F.xxhash64(text)


def window_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, digest, place, words) of all windows; ``place`` packs the first byte and the
    end, ``words`` the number of words before the window and up to its end (32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            doc_ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for low, high in steps(offsets):
                part = data[offsets[low] : offsets[high]]
                own = offsets[low : high + 1] - offsets[low]
                bounds = [chunk_bounds(part[own[i] : own[i + 1]]) for i in range(high - low)]
                counts = np.array([len(b) for b in bounds])
                if not counts.sum():
                    continue
                base = np.repeat(own[:-1], counts)
                ends = np.concatenate(bounds) + base
                starts = np.r_[0, ends[:-1]]
                at = np.cumsum(np.r_[0, counts[:-1]])
                starts[at[counts > 0]] = own[:-1][counts > 0]
                units = unit_starts(part, own)
                before, upto = np.searchsorted(units, starts), np.searchsorted(units, ends)
                first = np.repeat(at, counts)
                a, b = chunk_windows(before, upto, first, first + np.repeat(counts, counts) - 1, max(min_words, 1))
                zero = before[first[a]]
                place = (starts[a] - base[a]) << 32 | (ends[b] - base[a])
                words = (before[a] - zero) << 32 | (upto[b] - zero)
                columns = [np.repeat(doc_ids[low:high], counts)[a], np.repeat(keys[low:high], counts)[a], span_hashes(part, starts[a], ends[b]).view(np.int64), place, words]
                for k in range(0, len(place), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 200_000], pa.int64()) for c in columns], names=WINDOWS.fieldNames())

    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return named.mapInArrow(run, WINDOWS)


def repeated_spans(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """(doc_id, text_key, span_start, span_end, n_words, first_doc_id): byte spans of a document made of
    windows of ``min_words`` words or more that stand, each as a whole, in documents of smaller
    doc_id; ``first_doc_id`` is the first document that has the span's first window. Where a
    script has no spaces, characters count as words.

    The first document keeps its passage and is not named. Repeats inside one document do
    not count, nor do those between rows that repeat a doc_id; such rows have spans of their own,
    told apart by ``text_key``, and equal rows share them. Very long texts are cut whole, in
    steps of their own. Where several documents have a passage, that of smallest doc_id is the
    first. Null ids and null or empty texts have no spans; an empty table gives none."""
    windows = stash(window_rows(docs, min_words), "dedup-windows")
    digests = windows.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_rows"))
    shared = stash(digests.where("first_doc_id < _last").drop("_last"), "dedup-digests")
    found = join_unique(windows, shared, ["digest"], windows.count(), part=10_000).where("doc_id > first_doc_id")
    low = F.lit(0xFFFFFFFF).cast("long")
    rows = found.select(
        "doc_id", "text_key", "first_doc_id",
        F.shiftright("place", 32).alias("start"), F.col("place").bitwiseAND(low).alias("end"),
        F.shiftright("words", 32).alias("_before"), F.col("words").bitwiseAND(low).alias("_upto"),
    ).dropDuplicates(["doc_id", "text_key", "start", "end"])
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int")
    runs = rows.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order))
    spans = runs.groupBy("doc_id", "text_key", "_run").agg(
        F.min("start").alias("span_start"), F.max("end").alias("span_end"), (F.max("_upto") - F.min("_before")).alias("n_words"),
        F.min_by("first_doc_id", F.struct("start", "end")).alias("first_doc_id"),
    )
    return spans.select("doc_id", "text_key", "span_start", "span_end", "n_words", "first_doc_id")


#: Bytes of the table of spans that are broadcast at most (16 bytes a span, 24 a document);
#: beyond, join by shuffle.
BROADCAST_BYTES = 8 << 20


def remove_repeats(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``; ``n_chars`` follows if there is
    one. A document of which only white space is left goes; all others, those with null or
    empty text too, stay as they are. Rows that repeat a doc_id lose their own spans only.
    Columns of any other name are kept; an empty table stays empty."""
    each = F.sort_array(F.collect_list(F.struct("span_start", "span_end")))
    spans = stash(repeated_spans(docs, min_words).groupBy("doc_id", "text_key").agg(each.alias("spans")), "dedup-spans")
    size = spans.agg(F.sum(F.size("spans") * 16 + 24)).first()[0] or 0
    side = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    cuts, new_text = spare(docs, "_spans"), spare(docs, "_text")
    side = side.select(F.col("doc_id").alias("_of"), F.col("text_key").alias("_key"), F.col("spans").alias(cuts))
    joined = docs.join(side, (docs["doc_id"].cast("long") == side["_of"]) & (text_key(docs["text"]) == side["_key"]), "left")
    joined = joined.select(*[docs[f"`{c}`"] for c in docs.columns], side[cuts])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, spans_of = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index(cuts))
        out = []
        for t, own in zip(texts.to_pylist(), spans_of.to_pylist()):
            if own and t is not None:
                raw, at, parts = t.encode("utf-8"), 0, []
                for s in own:
                    parts.append(raw[at : s["span_start"]])
                    at = max(at, s["span_end"])
                t = b"".join([*parts, raw[at:]]).decode("utf-8")
            out.append(t)
        return [pa.array(out, pa.string())]

    cut = append_columns(joined, [T.StructField(new_text, T.StringType())], run)
    cut = cut.where(F.col(cuts).isNull() | F.col(new_text).rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col(new_text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length(new_text)).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
