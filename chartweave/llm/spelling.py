"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced code
point, found by dense tiles of padded code-point matrices.

Two words, the longer of m code points, are one edit apart if their common prefix and their
common suffix together reach m - 1. The edit then stands in one of the pieces that m is cut
into, and outside that piece the words agree. So every word is dealt, per piece and for m its
own length and one more, into the bucket of what surrounds the piece; inside a bucket blocks
of rows are compared with one another as matrices, and prefix plus suffix decides. A pair is
counted in the piece of its first possible edit only, so exactly once.

A bucket of many rows is cut into halves of its piece until it is small or its piece is one
code point; then its words differ at that place alone and there are no more than letters. No
bucket is ever compared as a whole by all its pairs beyond that bound, and none is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.llm._shared import drop, stash

#: Letters of words, and how many code points a word has at least.
LETTERS, LEAST_LENGTH = r"A-Za-zÀ-ÿ", 7
#: Pieces a word is cut into, and rows (or code points) of a bucket from which on it is cut finer.
PIECES, BUCKET_ROWS, BUCKET_POINTS = 4, 256, 1 << 20
#: Cells of a padded matrix that one numpy step works on, unless one bucket alone has more.
_CELLS = 1 << 21
#: Keys of large buckets that are joined by broadcast; a longer list is joined by shuffle.
_FEW = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column) -> Column:
    """Maximal runs of letters that are long enough to be words, A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    return F.transform(found, lambda w: F.translate(w, _UPPER, _LOWER))


def misspell(doc_id: Column, run: Column, every: int = 31) -> Column:
    """``run`` without one code point where the crc32 of ``<doc_id>:<run>`` is a multiple of
    ``every``. A null id counts as no characters."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % F.lit(every) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, least: int = 2) -> DataFrame:
    """``word`` and ``n``: results of whole texts (null: none) that occur ``least`` times or
    more. Tasks count before the shuffle, so a word that fills a third of the corpus is a few rows."""
    each = docs.select(F.col("doc_id").alias("_id"), F.explode(runs(F.col("text"))).alias("_run"))
    words = each.select(misspell(F.col("_id"), F.col("_run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows with the piece [a, b) and the key of what stands before and behind it."""
    rest = F.col("m") - b
    around = (F.col("m"), a, F.substring(F.col("word"), F.lit(1), a), F.substring(F.col("word"), F.length("word") - rest + 1, rest))
    return rows.select("word", "n", "m", a.alias("a"), b.alias("b"), F.xxhash64(*around).alias("key"))


def _pieces(words: DataFrame) -> DataFrame:
    length = F.length("word")
    each = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m")).select("*", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("k"))
    return _keyed(each, F.floor(F.col("m") * F.col("k") / PIECES).cast("int"), F.floor(F.col("m") * (F.col("k") + 1) / PIECES).cast("int"))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    each = rows.select("word", "n", "m", F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))).alias("piece"))
    return _keyed(each, F.col("piece.a"), F.col("piece.b"))


def _matrices(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points (all below 256) of words, padded with 0, from their first and from their last one."""
    front = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    back = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    return front, back


def _shared_start(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    same = x[i] == x[j]
    return np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))


def _tile(words: list[bytes], n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many near words each row has in its bucket (rows up to ``ends``), counting pairs
    whose first edit is in the piece, and the row of the best one: largest n, then smallest word."""
    size = len(words)
    length = np.fromiter(map(len, words), np.int64, size)
    rank = np.empty(size, np.int64)
    rank[sorted(range(size), key=words.__getitem__)] = np.arange(size)
    front, back = _matrices(words, int(m.max()))
    near, best = np.zeros(size, np.int64), np.full(size, -1)
    rows = np.arange(size)
    for lag in range(1, int((ends - rows).max())):
        i = rows[rows + lag < ends]
        j = i + lag
        # the longer one has m code points; buckets whose hashes meet by chance stay apart
        fits = (np.maximum(length[i], length[j]) == m[i]) & (a[i] == a[j]) & (b[i] == b[j])
        i, j = i[fits], j[fits]
        shorter = np.minimum(length[i], length[j])
        prefix, suffix = np.minimum(_shared_start(front, i, j), shorter), np.minimum(_shared_start(back, i, j), shorter)
        edit = m[i] - 1 - suffix
        pair = (prefix + suffix >= m[i] - 1) & (prefix < m[i]) & (edit >= a[i]) & (edit < b[i])
        i, j = i[pair], j[pair]
        near[i] += 1
        near[j] += 1
        for one, other in ((i, j), (j, i)):
            have = best[one]
            better = (have < 0) | (n[other] > n[have]) | ((n[other] == n[have]) & (rank[other] < rank[have]))
            best[one[better]] = other[better]
    return near, best


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (m, key): whole buckets are put together to matrices of about ``_CELLS`` cells."""

    def found(part: pa.Table) -> pa.RecordBatch:
        column = {c: part.column(c).to_numpy() for c in ("n", "m", "a", "b", "key")}
        words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
        starts = np.flatnonzero(np.r_[True, (column["key"][1:] != column["key"][:-1]) | (column["m"][1:] != column["m"][:-1])])
        ends = np.repeat(np.r_[starts[1:], len(words)], np.diff(np.r_[starts, len(words)]))
        near, best = _tile(words, column["n"], column["m"].astype(np.int64), column["a"], column["b"], ends)
        hit = np.flatnonzero(near)
        out = [pa.array([words[k].decode("latin-1") for k in hit], pa.string()), pa.array(near[hit]), pa.array(column["n"][best[hit]], pa.int64())]
        return pa.RecordBatch.from_arrays([*out, pa.array([words[k].decode("latin-1") for k in best[hit]], pa.string())], names=["word", "n_near", "best_n", "best"])

    def whole(held: list[pa.RecordBatch], last: bool) -> tuple[pa.Table | None, list[pa.RecordBatch]]:
        """Rows of complete buckets, and the rest."""
        table = pa.Table.from_batches(held).combine_chunks()
        if last:
            return table, []
        key, m = table.column("key").to_numpy(), table.column("m").to_numpy()
        other = np.flatnonzero((key != key[-1]) | (m != m[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        return (table.slice(0, cut) if cut else None), table.slice(cut).to_batches()

    held: list[pa.RecordBatch] = []
    cells = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            step = batch.slice(at, 4096)
            held.append(step)
            cells += step.num_rows * int(step.column("m")[-1].as_py())
            if cells >= _CELLS:
                part, held = whole(held, False)
                cells = 0
                if part is not None and part.num_rows > 1:
                    yield found(part)
    if held:
        part, _ = whole(held, True)
        if part.num_rows > 1:
            yield found(part)


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``best``, ``best_n`` of the distinct ``word``s (with their ``n``)
    that have a word one edit away. Buckets that are too large are dealt anew by the halves of
    their piece, round after round; only counts of buckets reach the driver."""
    rows, tiles, kept = _pieces(words), None, []
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("m").alias("points"), F.max(F.col("b") - F.col("a")).alias("piece"))
        large = stash(sizes.where((F.col("rows") > BUCKET_ROWS) | (F.col("points") > BUCKET_POINTS)).where("piece > 1").select("key"), "spelling")
        kept.append(large)
        many = large.count()
        if many:
            keys = F.broadcast(large) if many <= _FEW else large
            small, rows = rows.join(keys, "key", "left_anti").select(*rows.columns), _halves(rows.join(keys, "key", "left_semi").where("b - a > 1"))
        else:
            small = rows
        tiles = small if tiles is None else tiles.unionByName(small)
        if not many:
            break
    compared = tiles.repartition("key").sortWithinPartitions("m", "key").mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    near = stash(compared.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")), "spelling")
    drop(*kept)
    return near


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """The last of each ``word``'s ``form``s. A form has ten times the occurrences, so a chain
    over words of 2 to ``most`` occurrences has log10(most / 2) steps at most; every round
    doubles the steps taken."""
    at, steps = forms.select("word", F.col("form").alias("root")), 1
    kept = None
    while steps < math.log10(max(most, 2) / 2):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = stash(at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling")
        drop(kept)
        kept, steps = at, steps * 2
    return at


def spelling_forms(docs: DataFrame, ratio: int = 10) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``docs``
    (``doc_id``, ``text``): its near words, the one of largest n (ties: smallest in code-point
    order) if it has ``ratio`` (10 at least) times the word's n, and where following forms ends.

    Null and empty texts have no words; repeated rows count again; further columns of any name
    are not read; an empty table gives no rows. Words of any length take part; a task holds a
    bucket's rows at most, each with its whole word."""
    if ratio < 10:
        raise ValueError("the bound on chains needs a ratio of 10 or more")
    words = stash(count_words(docs), "spelling")
    near = near_words(words)
    joined = words.join(near, "word", "left")
    follows = F.col("best_n") >= F.lit(ratio) * F.col("n")
    rows = stash(joined.select("word", F.when(follows, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("best_n")).alias("form_n")), "spelling")
    drop(words, near)
    most = rows.agg(F.max("n")).first()[0]
    roots = _roots(rows.where("form IS NOT NULL").select("word", "form"), most or 0)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
