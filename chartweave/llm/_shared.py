"""What the operators of this subpackage share: writing a table that cuts lineage,
appending columns in Arrow batches, and numpy views of whole texts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a numpy step works on at once; a longer text makes a step of its own.
STEP_BYTES = 1 << 19
#: Rows of an Arrow batch that a column function gets at once.
STEP_ROWS = 1000

_own_folder: list[str] = []
_folder_of: dict[DataFrame, str] = {}
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of
    this process where the session names none and runs in local mode, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-chartweave-"))
    return _own_folder[0]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later steps start
    from files that outlive any executor. ``drop`` deletes them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folder_of[table] = path
    for held in getattr(_open, "held", [])[-1:]:
        held.append(table)
    return table


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can reach."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*tables: DataFrame | None) -> None:
    """Delete stashed tables, once everything made from them is itself written."""
    for table in tables:
        if table is not None and (path := _folder_of.pop(table, None)):
            delete_folder(table.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, what this thread stashed inside."""
    _open.held = [*getattr(_open, "held", []), []]
    try:
        yield
    finally:
        drop(*_open.held.pop())


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], total: int, rows: str = "_rows", part: int = 1000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and in ``rows`` how often
    ``left`` has it. Keys with more than 1 / ``part`` of the ``total`` rows, fewer than ``part``
    keys by count, are joined by broadcast, so a hot key never lands in one task; the others
    by shuffle. Both sides should be stashed tables: they are read twice."""
    floor = max(total // part, 1000)
    often = right.where(F.col(rows) > F.lit(floor))
    seldom = right.where(F.col(rows) <= F.lit(floor))
    if often.isEmpty():
        return left.join(right, keys)
    spread = left.join(F.broadcast(often), keys)
    others = left.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(seldom, keys)
    return spread.unionByName(others)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names clash with ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def spare(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(
    df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]], after: Callable[[], None] | None = None
) -> DataFrame:
    """``df`` with new columns that ``compute`` makes for each Arrow batch. Columns of the
    same names (any case) are replaced. ``after`` runs at a task's end: workers live on for
    other work, and what a task remembered should not."""
    base = without(df, *[f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, STEP_ROWS):
                    part = batch.slice(at, STEP_ROWS)
                    yield pa.RecordBatch.from_arrays([*part.columns, *compute(part)], names=names)
        finally:
            if after:
                after()

    return base.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end and the n + 1 offsets of the rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold up to ``limit`` bytes, or one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        high = min(high, n)
        yield low, high
        low = high


#: White space between words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64, for 0..n-1."""
    size = max(1 << 16, 1 << max(n - 1, 1).bit_length())
    for have in _powers:
        if have >= n:
            return _powers[have]
    with np.errstate(over="ignore"):
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p))
    _powers.clear()
    _powers[size] = (tables[0], tables[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every input bit (new array)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of the byte spans [start, end): equal bytes, equal digest, wherever
    the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * power[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs outside ``space``) of rows end to end, and the index
    of each row's first word (n + 1 values). Words never cross rows."""
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] |= solid[inner]
        last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the lengths of the rows."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
