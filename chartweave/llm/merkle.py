"""Merkle manifest of a table: a tree of SHA-256 digests per group of rows and one tree above
the groups, whose parents keep the hash state before each of their children's slots.

A parent hashes the hexadecimal digests of up to 16 children one behind the other. Such a
digest is 64 characters, one block of SHA-256, so the state before a slot is 32 bytes, and the
states of all slots come for nothing while the parent is made. To fold in another digest, the
state before its slot is resumed with the replacement and the siblings to its right; nothing to
the left is hashed again. States are plain columns of the manifest, so they outlive any task.

Rows get their place in a group by a range sort and a small table of running counts. Blocks of
256 consecutive nodes (two levels) are one row of the manifest; their tops are the nodes of the
next pass. So no task holds more than blocks of 256 nodes, whatever the size of a group, and a
group of n rows takes log256(n) passes. What a block needs of the levels above it is its trail:
a record of about 500 bytes a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.llm._shared import drop, stash

FAN, BLOCK = 16, 256
#: Blocks that one numpy step works on.
_STEP_BLOCKS = 32
_DIGEST = 32
#: A level of a trail: slot, number of children, state before the slot, the other children.
_RECORD = 2 + _DIGEST + (FAN - 1) * _DIGEST


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root(x: int, power: int) -> int:
    """Largest r with r ** power <= x."""
    low, high = 0, 1 << (x.bit_length() // power + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**power <= x else (low, mid - 1)
    return low


#: First 32 bits of the fractions of the square roots of 8 and of the cube roots of 64 primes.
_START = np.array([_root(p << 64, 2) % (1 << 32) for p in _primes(8)], np.uint32)
_ROUND = [np.uint32(_root(p << 96, 3) % (1 << 32)) for p in _primes(64)]
_HEX = np.frombuffer(b"".join(b"%02x" % b for b in range(256)), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256 states (8, n) after one more block (16, n) each, all side by side."""
    w = list(blocks)
    a, b, c, d, e, f, g, h = states
    for t in range(64):
        if t >= 16:
            x, y = w[(t - 15) % 16], w[(t - 2) % 16]
            w[t % 16] = w[t % 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[(t - 7) % 16] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
        up = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t % 16]
        low = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + up, c, b, a, up + low
    return states + np.stack([a, b, c, d, e, f, g, h])


def _ended(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests (8, n) of messages of so many 64-byte children, from the states behind them."""
    last = np.zeros((16, len(children)), np.uint32)
    last[0] = 0x80000000
    last[15] = children * 512
    return absorb(states, last)


def _words(raw: bytes | np.ndarray) -> np.ndarray:
    """32-byte strings end to end as states or digests (8, n)."""
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8).T)


def _raw(words: np.ndarray) -> np.ndarray:
    """States or digests (8, n) as bytes (n, 32)."""
    return np.ascontiguousarray(words.T).astype(">u4").view(np.uint8).reshape(-1, _DIGEST)


def _text(raw: np.ndarray) -> np.ndarray:
    """Hexadecimal characters (n, 64) of bytes (n, 32)."""
    return _HEX[raw].reshape(len(raw), 64)


def _message(words: np.ndarray) -> np.ndarray:
    """The block (16, n) that a digest (8, n) makes in its parent's message."""
    return np.ascontiguousarray(_text(_raw(words)).view(">u4").astype(np.uint32).T)


def hash_runs(blocks: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents (8, runs) of runs of children, whose messages are ``blocks`` (16, children), and
    the state (8, children) before each child's slot."""
    before = np.zeros((8, blocks.shape[1]), np.uint32)
    state = np.repeat(_START[:, None], len(starts), axis=1)
    for k in range(int(counts.max(initial=0))):
        on = np.flatnonzero(counts > k)
        at = starts[on] + k
        before[:, at] = state[:, on]
        state[:, on] = absorb(state[:, on], blocks[:, at])
    return _ended(state, counts), before


def resume(before: np.ndarray, digests: np.ndarray, blocks: np.ndarray, right: np.ndarray, ends: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Parents (8, n) after ``digests`` took the slots whose states are ``before``: siblings to
    the right are ``blocks[:, right:ends]``, a parent has ``children``."""
    state = absorb(before, _message(digests))
    k = 0
    while True:
        on = np.flatnonzero(right + k < ends)
        if not len(on):
            return _ended(state, children)
        state[:, on] = absorb(state[:, on], blocks[:, right[on] + k])
        k += 1


def field(column: Column) -> Column:
    """A value as hashed: ``-`` if null, else its UTF-8 byte count, ``:``, itself."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    """SHA-256 (32 bytes) of the fields of a row."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def _number(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, 0, 1, ... inside each group in ascending order (nulls first), and
    ``n``, the group's rows. A range sort deals out rows of one group, and equal rows (by the
    number of their line), over tasks; places follow from counts by task and group."""
    first = stash(rows, "merkle")
    salted = first.withColumn("_salt", F.monotonically_increasing_id() % 64)
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_salt")]
    lines = stash(salted.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_line", F.monotonically_increasing_id()).drop("_salt"), "merkle")
    drop(first)
    part = F.shiftright("_line", 33).alias("_part")
    parts = lines.groupBy(F.col(group).alias("_group"), part).agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    joined = lines.withColumn("_own", F.shiftright("_line", 33)).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_own") == F.col("_part")))
    return joined.select(*rows.columns, (F.col("_line") + F.col("_shift")).alias("at"), "n")


def _flat(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, _DIGEST)


def _levels(n: int) -> int:
    """Levels inside the blocks of a tree over n nodes."""
    return 0 if n == 1 else 1 if n <= FAN else 2


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents inside blocks: rows of (group, block, n, nodes) to rows of the manifest."""
    for batch in batches:
        for low in range(0, batch.num_rows, _STEP_BLOCKS):
            part = batch.slice(low, _STEP_BLOCKS)
            nodes = part.column("nodes").flatten()
            sizes = part.column("nodes").value_lengths().to_numpy()
            n = part.column("n").to_numpy()
            leaf = np.frombuffer(b"".join(nodes.field("leaf").to_pylist()), np.uint8).reshape(-1, _DIGEST)
            other = b"".join(o or own for o, own in zip(nodes.field("other").to_pylist(), nodes.field("leaf").to_pylist(), strict=True))
            first = np.r_[0, np.cumsum(sizes)]
            run_counts = np.array([-(-s // FAN) for s in sizes])
            starts = np.concatenate([np.arange(f, f + s, FAN) for f, s in zip(first[:-1], sizes, strict=True)])
            counts = np.minimum(np.repeat(first[1:], run_counts) - starts, FAN)
            mids, before = hash_runs(_message(_words(leaf.tobytes())), starts, counts)
            first_run = np.r_[0, np.cumsum(run_counts)]
            tops, mid_before = hash_runs(_message(mids), first_run[:-1], run_counts)
            levels = np.array([_levels(x) for x in n])
            raw_mids, raw_before, raw_tops, raw_mid_before = _raw(mids), _raw(before), _raw(tops), _raw(mid_before)
            top = [(leaf[first[k]], raw_mids[first_run[k]], raw_tops[k])[levels[k]].tobytes() for k in range(len(sizes))]
            cut = lambda table, at: [table[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            others = np.frombuffer(other, np.uint8).reshape(-1, _DIGEST)
            ids = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), nodes.field("id"))
            made = [ids, *(pa.array(x, pa.binary()) for x in (cut(leaf, first), cut(others, first), cut(raw_before, first), cut(raw_mids, first_run), cut(raw_mid_before, first_run), top))]
            yield pa.RecordBatch.from_arrays([part.column("group"), part.column("block"), part.column("n"), *made], names=["group", "block", "n", "ids", "leaves", "others", "states", "mids", "mid_states", "top"])


def _blocks(rows: DataFrame) -> DataFrame:
    node = F.struct("at", "id", "leaf", "other")
    gathered = rows.groupBy("group", F.shiftright("at", 8).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(node)).alias("nodes"))
    binaries = [T.StructField(c, T.BinaryType()) for c in ("leaves", "others", "states", "mids", "mid_states", "top")]
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in ("group",)], T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), *binaries])
    return gathered.mapInArrow(_climb, schema)


@dataclass
class Tree:
    """Passes of a tree, bottom up. A pass has a row for each 256 nodes of a group: ``group``,
    ``block``, ``n`` (the group's nodes in this pass), ``ids``, and digests and states end to
    end: ``leaves``, ``others`` (replacements), ``states`` (before the leaves' slots), ``mids``
    and ``mid_states`` of the level above, ``top`` of the block."""

    passes: list[DataFrame]

    def tops(self) -> DataFrame:
        """``group`` and ``top`` of every group."""
        found = [p.where(F.col("n") <= BLOCK).select("group", "top") for p in self.passes]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def grow(rows: DataFrame) -> Tree:
    """The tree over ``rows`` of (group, at, n, id, leaf, other)."""
    passes = []
    while True:
        passes.append(stash(_blocks(rows), "merkle"))
        most = passes[-1].agg(F.max("n")).first()[0]
        if most is None or most <= BLOCK:
            return Tree(passes)
        above = passes[-1].where(F.col("n") > BLOCK)
        n = F.ceil(F.col("n") / BLOCK).cast("long")
        rows = above.select("group", F.col("block").alias("at"), n.alias("n"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("other"))


def _own_trails(row: dict, trail: bytes) -> list[bytes]:
    """Trails of a block's nodes: records inside the block, then the block's own trail."""
    leaves, states, mids, mid_states = (row[c] for c in ("leaves", "states", "mids", "mid_states"))
    levels, size, runs = _levels(row["n"]), len(leaves) // _DIGEST, len(mids) // _DIGEST

    def record(table: bytes, befores: bytes, start: int, count: int, at: int) -> bytes:
        cut = lambda a, b: table[a * _DIGEST : b * _DIGEST]
        return bytes([at - start, count]) + befores[at * _DIGEST : (at + 1) * _DIGEST] + (cut(start, at) + cut(at + 1, start + count)).ljust((FAN - 1) * _DIGEST, b"\0")

    above = [record(mids, mid_states, 0, runs, r) + trail if levels == 2 else trail for r in range(runs)]
    return [(record(leaves, states, k // FAN * FAN, min(FAN, size - k // FAN * FAN), k) if levels else b"") + above[k // FAN] for k in range(size)]


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, _STEP_BLOCKS):
            part = batch.slice(low, _STEP_BLOCKS)
            rows = part.select([c for c in part.schema.names if c not in ("ids", "others")]).to_pylist()
            trails = [_own_trails(r, r["trail"]) for r in rows]
            sizes = [len(t) for t in trails]
            which = pa.array(np.repeat(np.arange(len(rows)), sizes))
            at = np.concatenate([r["block"] * BLOCK + np.arange(s) for r, s in zip(rows, sizes, strict=True)])
            columns = [part.column("group").take(which), pa.array(at), part.column("ids").flatten(), part.column("subroot").take(which), pa.array([t for ts in trails for t in ts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "block", "id", "subroot", "trail"])


def _trails(tree: Tree, starts: DataFrame) -> Iterator[DataFrame]:
    """For each pass, from the top, its blocks with their ``trail`` and ``subroot``; ``starts``
    has those of whole groups."""
    handed = None
    for blocks in reversed(tree.passes):
        same = starts.withColumnsRenamed({"group": "_group"})
        found = blocks.where(F.col("n") <= BLOCK).join(same, F.col("group").eqNullSafe(F.col("_group"))).drop("_group")
        if handed is not None:
            below = handed.withColumnsRenamed({"group": "_group", "block": "_block"}).drop("id")
            met = (F.col("group").eqNullSafe(F.col("_group"))) & (F.col("block") == F.col("_block"))
            found = found.unionByName(blocks.where(F.col("n") > BLOCK).join(below, met).drop("_group", "_block"))
        yield found
        handed = step_down(found)


def step_down(found: DataFrame) -> DataFrame:
    """``trail`` and ``subroot`` of every node of blocks that have their own."""
    node = found.schema
    schema = T.StructType([T.StructField("group", node["group"].dataType), T.StructField("block", T.LongType()), T.StructField("id", node["ids"].dataType.elementType), T.StructField("subroot", T.BinaryType()), T.StructField("trail", T.BinaryType())])
    return found.mapInArrow(_hand_down, schema)


@dataclass
class Manifest:
    """Trees of the groups' rows and of the groups, and the root (hexadecimal; none of an empty table)."""

    rows: Tree
    groups: Tree
    root: str | None

    def delete(self) -> None:
        drop(*self.rows.passes, *self.groups.passes)


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: ``group`` (a string), ``id``, ``leaf`` and ``other`` (32
    bytes; a replacement to fold, or null). In a group leaves ascend by id, then by digest;
    groups ascend bytewise, null first; null is a group and an id of its own. Equal rows are
    leaves of their own. Only the root and the largest count reach the driver."""
    tree = grow(_number(leaves.select("group", "id", "leaf", "other"), "group", ["id", "leaf", "other"]))
    groups = tree.tops().select(F.lit("").alias("group"), F.col("group").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("other"))
    above = grow(_number(groups, "group", ["id"]))
    top = above.tops().first()
    return Manifest(tree, above, top["top"].hex() if top else None)


def _proofs(rows: list[dict]) -> list[bytes]:
    """SHA-256 of the hexadecimal siblings of every leaf, level by level up to the root."""
    out = []
    for row in rows:
        leaves, mids, trail = row["leaves"].hex().encode(), row["mids"].hex().encode(), row["trail"]
        others = [trail[k + 2 + _DIGEST : k + 2 + _DIGEST + (trail[k + 1] - 1) * _DIGEST] for k in range(0, len(trail), _RECORD)]
        above, levels = b"".join(others).hex().encode(), _levels(row["n"])
        for r in range(0, len(leaves), FAN * 64):
            run = leaves[r : r + FAN * 64] if levels else b""
            at = r // FAN
            tail = (mids[:at] + mids[at + 64 :] if levels == 2 else b"") + above
            out += [hashlib.sha256(run[:k] + run[k + 64 :] + tail).digest() for k in range(0, len(leaves[r : r + FAN * 64]), 64)]
    return out


def _folds(rows: list[dict]) -> np.ndarray:
    """Roots (n, 32) after every leaf's replacement took its slot."""
    sizes = np.array([len(r["leaves"]) // _DIGEST for r in rows])
    runs = np.array([len(r["mids"]) // _DIGEST for r in rows])
    first, first_run = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(runs)]
    block = np.repeat(np.arange(len(rows)), sizes)
    inner = np.arange(first[-1]) - first[block]
    levels = np.array([_levels(r["n"]) for r in rows])[block]
    join = lambda name: _words(b"".join(r[name] for r in rows))
    now = join("others")
    start = first[block] + inner // FAN * FAN
    end = np.minimum(start + FAN, first[block + 1])
    on = np.flatnonzero(levels >= 1)
    now[:, on] = resume(join("states")[:, on], now[:, on], _message(join("leaves")), on + 1, end[on], (end - start)[on])
    on = np.flatnonzero(levels == 2)
    mid = first_run[block] + inner // FAN
    now[:, on] = resume(join("mid_states")[:, mid[on]], now[:, on], _message(join("mids")), mid[on] + 1, first_run[block[on] + 1], runs[block[on]])
    steps = np.array([len(r["trail"]) // _RECORD for r in rows])
    for k in range(int(steps.max(initial=0))):
        with_step = np.flatnonzero(steps > k)
        place = np.zeros(len(rows), np.int64)
        place[with_step] = np.arange(len(with_step))
        records = np.frombuffer(b"".join(rows[b]["trail"][k * _RECORD : (k + 1) * _RECORD] for b in with_step), np.uint8).reshape(-1, _RECORD)
        on = np.flatnonzero(steps[block] > k)
        at = place[block[on]]
        slot, children = records[:, 0].astype(np.int64), records[:, 1].astype(np.int64)
        siblings = _message(_words(np.ascontiguousarray(records[:, 2 + _DIGEST :]).tobytes()))
        states = _words(np.ascontiguousarray(records[:, 2 : 2 + _DIGEST]).tobytes())
        base = at * (FAN - 1)
        now[:, on] = resume(states[:, at], now[:, on], siblings, base + slot[at], base + children[at] - 1, children[at])
    return _raw(now)


def _hexes(raw: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(_text(raw))
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * 64), pa.py_buffer(data))


def _unfold(make: Callable[[list[dict]], dict[str, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _STEP_BLOCKS):
                part = batch.slice(low, _STEP_BLOCKS)
                rows = part.select([c for c in part.schema.names if c not in ("ids", "group")]).to_pylist()
                which = pa.array(np.repeat(np.arange(len(rows)), [len(r["leaves"]) // _DIGEST for r in rows]))
                made = make(rows)
                yield pa.RecordBatch.from_arrays([part.column("group").take(which), part.column("ids").flatten(), *map(_hexes, made.values())], names=["group", "id", *made])

    return run


def _verified(rows: list[dict]) -> dict[str, np.ndarray]:
    sizes = [len(r["leaves"]) // _DIGEST for r in rows]
    return {"leaf": _flat([r["leaves"] for r in rows]), "subroot": np.repeat(_flat([r["subroot"] for r in rows]), sizes, axis=0), "proof_sha256": _flat(_proofs(rows)), "folded_root": _folds(rows)}


def fold(manifest: Manifest) -> DataFrame:
    """A row for every leaf: ``group``, ``id``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (of its siblings up to the root), ``folded_root`` (after its replacement,
    or itself, took its slot) and ``verified`` (whether that is the root)."""
    starts = manifest.groups.passes[0].sparkSession.createDataFrame([("", bytearray(), bytearray())], "group string, trail binary, subroot binary")
    *_, lowest = _trails(manifest.groups, starts)
    handed = step_down(lowest).select(F.col("id").alias("group"), "trail")
    tops = manifest.rows.tops().withColumnsRenamed({"group": "_group", "top": "subroot"})
    own = stash(handed.join(tops, F.col("group").eqNullSafe(F.col("_group"))).drop("_group"), "merkle")
    *_, found = _trails(manifest.rows, own)
    node = found.schema
    texts = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")]
    out = found.mapInArrow(_unfold(_verified), T.StructType([T.StructField("group", node["group"].dataType), T.StructField("id", node["ids"].dataType.elementType), *texts]))
    root = F.lit(manifest.root).cast("string")
    return out.select("group", "id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents (``doc_id``, ``source``, ``lang``, ``n_chars``, ``text``), grouped by
    ``source``; where ``tampered`` holds, ``other`` is the leaf of the text with A-Z in lower
    case. Nulls are hashed as such; further columns are not read."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col("source").cast("string").alias("group"), F.col("doc_id").alias("id"), digest(*own, F.col("text")).alias("leaf"), F.when(tampered, digest(*own, low)).alias("other"))
