"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard follows from the key and the shard count alone, without a table of the ring.
The generator of the jump hash multiplies modulo 2**64; Spark's long product fails on
overflow in ANSI mode, so the 64-bit state is kept as two 32-bit halves and multiplied in
16-bit steps that never leave the positive longs.

Slots (places inside a shard) need the rank of a row among all rows of its shard. Rows are
dealt into many buckets of a shard by a hash of the whole row, equal rows are counted
before the shuffle, buckets are numbered by running sums over a small table, and ranks are
made inside buckets: no task gets a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed multiplier of the published jump hash, 2862933555777941757, as two 32-bit halves.
_MULTIPLIER_HIGH, _MULTIPLIER_LOW = divmod(2862933555777941757, 1 << 32)
_MASK32, _MASK16 = (1 << 32) - 1, (1 << 16) - 1
#: Jumps that are computed for every key; a key that needs more (chance below 1e-20) goes on.
_USUAL_JUMPS = 64


def _times(x: Column, y: int) -> tuple[Column, Column]:
    """Low 48 bits' worth and the rest of x * y for 32-bit x and y: x*y = a + b * 2**16."""
    return x * F.lit(y & _MASK16), x * F.lit(y >> 16)


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """state * multiplier + 1 modulo 2**64, on halves."""
    a, b = _times(low, _MULTIPLIER_LOW)
    c, d = _times(high, _MULTIPLIER_LOW)
    bottom = a + F.shiftleft(b.bitwiseAND(F.lit(_MASK16)), 16) + F.lit(1)
    carry = F.shiftright(bottom, 32) + F.shiftright(b, 16)
    top = c + F.shiftleft(d.bitwiseAND(F.lit(_MASK16)), 16) + (low * F.lit(_MULTIPLIER_HIGH)).bitwiseAND(F.lit(_MASK32)) + carry
    return top.bitwiseAND(F.lit(_MASK32)), bottom.bitwiseAND(F.lit(_MASK32))


def _jumps(state: Column, first: int, last: int, shards: int) -> Column:
    """Fold jumps number ``first`` to ``last`` into a state of (high, low, b, j)."""

    def jump(s: Column, _: Column) -> Column:
        high, low = _advance(s["high"], s["low"])
        span = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double")
        landed = F.floor((s["j"] + F.lit(1)).cast("double") * span).cast("long")
        moved = F.struct(high.alias("high"), low.alias("low"), s["j"].alias("b"), landed.alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, jump)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (int, 0 to ``shards`` - 1) of a long key. Null keys count as 0. Adding a shard
    moves 1 / (shards + 1) of the keys, all into the new shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_MASK32)).alias("low"), (zero - F.lit(1)).alias("b"), zero.alias("j")
    )
    state = _jumps(start, 1, min(shards, _USUAL_JUMPS), shards)
    if shards > _USUAL_JUMPS:
        state = F.when(state["j"] < F.lit(shards), _jumps(state, _USUAL_JUMPS + 1, shards, shards)).otherwise(state)
    return state["b"].cast("int")


def stable_key(column: Column, kind: str) -> Column:
    """A long that stands for any key: integers as they are, others by the first 60 bits of
    SHA-256 of their text, alike on every machine."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return column.cast("long")
    digest = F.sha2(column.cast("string"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """``df`` with ``shard`` and, if named, ``grown`` (the shard with one more). A projection
    without shuffle: texts stay where they are. Null keys share the shard of key 0; equal
    keys share one; columns of the new names (any case) are replaced."""
    taken = {shard.lower(), (grown or shard).lower()} - {key.lower()}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    value = stable_key(F.col(f"`{key}`"), dict(df.dtypes)[key])
    new = [jump_hash(value, shards).alias(shard)]
    if grown:
        new.append(jump_hash(value, shards + 1).alias(grown))
    return df.select(*kept, *new)


def number_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot", buckets: int = 4096) -> DataFrame:
    """Distinct rows of narrow columns in, the same rows with ``slot`` out: 0, 1, 2, ...
    without a gap inside each shard, in an order that depends on the rows alone.

    Equal rows are interchangeable: they are counted (before the shuffle) and given
    consecutive slots. ``buckets`` parts of a shard are ranked apart, so no task and no
    window holds more than 1 / buckets of a shard on average; it bounds the table of
    running sums and has no influence on whether slots are right. Rows of an empty table: none."""
    names = rows.columns
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(buckets)).cast("int")
    counted = rows.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", bucket)
    sizes = rows.select(F.col(f"`{shard}`"), bucket.alias("_bucket")).groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    running = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_bucket", F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*[F.col(f"`{c}`") for c in names])
    ranked = counted.withColumn("_before", F.coalesce(F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(starts, [shard, "_bucket"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - F.lit(1)))
    out = placed.select(*[F.col(f"`{c}`") for c in names], (F.col("_start") + F.col("_before")).alias("_first"), each.alias("_copy"))
    return out.select(*[F.col(f"`{c}`") for c in names], (F.col("_first") + F.col("_copy")).alias(slot))
