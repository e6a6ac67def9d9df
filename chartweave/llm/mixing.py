"""Mixing sources to target weights, in DataFrame functions only.

Targets: sources share the wanted total by weight; a target stops at ``max_epochs`` times
its source's size and the excess is shared anew, which is filling water to one level.

Draw: a source's documents lie in permuted blocks. A source takes whole copies of all its
blocks, then further whole blocks up to its target and, of the block at the border, further
documents in permuted order. So its taken words miss the target by less than a document.

Splitting tree: each source's number of drawn blocks is its exact quota. At every node of a
binary tree over the output shards the quotas are parted between the halves by a
multivariate hypergeometric draw (source by source, each hypergeometric given what is left),
so every shard gets an exact count of every source's blocks, distributed as if all drawn
blocks had been shuffled together. Each shard then takes its own, disjoint run of the
source's permuted blocks, and rows are ordered inside the shard by a hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm._shared import stash, without

#: The table of blocks is broadcast up to this many rows (about 200 bytes each); beyond, it is
#: joined by shuffle.
BROADCAST_ROWS = 100_000
#: Documents of a block, about.
BLOCK_ROWS = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D (long); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) in, with ``weight`` and ``target`` (double) out. Sources in order
    of code points, null last, take the weights in turn. One row per source: this table is
    small by nature, one task holds it. Sources without words have target 0."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % F.lit(len(weights)) + F.lit(1)).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(order) - F.lit(1)).withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    filled = (
        ranked.withColumn("_cap", cap)
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("weight").over(onward))
        .withColumn("_full", F.col("_level") * F.col("weight") >= F.col("_cap"))
        # the water stands at the first source that it does not fill
        .withColumn("_height", F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("weight"), F.col("_rank"), F.col("_level")).alias("x"))).over(everything))
    )
    target = F.when(F.col("_full") | F.col("_height").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_height")["_level"] * F.col("weight")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(units: Column, marked: Column, drawn: Column, chance: Column) -> Column:
    """The number of marked units among ``drawn`` out of ``units``, by inverting the
    distribution at ``chance``. Three folds from the smallest possible count on: largest
    logarithm of the weights, their sum, and the count at which the sum passes ``chance``.
    Logarithms keep large quotas from underflow."""
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - units)
    high = F.least(marked, drawn)
    given = F.struct(units.alias("u"), marked.alias("m"), drawn.alias("d"), low.alias("low"), high.alias("high"), chance.alias("c"))
    zero = F.lit(0.0)

    def solve(g: Column) -> Column:
        steps = F.when(g["high"] > g["low"], F.sequence(g["low"] + F.lit(1), g["high"])).otherwise(F.array().cast("array<bigint>"))

        def ratio(k: Column) -> Column:
            # log of p(k) / p(k - 1)
            up = (g["m"] - k + F.lit(1)) * (g["d"] - k + F.lit(1))
            down = k * (g["u"] - g["m"] - g["d"] + k)
            return F.log(up.cast("double") / down.cast("double"))

        ratios = F.transform(steps, ratio)
        climb = F.aggregate(
            ratios, F.struct(zero.alias("log"), zero.alias("top")), lambda s, r: F.struct((s["log"] + r).alias("log"), F.greatest(s["top"], s["log"] + r).alias("top"))
        )["top"]

        def pick(rt: Column) -> Column:
            top = rt["top"]
            start = F.struct(zero.alias("log"), F.exp(-top).alias("sum"))
            total = F.aggregate(rt["r"], start, lambda s, r: F.struct((s["log"] + r).alias("log"), (s["sum"] + F.exp(s["log"] + r - top)).alias("sum")))["sum"]
            return bind(g["c"] * total, lambda wanted: count_below(rt, wanted))

        def count_below(rt: Column, wanted: Column) -> Column:
            # one count further for every weight before the one in which ``wanted`` falls
            top = rt["top"]
            start = F.struct(zero.alias("log"), F.exp(-top).alias("sum"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                rt["r"],
                start,
                lambda s, r: F.struct(
                    (s["log"] + r).alias("log"), (s["sum"] + F.exp(s["log"] + r - top)).alias("sum"), (s["n"] + (s["sum"] <= wanted).cast("long")).alias("n")
                ),
            )["n"]

        return bind(F.struct(ratios.alias("r"), climb.alias("top")), lambda rt: g["low"] + pick(rt))

    return bind(given, solve)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, quota) in, (source_no, shard, first, count) out: every shard's disjoint run
    of each source's drawn blocks. All shards get the same number of blocks, give or take
    one. ``shards`` must be a power of two; the tree is log2(shards) levels of one row a node."""
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    entry = F.struct(F.col("source_no"), F.col("quota"), F.lit(0).cast("long").alias("first"))
    nodes = quotas.agg(F.array_sort(F.collect_list(entry)).alias("own")).withColumn("node", F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")
    for _ in range(levels):

        def part(acc: Column, x: Column) -> Column:
            chance = _uniform(F.lit(seed), F.col("node"), x["source_no"])
            drawn = hypergeometric(acc["units"], x["quota"], acc["room"], chance)
            return bind(
                drawn,
                lambda take: F.struct((acc["units"] - x["quota"]).alias("units"), (acc["room"] - take).alias("room"), F.concat(acc["take"], F.array(take)).alias("take")),
            )

        units = F.aggregate(F.col("own"), zero, lambda a, x: a + x["quota"])
        room = F.floor((units + F.lit(1)) / F.lit(2)).cast("long")
        start = F.struct(units.alias("units"), room.alias("room"), F.array().cast("array<bigint>").alias("take"))
        nodes = nodes.withColumn("take", F.aggregate(F.col("own"), start, part)["take"])
        left = F.zip_with("own", "take", lambda x, t: F.struct(x["source_no"].alias("source_no"), t.alias("quota"), x["first"].alias("first")))
        right = F.zip_with("own", "take", lambda x, t: F.struct(x["source_no"].alias("source_no"), (x["quota"] - t).alias("quota"), (x["first"] + t).alias("first")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("own")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("own")))
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.node", "h.own")
    runs = nodes.select((F.col("node") - F.lit(shards)).cast("int").alias("shard"), F.explode("own").alias("x"))
    return runs.select("shard", "x.source_no", F.col("x.first").alias("first"), F.col("x.quota").alias("count"))


@dataclass
class Draw:
    """Who takes part (``rows``: doc_id, source, size, _key, _block) and what is drawn
    (``table``: one row a block of a source, with the runs of the shards)."""

    rows: DataFrame
    table: DataFrame
    blocks: int
    seed: int

    def key(self) -> Column:
        """The hash of a row, by its doc_id and text."""
        return F.xxhash64(F.lit(self.seed), F.col("doc_id"), F.col("text"))

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed + 1), key), F.lit(self.blocks)).cast("int")

    def joined(self, rows: DataFrame, source: str = "source", block: str = "_block") -> DataFrame:
        """``rows`` with the columns of their block; by broadcast if the table is small."""
        side = self.table.withColumnsRenamed({"source": "_source", "_block": "_its_block"})
        side = F.broadcast(side) if self.table.count() <= BROADCAST_ROWS else side
        return rows.join(side, F.col(f"`{source}`").eqNullSafe(F.col("_source")) & (F.col(block) == F.col("_its_block"))).drop("_source", "_its_block")

    def shards_of(self, times: Column) -> Column:
        """The output shard of each of a row's copies: copy ``c`` of a block is unit
        c * blocks + place of its source, and every shard has a run of units."""

        def shard_of(copy: Column) -> Column:
            unit = copy * F.col("_blocks") + F.col("_place")
            return F.element_at(F.filter("_runs", lambda r: (unit >= r["first"]) & (unit < r["first"] + r["count"])), 1)["shard"]

        copies = F.when(times > 0, F.sequence(F.lit(0), times - F.lit(1))).otherwise(F.array().cast("array<int>"))
        return F.transform(copies, shard_of)

    def border(self) -> DataFrame:
        """Rows of the border blocks with ``_more``: 1 for those that go in, documents in
        permuted order as far as the rest goes; the last one goes in if that brings the sum
        nearer to the target. They are a prefix in the order of ``_key``."""
        inside = Window.partitionBy("source_no", "_block").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reach = F.col("_before") + F.sum("size").over(inside) - F.col("size") / F.lit(2.0)
        return self.joined(self.rows).where("_border").withColumn("_more", (reach <= F.col("_rest")).cast("long"))


def draw(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int, blocks: int | None, shards: int, seed: int) -> Draw:
    """Sizes, targets, drawn blocks and their shards. ``blocks`` per source: one for about
    ``BLOCK_ROWS`` documents if None, at least 256 and at most 65,536."""
    blocks = blocks or int(min(max(docs.count() // BLOCK_ROWS, 256), 65_536))
    plan = Draw(docs, docs, blocks, seed)
    narrow = docs.select("doc_id", "source", plan.key().alias("_key"), word_count(F.col("text")).alias("size"))
    plan.rows = stash(narrow.withColumn("_block", plan.block(F.col("_key"))), "mix-rows")
    table = _draw_blocks(plan.rows, weights, share, max_epochs, seed)
    drawn = table.groupBy("source_no").agg((F.first("_epochs") * F.first("_blocks") + F.sum((F.col("_whole") | F.col("_border")).cast("long"))).alias("quota"))
    run = F.struct("first", "count", "shard")
    runs = split_quotas(drawn, shards, seed + 3).groupBy("source_no").agg(F.array_sort(F.collect_list(run)).alias("_runs"))
    plan.table = stash(table.join(runs, "source_no"), "mix-blocks")
    return plan


def mix_plan(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, blocks: int | None = None, shards: int = 8, seed: int = 17
) -> DataFrame:
    """The plan of the mix, one row per document: doc_id, source, size, source_size, target,
    ``times`` (int, how often it is taken) and ``shards`` (array<int>, the output shard of
    each copy).

    Null texts and texts without words have size 0; null doc_id and null source are keys
    like any other; of equal rows as many are taken as fit, it does not matter which. The
    same rows give the same plan. An empty table gives no rows. A hot source spreads over
    all its blocks."""
    plan = draw(docs, weights, share, max_epochs, blocks, shards, seed)
    elsewhere = plan.joined(plan.rows).where("NOT _border").withColumn("_more", F.col("_whole").cast("long"))
    taken = elsewhere.unionByName(plan.border()).withColumn("times", (F.col("_epochs") + F.col("_more")).cast("int"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "times", plan.shards_of(F.col("times")).alias("shards"))


def _draw_blocks(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int, seed: int) -> DataFrame:
    """The table of blocks, up to ``blocks`` rows per source: place in the source's
    permutation, words before it, and whether the last, partial round takes it whole or has
    its border in it."""
    sizes = rows.groupBy("source", "_block").agg(F.sum("size").alias("_block_size"))
    totals = sizes.groupBy("source").agg(F.sum("_block_size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    targets = (
        source_targets(totals, weights, share, max_epochs)
        .withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_epochs", epochs)
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .withColumnRenamed("source", "_target_source")
    )
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("_block")), F.col("_block"))
    sums = (
        sizes.withColumn("_place", F.row_number().over(permuted) - F.lit(1))
        .withColumn("_before", F.sum("_block_size").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_block_size"))
        .withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy("source")))
    )
    whole = F.col("_before") + F.col("_block_size") <= F.col("_rest")
    table = sums.join(targets, F.col("source").eqNullSafe(F.col("_target_source"))).drop("_target_source")
    return table.withColumn("_whole", whole).withColumn("_border", (F.col("_before") < F.col("_rest")) & ~whole)


def mix_documents(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, blocks: int | None = None, shards: int = 8, seed: int = 17
) -> DataFrame:
    """The mixed documents: ``docs`` as often as ``mix_plan`` takes them, with ``mix_shard`` and
    ``mix_position`` (order inside the shard, a hash). No shuffle of texts: a row's block tells
    its copies and their shards, and of a border block the last hash that goes in.

    Rows with that very hash (equal doc_id and text) of which only some go in are counted and
    come out that often; their columns must be such that Spark can group by them. Nulls, empty
    and very long texts are as in ``mix_plan``. Columns of any other name are kept, columns
    named like the two new ones (any case) are replaced. An empty table gives no rows."""
    plan = draw(docs, weights, share, max_epochs, blocks, shards, seed)
    border = plan.border()
    last = border.where("_more = 1").groupBy("source_no").agg(F.max("_key").alias("_cut"))
    at_cut = border.join(F.broadcast(last), "source_no").where("_key = _cut").groupBy("source_no", "_cut").agg(F.sum("_more").alias("_fit"), F.count(F.lit(1)).alias("_equal"))
    cuts = stash(at_cut, "mix-cuts")  # one row a source at most
    # the columns of the input may have any name: they travel as one struct
    base = without(docs, "mix_shard", "mix_position")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_row"), F.col("source").alias("_own_source"), plan.key().alias("_key"))
    rows = plan.joined(rows.withColumn("_block", plan.block(F.col("_key"))), "_own_source").join(F.broadcast(cuts), "source_no", "left")
    partly = F.coalesce(F.col("_border") & (F.col("_key") == F.col("_cut")) & (F.col("_fit") < F.col("_equal")), F.lit(False))
    more = F.col("_whole") | (F.col("_border") & F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False)))
    usual = rows.where(~partly).withColumn("times", (F.col("_epochs") + more.cast("long")).cast("int"))
    each = usual.select("_row", "_key", F.posexplode(plan.shards_of(F.col("times"))).alias("_copy", "mix_shard"))
    known = ["source_no", "_key", "_epochs", "_fit", "_blocks", "_place", "_runs"]
    equal = rows.where(partly).groupBy("_row", *known).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("source_no").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.least(F.col("_fit") - F.coalesce(F.sum("_rows").over(before), F.lit(0)), F.col("_rows")), F.lit(0).cast("long"))
    equal = equal.withColumn("_room", room).withColumn("_shards", plan.shards_of((F.col("_epochs") + F.lit(1)).cast("int")))
    copies = equal.select("*", F.posexplode("_shards").alias("_copy", "mix_shard"))
    often = F.when(F.col("_copy") < F.col("_epochs"), F.col("_rows")).otherwise(F.col("_room")).cast("int")
    repeated = copies.select("_row", "_key", "_copy", "mix_shard", F.explode(F.array_repeat(F.lit(0), often)))
    out = each.unionByName(repeated.drop("col"))
    position = F.xxhash64(F.lit(seed + 4), F.col("mix_shard"), F.col("_key"), F.col("_copy"))
    return out.select("_row.*", "mix_shard", position.alias("mix_position"))
