"""Exact top-k retrieval with staged filters, as joins of tiles.

Which filter holds for a query is a set of fields, a mask; points and queries meet by equality
of (mask, values of its fields). Inside a filter only those tiles of points are scored that
the triangle inequality leaves over: vectors are put next to their nearest pivot, a tile keeps
the least and the largest distance of its members to it, and so the distance of a tile of
queries to a tile of points lies between two bounds. Tiles that begin behind the distance
within which k points are certain are dropped, and no answer is lost.

Vectors are sorted by filter and pivot before tiles are cut, so that tiles are full and their
number grows with the table alone; a block of tiles meets a block of tiles in one task, so that
a vector travels once for each block it meets, not once for each tile.

Vectors are never collected: pivots come from a bounded sample, tiles are rows of a table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.sources.scratch import stash

FIELDS = ("doc_type", "syndrome", "diagnosis_class", "section")
#: Rows of a tile, and rows of a part that tiles are cut from.
TILE_ROWS, HELD_ROWS = 1024, 32_768
#: Vectors that pivots are chosen from, points per pivot, and pivots at most.
SAMPLE, POINTS_PER_PIVOT, PIVOTS = 2000, 2048, 64
#: Tiles of points and tiles of queries in a block.
SLICE, ASKED_SLICE = 32, 8
#: Tiles of points that are scored at once.
AT_ONCE = 4
#: What rounding may add to a bound, and to a score.
_SLACK, _ROUNDING = 1e-6, 2e-12


def fallback_levels(queries: DataFrame) -> DataFrame:
    """(query_id, level, fields): the filters to try in turn. All fields; type and class; only
    without a class: type alone, then nothing. Of equal filters the first level stays."""
    q = queries.withColumns({f: F.nullif(F.col(f), F.lit("")) for f in FIELDS})
    none = F.lit(None).cast("string")
    make = lambda level, on, *cols: F.when(on, F.struct(F.lit(level).alias("level"), *[c.alias(f) for f, c in zip(FIELDS, cols)]))
    free = F.col("diagnosis_class").isNull()
    every = F.lit(True)
    tries = F.array(
        make(0, every, *[F.col(f) for f in FIELDS]),
        make(1, every, F.col("doc_type"), none, F.col("diagnosis_class"), none),
        make(2, free, F.col("doc_type"), none, none, none),
        make(3, free, none, none, none, none),
    )
    rows = q.select("query_id", F.explode(F.array_compact(tries)).alias("t")).select("query_id", "t.*")
    first = Window.partitionBy("query_id", *FIELDS).orderBy("level")
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


KEYS = ("mask", *(f"k_{f}" for f in FIELDS))


def _keys(mask: Column) -> list[Column]:
    """The mask and the values of its fields; a field outside it counts as equal for all, and a
    null inside it meets nothing."""
    return [mask.alias("mask"), *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.col(f)).otherwise(F.lit("")).alias(f"k_{f}") for i, f in enumerate(FIELDS)]]


def filter_mask() -> Column:
    """Bit i is set where field i of a filter is."""
    bits = [F.when(F.col(f).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FIELDS)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _masked(rows: DataFrame, masks: list[int], *kept: str) -> DataFrame:
    """A row for every mask in use (at most 16), with its keys."""
    each = rows.select(*FIELDS, *kept, F.explode(F.array(*[F.lit(m) for m in masks])).alias("_mask"))
    return each.select(*kept, *_keys(F.col("_mask")))


def _masks(filters: DataFrame) -> dict[int, int]:
    """The masks in use and how many rows have them."""
    rows = filters.groupBy(filter_mask().alias("m")).count().collect()
    return {r["m"]: r["count"] for r in sorted(rows, key=lambda r: r["m"])}


def chosen_level(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Each query's first level that any point passes: levels meet the facets (distinct values
    of the fields) under their mask by equality, never the points."""
    levels = fallback_levels(queries)
    if not (masks := _masks(levels)):
        return levels.limit(0)
    facets = _masked(points.select(*FIELDS).distinct(), list(masks)).distinct()
    met = levels.select("*", *_keys(filter_mask())).join(facets, list(KEYS))
    least = F.min_by(F.struct("level", *FIELDS), F.col("level")).alias("t")
    return met.groupBy("query_id").agg(least).select("query_id", "t.*")


def sound(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, every component a finite number."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))


def _spread(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` rows far from one another: each next one is the farthest from those before."""
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(k, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def pivots_of(points: DataFrame, rows: int) -> np.ndarray:
    """Unit vectors that tiles are built around, from a sample chosen by a hash of the ids."""
    order = F.xxhash64(F.lit(3), "point_id")
    sample = points.select("point_id", "embedding").orderBy(order, "point_id").limit(SAMPLE).collect()
    if not sample:
        return np.zeros((0, 0))
    return _spread(_unit(np.array([r["embedding"] for r in sample], float)), max(1, min(PIVOTS, math.ceil(rows / POINTS_PER_PIVOT))))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _met() -> Column:
    """Rows whose keys can meet any: none of them is null."""
    return F.forall(F.array(*[F.col(k) for k in KEYS[1:]]), lambda x: x.isNotNull())


def pivots_in_use(points: DataFrame, masks: list[int]) -> dict[int, tuple[int, int]]:
    """For each mask, how many pivots its points are put next to, so that a filter of average
    size has ``POINTS_PER_PIVOT`` for each, and how many points have all of its fields. Facets
    are counted, points are not copied."""
    facets = _masked(points.groupBy(*FIELDS).count(), masks, "count").where(_met())
    found = facets.groupBy(*KEYS).agg(F.sum("count").alias("n")).groupBy("mask").agg(F.count(F.lit(1)).alias("filters"), F.sum("n").alias("rows")).collect()
    return {r["mask"]: (max(1, min(PIVOTS, math.ceil(r["rows"] / r["filters"] / POINTS_PER_PIVOT))), r["rows"]) for r in found}


def tiles_of(rows: DataFrame, name: str, pivots: np.ndarray, used: dict[int, int], total: int, block: int) -> DataFrame:
    """Tiles of ``rows`` (``name``, ``embedding``, the keys): at most ``TILE_ROWS`` vectors of
    equal keys next to one of the first ``used`` pivots of their mask, with ``near`` and ``far``,
    their distances to it, and ``apart``, the pivot's distances to all pivots; ``block`` tiles
    that follow each other make a block. Rows are sorted by keys and pivot in parts of about
    ``HELD_ROWS``; equal ones may fall into several parts. Zero vectors make tiles whose bounds
    exclude nothing."""
    width = pivots.shape[1]
    apart = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
    order = [*KEYS, "pivot"]
    keys = [T.StructField("mask", T.IntegerType()), *[T.StructField(k, T.StringType()) for k in KEYS[1:]]]
    own = T.StructField(name, rows.schema[name].dataType)
    near = T.StructType([own, *keys, T.StructField("pivot", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("unit", T.BinaryType())])
    schema = T.StructType([
        T.StructField("tile", T.StringType()), T.StructField("block", T.StringType()), *keys, T.StructField("pivot", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("near", T.DoubleType()), T.StructField("far", T.DoubleType()),
        T.StructField("apart", T.ArrayType(T.DoubleType())), T.StructField("ids", T.ArrayType(own.dataType)), T.StructField("matrix", T.BinaryType()),
    ])
    near_arrow, arrow = (pa.schema([(f.name, _arrow(f.dataType)) for f in kind.fields]) for kind in (near, schema))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_numbers(batch.column("embedding"), width))
            zero = ~x.any(axis=1)
            gap = np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))
            most = np.array([used.get(m, 1) for m in batch.column("mask").to_pylist()], np.int64)
            gap[np.arange(len(pivots)) >= most[:, None]] = np.inf
            pivot, distance = np.where(zero, -1, gap.argmin(axis=1)), np.where(zero, 0.0, gap.min(axis=1))
            whole = [batch.column(c) for c in (name, *KEYS)]
            yield pa.RecordBatch.from_arrays([*whole, pa.array(pivot, pa.int32()), pa.array(distance), pa.array([v.tobytes() for v in x], pa.binary())], schema=near_arrow)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        now, held = None, []

        def close() -> pa.RecordBatch:
            nonlocal held, made
            ids, far, units = zip(*held, strict=True)
            row = [f"{task}-{made}", f"{task}-{made // block}", *now, len(ids), min(far), max(far), apart[now[-1]].tolist() if now[-1] >= 0 else [], list(ids), b"".join(units)]
            held, made = [], made + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            keyed = zip(*[batch.column(c).to_pylist() for c in order], strict=True)
            for key, *row in zip(keyed, *[batch.column(c).to_pylist() for c in (name, "distance", "unit")], strict=True):
                if held and (key != now or len(held) == TILE_ROWS):
                    yield close()
                now = key
                held.append(row)
        if held:
            yield close()

    placed = rows.select(name, *KEYS, "embedding").mapInArrow(place, near)
    parts = max(1, math.ceil(total / HELD_ROWS))
    return placed.repartitionByRange(parts, *order, F.xxhash64(name)).sortWithinPartitions(*order).mapInArrow(cut, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[kind.typeName()]


def tile_pairs(asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(asked, stored, their blocks, n_asked, n_stored, kept) for all pairs of tiles that the filters bring
    together; ``kept`` where members can be among the k nearest. Narrow rows only."""
    a = asked.select(F.col("tile").alias("asked"), F.col("block").alias("a_block"), F.col("n").alias("n_asked"), F.col("far").alias("_reach"), "apart", *KEYS)
    s = stored.select(F.col("tile").alias("stored"), F.col("block").alias("s_block"), F.col("n").alias("n_stored"), "near", "far", "pivot", *KEYS)
    met = a.join(s, list(KEYS))
    free = (F.size("apart") == 0) | (F.col("pivot") < 0)
    gap = F.element_at("apart", F.greatest(F.col("pivot"), F.lit(0)) + 1)
    least = F.when(free, 0.0).otherwise(F.greatest(gap - F.col("_reach") - F.col("far"), F.col("near") - gap - F.col("_reach"), F.lit(0.0)))
    most = F.when(free, 2.0).otherwise(gap + F.col("_reach") + F.col("far"))
    bounds = met.select("asked", "stored", "a_block", "s_block", "n_asked", "n_stored", least.alias("least"), most.alias("most"))
    near = Window.partitionBy("asked").orderBy("most", "stored").rowsBetween(Window.unboundedPreceding, 0)
    reached = bounds.withColumn("_certain", F.sum("n_stored").over(near) >= k)
    enough = F.min(F.when(F.col("_certain"), F.col("most"))).over(Window.partitionBy("asked"))
    return reached.withColumn("_within", enough).select("asked", "stored", "a_block", "s_block", "n_asked", "n_stored", (F.col("_within").isNull() | (F.col("least") <= F.col("_within") + _SLACK)).alias("kept"))


def _best(width: int, k: int, arrow: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores the tiles of a block of queries against those of a block of points that their
    bounds leave over, and keeps the k best of each query. Behind the first tiles only scores
    that reach a query's k-th so far are looked at."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {c: right.column(c).combine_chunks() for c in ("stored", "ids", "matrix")}
        ids = {name: np.array(columns["ids"][r].values.to_pylist()) for r, name in enumerate(columns["stored"].to_pylist())}
        vectors = {name: np.frombuffer(columns["matrix"][r].as_buffer(), float).reshape(-1, width) for r, name in enumerate(columns["stored"].to_pylist())}
        out = []
        asked = {c: left.column(c).combine_chunks() for c in ("queries", "q_matrix", "wanted")}
        for r in range(left.num_rows):
            q, wanted = np.frombuffer(asked["q_matrix"][r].as_buffer(), float).reshape(-1, width), sorted(asked["wanted"][r].as_py())
            rows, best, scores, bar = np.zeros(0, np.int64), None, np.zeros(0), np.full(len(q), -np.inf)
            for at in range(0, len(wanted), AT_ONCE):
                some = wanted[at : at + AT_ONCE]
                own, score = np.concatenate([ids[t] for t in some]), q @ np.concatenate([vectors[t] for t in some]).T
                if not at and score.shape[1] > k:
                    bar = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                row, col = np.nonzero(score >= bar[:, None] - _ROUNDING)
                rows = np.r_[rows, row]
                best = own[col] if best is None else np.concatenate([best, own[col]])
                scores = np.r_[scores, np.round(score[row, col], 12)]
                order = np.lexsort((best, -scores, rows))
                rows, best, scores = rows[order], best[order], scores[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(q)))[rows]
                bar[rows[place == k - 1]] = scores[place == k - 1]
                rows, best, scores = rows[place < k], best[place < k], scores[place < k]
            out.append(pa.Table.from_arrays([asked["queries"][r].values.take(pa.array(rows)), pa.array(best, arrow.field("point_id").type), pa.array(scores)], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    return run


def _usual_width(points: DataFrame) -> tuple[int, int]:
    """The most frequent length of vectors (of equal ones the larger) and how many have it."""
    found = points.groupBy(F.size("embedding").alias("w")).count().orderBy(F.col("count").desc(), F.col("w").desc()).first()
    return (found["w"], found["count"]) if found else (0, 0)


def plan_search(queries: DataFrame, points: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """Tiles of the queries, tiles of the points and their pairs, each a written table, and the
    length of the vectors; null if nothing can meet."""
    queries, points = queries.where(sound(F.col("embedding"))), points.where(sound(F.col("embedding")))
    width, rows = _usual_width(points)
    if not width:
        return None
    queries, points = queries.where(F.size("embedding") == width), points.where(F.size("embedding") == width)
    masks = _masks(queries)
    in_use = pivots_in_use(points, list(masks)) if masks else {}
    if not in_use:
        return None
    pivots, used = pivots_of(points, rows), {m: n for m, (n, _) in in_use.items()}
    asked = tiles_of(queries.select("query_id", "embedding", *_keys(filter_mask())), "query_id", pivots, used, sum(masks.values()), ASKED_SLICE)
    stored = tiles_of(_masked(points, list(in_use), "point_id", "embedding").where(_met()), "point_id", pivots, used, sum(n for _, n in in_use.values()), SLICE)
    asked, stored = stash(asked, "asked"), stash(stored, "stored")
    return asked, stored, stash(tile_pairs(asked, stored, k), "pairs"), width


def scored_share(pairs: DataFrame) -> DataFrame:
    """Pairs of a query and a point that pass its filter, those scored, and their share."""
    each = (F.col("n_asked").cast("long") * F.col("n_stored")).alias("n")
    sums = pairs.select("kept", each).agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("kept"), F.col("n"))).alias("scored"))
    return sums.select("pairs", "scored", (F.col("scored") / F.col("pairs")).alias("share"))


def cosine_top_k(queries: DataFrame, points: DataFrame, k: int = 7) -> DataFrame:
    """(query_id, rank, point_id, score): exact cosine top-k of each query over the points that
    pass its filter fields (null: any). Scores are rounded to 12 decimals, ties go to the
    smaller point_id; a zero vector scores 0 with all. Vectors that are null, empty, hold a
    null or what is no finite number, or have another length than most points take no part;
    nor do rows without an id. Empty tables give no rows."""
    kinds = {n: df.schema[n].dataType for n, df in (("query_id", queries), ("point_id", points))}
    schema = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("point_id", kinds["point_id"]), T.StructField("score", T.DoubleType())])
    planned = plan_search(queries.where("query_id IS NOT NULL"), points.where("point_id IS NOT NULL"), k)
    if planned is None:
        none = queries.sparkSession.createDataFrame([], schema)
        return none.select("query_id", F.lit(1).alias("rank"), "point_id", "score")
    asked, stored, pairs, width = planned
    kept, blocks = pairs.where("kept"), ["a_block", "s_block"]
    left = kept.groupBy("asked", *blocks).agg(F.collect_list("stored").alias("wanted")).join(asked.select(F.col("tile").alias("asked"), F.col("ids").alias("queries"), F.col("matrix").alias("q_matrix")), "asked")
    right = kept.select("stored", F.col("a_block").alias("with_a"), F.col("s_block").alias("with_s")).distinct().join(stored.select(F.col("tile").alias("stored"), "ids", "matrix"), "stored")
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])
    found = left.groupBy(*blocks).cogroup(right.groupBy("with_a", "with_s")).applyInArrow(_best(width, k, arrow), schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "point_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "point_id", "score")


def retrieve_with_fallback(queries: DataFrame, points: DataFrame, k: int = 7) -> DataFrame:
    """Top-k at each query's first level that is not empty; levels never mix."""
    level = stash(chosen_level(queries, points), "levels")
    ready = queries.select("query_id", "embedding").join(level, "query_id")
    return cosine_top_k(ready, points, k).join(level.select("query_id", "level"), "query_id")
