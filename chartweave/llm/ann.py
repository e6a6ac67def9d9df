"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample with a penalty on size, so lists are balanced. Every
vector is written to the list of its nearest centroid and, if it lies near a border, to
further lists whose distance is within a ratio of the nearest. A query is held against all
centroids (a bounded table) and searches the lists whose distance is within a ratio of the
nearest one. The ratio is fitted on a bounded number of the queries themselves, whose true
neighbours among all rows are found by brute force: the smallest one at which a wanted share of
those neighbours stands in searched lists. Largest inner product becomes smallest distance by
one more coordinate, which lifts all vectors to the same norm; queries, whose length ranks
nothing, are brought to that norm. The few longest vectors, near to every query that points
their way, stand in a list of their own that all queries search.

Lists are cut into parts of bounded size and dealt into groups; a task gets one group of
parts and the queries that need it, multiplies them in blocks and keeps each query's best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm._shared import stash


@dataclass
class Settings:
    """Sample rows the centroids are fitted on, at most; lists, at most; rows of a group.
    ``replica_ratio`` and ``replicas`` rule the copies of border vectors, ``search_ratio`` the
    lists of a query; None: fitted so that ``recall`` of the neighbours of ``probes`` queries
    are found. ``query_rows`` queries meet a group at once. Of ``head_share`` rows the first, at
    most ``head_rows`` of them, stand in the list of the longest vectors. ``neighbours`` is not
    used any more: no graph of centroids is walked."""

    sample_rows: int = 20_000
    lists: int = 4096
    list_rows: int = 400
    group_rows: int = 40_000
    part_rows: int = 4000
    replicas: int = 4
    replica_ratio: float = 1.10
    search_ratio: float | None = None
    recall: float = 0.96
    probes: int = 400
    query_rows: int = 20_000
    neighbours: int = 24
    head_share: int = 64
    head_rows: int = 2048


@dataclass
class Centroids:
    """Centroids in the lifted space, and the norm that vectors are lifted to."""

    points: np.ndarray
    top_norm: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that brings all to the largest norm."""
        gap = np.maximum(self.top_norm**2 - (x * x).sum(axis=1), 0)
        return np.concatenate([x, np.sqrt(gap)[:, None]], axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] - 2 * x @ self.points.T + (self.points * self.points).sum(axis=1)
        return np.sqrt(np.maximum(d, 0))

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries (rows, lifted by a coordinate 0) brought to the largest norm."""
        return q * (self.top_norm / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))

    def walk(self, q: np.ndarray, ratio: float) -> list[int]:
        """Centroids within ``ratio`` times the distance of the nearest to a query, nearest first."""
        d = self.distances(self.aim(q[None]))[0]
        return [int(c) for c in d.argsort(kind="stable") if d[c] <= max(d.min(), 1e-12) * ratio]

    def lists_of(self, x: np.ndarray, replicas: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists of the postings of vectors ``x``."""
        d = self.distances(self.lift(x))
        near = np.argpartition(d, replicas - 1, axis=1)[:, :replicas] if replicas < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        dist = np.take_along_axis(d, near, axis=1)
        r, c = np.nonzero(dist <= np.maximum(dist.min(axis=1, keepdims=True), 1e-9) * ratio)
        return r, near[r, c]

    def fitted_ratio(self, sample: np.ndarray, s: Settings, k: int) -> float:
        """The smallest search ratio that finds ``recall`` of the sample's own neighbours of up
        to ``probes`` of its rows: what ``ratio_for`` gives for rows held in memory."""
        probes = sample[:: max(1, len(sample) // s.probes)]
        replicas, pairs = min(s.replicas, len(self.points)), []
        owners: list[list[int]] = [[] for _ in sample]
        for at in range(0, len(sample), 2048):
            r, c = self.lists_of(sample[at : at + 2048], replicas, s.replica_ratio)
            for row, list_no in zip((r + at).tolist(), c.tolist()):
                owners[row].append(list_no)
        for i, q in enumerate(probes):
            scores = sample @ q
            scores[i * max(1, len(sample) // s.probes)] = -np.inf
            found = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
            pairs += [(i, owners[j]) for j in found if np.isfinite(scores[j])]
        return self.ratio_for(probes, pairs, s.recall)

    def ratio_for(self, probes: np.ndarray, pairs: list[tuple[int, list[int]]], recall: float) -> float:
        """The smallest search ratio at which a share ``recall`` of ``pairs`` (row of ``probes``,
        lists that hold one of its neighbours; none: searched in any case) is found."""
        d = self.distances(self.aim(np.pad(probes, ((0, 0), (0, 1)))))
        best = np.maximum(d.min(axis=1), 1e-12)
        needed = [max(d[i, lists].min() / best[i], 1.0) if len(lists) else 1.0 for i, lists in pairs]
        return float(np.quantile(needed, recall, method="higher")) * (1 + 1e-9) if needed else 1.0

    def widen(self, q: np.ndarray, chosen: list[int], sizes: np.ndarray, enough: int) -> list[int]:
        """``chosen`` and the next nearest lists, until they hold ``enough`` rows or are all."""
        order = ((self.points - q) ** 2).sum(axis=1).argsort(kind="stable")
        rest = order[~np.isin(order, chosen)]
        held = sizes[chosen].sum() + sizes[rest].cumsum()
        return [*chosen, *rest[: int(np.searchsorted(held, enough)) + 1].tolist()]


def fit_centroids(sample: np.ndarray, lists: int, top_norm: float, _neighbours: int = 0, rounds: int = 8) -> Centroids:
    """Balanced k-means: a cluster's distance grows with its size beyond the mean."""
    holder = Centroids(np.zeros((0, 0)), top_norm)
    x = holder.lift(sample)
    rng = np.random.default_rng(7)
    k = max(1, min(lists, len(x)))
    points = x[rng.choice(len(x), k, replace=False)].copy() if len(x) else np.zeros((1, 1))
    penalty = np.zeros(k)
    for _ in range(rounds if len(x) else 0):
        owner = np.empty(len(x), int)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            owner[at : at + 4096] = ((points * points).sum(axis=1) - 2 * part @ points.T + penalty).argmin(axis=1)
        size = np.bincount(owner, minlength=k)
        sums = np.zeros_like(points)
        np.add.at(sums, owner, x)
        points[size > 0] = sums[size > 0] / size[size > 0, None]
        penalty += 0.02 * (size * k / len(x) - 1)
    return Centroids(points, top_norm)


def true_neighbours(rows: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int) -> DataFrame:
    """(probe, vec_id): the ``k`` rows of largest inner product with each of a bounded number of
    ``probes`` (their own row, of ``ids``, left out), by brute force: one pass over ``rows``."""
    known = rows.sparkSession.sparkContext.broadcast((ids, probes))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = known.value
        best_id, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for f in frames:
            for at in range(0, len(f), 2048):
                part = f.iloc[at : at + 2048]
                some = part["vec_id"].to_numpy()
                score = q @ np.stack(part["v"].to_numpy()).T
                score[own[:, None] == some[None, :]] = -np.inf
                score, some = np.concatenate([best, score], axis=1), np.concatenate([best_id, np.tile(some, (len(q), 1))], axis=1)
                keep = np.argpartition(-score, k - 1, axis=1)[:, :k] if score.shape[1] > k else np.tile(np.arange(score.shape[1]), (len(q), 1))
                best, best_id = np.take_along_axis(score, keep, axis=1), np.take_along_axis(some, keep, axis=1)
        probe, at = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"probe": probe, "vec_id": best_id[probe, at], "score": best[probe, at]})

    order = Window.partitionBy("probe").orderBy(F.col("score").desc(), "vec_id")
    found = rows.select("vec_id", "v").mapInPandas(run, "probe int, vec_id long, score double")
    return found.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k).select("probe", "vec_id")


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of vectors that take part: not null, not zero, all components finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = F.exists(v, lambda c: c != F.lit(0.0))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine & some, F.lit(False)))


def nearest(vectors: DataFrame, is_query, k: int = 20, vector: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` (a Column over
    vec_id) holds the ``k`` other rows of largest inner product that the lists hold.

    Scores are sums of products in double precision on the vectors as they are. Ties go to
    the smaller vec_id, so among any number of equal vectors the first ones are found. A
    query gets ``k`` rows, or all others if there are fewer: where the lists near it hold too
    few, further lists are searched.
    Vectors that are null, zero or have null or non-finite components take no part, nor do
    those of another length than most (of equally frequent lengths the smallest rules). Rows
    that repeat a vec_id count once (the smallest vector). An empty table and a single row give
    no rows. The centroids are fitted on the driver, on ``sample_rows`` vectors at most; the
    search ratio on ``probes`` queries at most, against all rows."""
    s = settings or Settings()
    spark = vectors.sparkSession
    rows = stash(usable(vectors, vector).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    rows = rows.where(F.size("v") == F.lit(length["n"] if length else 0))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    # vectors longer than ``bar`` are in the list that all queries search; the others are lifted to it
    longest = rows.select(norm.alias("_norm")).orderBy(F.col("_norm").desc()).limit(max(1, min(s.head_rows, total // s.head_share)))
    bar = longest.agg(F.min("_norm")).first()[0]
    # a bounded sample by hash of the id; every row is indexed
    share = min(1.0, s.sample_rows / total)
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).limit(2 * s.sample_rows).toArrow().sort_by("vec_id")["v"].combine_chunks()
    sample = picked.flatten().to_numpy().reshape(len(picked), -1) if len(picked) else np.array([rows.first()["v"]])
    lists = int(np.clip(total // s.list_rows, 1, s.lists))
    usual = sample[(sample * sample).sum(axis=1) <= bar * (1 + 1e-9)]
    index = fit_centroids(usual if len(usual) else sample, lists, float(np.sqrt(bar)) * (1 + 1e-12))
    lists = len(index.points)
    known = spark.sparkContext.broadcast(index)
    replicas, ratio = min(s.replicas, lists), s.replica_ratio

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 2048):
                part = f.iloc[at : at + 2048]
                x = np.stack(part["v"].to_numpy())
                r, c = known.value.lists_of(x, replicas, ratio)
                head = part["_head"].to_numpy()
                r, c = np.r_[r[~head[r]], np.flatnonzero(head)], np.r_[c[~head[r]], np.full(int(head.sum()), lists)]
                yield pd.DataFrame({"list": c, "vec_id": part["vec_id"].to_numpy()[r], "v": part["v"].to_numpy()[r]})

    marked = rows.withColumn("_head", norm > F.lit(bar))
    postings = stash(marked.mapInPandas(post, "list int, vec_id long, v array<double>"), "ann-postings")
    queries = rows.where(is_query)
    search_ratio = s.search_ratio
    if search_ratio is None:
        probes = queries.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(s.probes).toArrow()
        if not len(probes):
            return spark.createDataFrame([], schema)
        aims = probes["v"].combine_chunks().flatten().to_numpy().reshape(len(probes), -1)
        held_in = postings.where(F.col("list") < lists).select("vec_id", "list")
        near = true_neighbours(rows, probes["vec_id"].to_numpy(), aims, k).join(held_in, "vec_id", "left")
        lists_in = near.groupBy("probe", "vec_id").agg(F.collect_list("list").alias("lists")).toArrow()  # k rows a probe
        search_ratio = index.ratio_for(aims, list(zip(lists_in["probe"].to_pylist(), lists_in["lists"].to_pylist())), s.recall)
    sizes = postings.groupBy("list").count().toArrow().to_pandas()  # one row a list
    held = int(sizes["count"].sum())
    part_rows = max(s.part_rows, held // 65_536)
    parts = dict(zip(sizes["list"].tolist(), (-(-sizes["count"] // part_rows)).tolist()))
    groups = max(1, -(-held // s.group_rows))
    # parts are dealt to the groups by size, largest first: groups are balanced
    load = [(0, g) for g in range(groups)]
    group_of: dict[tuple[int, int], int] = {}
    for list_no, count in sorted(zip(sizes["list"].tolist(), sizes["count"].tolist()), key=lambda x: (-x[1] // parts[x[0]], x[0])):
        for part in range(parts[list_no]):
            have, g = heapq.heappop(load)
            group_of[list_no, part] = g
            heapq.heappush(load, (have + count // parts[list_no], g))
    table = spark.createDataFrame([(a, b, g, parts[a]) for (a, b), g in group_of.items()], "list int, part int, grp int, parts int")
    own = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    split = postings.join(F.broadcast(table.select("list", "parts").distinct()), "list").withColumn("part", own)
    dealt = split.join(F.broadcast(table.select("list", "part", "grp")), ["list", "part"]).select("grp", "list", "vec_id", "v")
    groups_of: dict[int, list[int]] = {}
    for (list_no, _), g in group_of.items():
        groups_of.setdefault(list_no, []).append(g)
    shared = spark.sparkContext.broadcast(groups_of)
    list_sizes = np.zeros(lists + 1, np.int64)
    list_sizes[sizes["list"].to_numpy()] = sizes["count"].to_numpy()
    enough = (k + 1) * max(replicas, 1)  # rows among which are k other vectors, whatever the copies

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = {"grp": [], "vec_id": [], "v": [], "lists": []}
            for at in range(0, len(f), 512):
                part = f.iloc[at : at + 512]
                q = known.value.aim(np.pad(np.stack(part["v"].to_numpy()), ((0, 0), (0, 1))))
                d = known.value.distances(q)
                within = d <= np.maximum(d.min(axis=1, keepdims=True), 1e-12) * search_ratio
                for i, (vec_id, v) in enumerate(zip(part["vec_id"], part["v"])):
                    wanted: dict[int, list[int]] = {}
                    chosen = [*np.flatnonzero(within[i]).tolist(), lists]
                    if list_sizes[chosen].sum() < enough:
                        chosen = known.value.widen(q[i], chosen, list_sizes, enough)
                    for c in chosen:
                        for g in set(shared.value.get(c, ())):
                            wanted.setdefault(g, []).append(c)
                    for g, own_lists in wanted.items():
                        out["grp"].append(g), out["vec_id"].append(vec_id), out["v"].append(v), out["lists"].append(own_lists)
            yield pd.DataFrame(out)

    asked = stash(queries.mapInPandas(ask, "grp int, vec_id long, v array<double>, lists array<int>"), "ann-asked")
    # a group meets its own queries block by block: its vectors are sent once for each
    # ``query_rows`` queries that search it, and not at all where none does
    blocks = asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(s.query_rows)).cast("int").alias("_blocks"))
    asked = asked.join(F.broadcast(blocks), "grp").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    dealt = dealt.join(F.broadcast(blocks), "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")

    def search(key: tuple, held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids, found_q, found_v, found_s = held["vec_id"].to_numpy(), [], [], []
        order = np.lexsort((ids, held["list"].to_numpy()))
        list_no, ids = held["list"].to_numpy()[order], ids[order]
        x = np.stack(held["v"].to_numpy()[order]) if len(held) else np.zeros((0, 1))
        q_ids = queries["vec_id"].to_numpy()
        q = np.stack(queries["v"].to_numpy()) if len(queries) else np.zeros((0, 1))
        wants = np.zeros((len(q), lists + 1), bool)
        for i, own_lists in enumerate(queries["lists"]):
            wants[i, own_lists] = True
        for at in range(0, len(q) if len(x) else 0, 128):
            product = q[at : at + 128] @ x.T
            product[~wants[at : at + 128][:, list_no]] = -np.inf
            product[q_ids[at : at + 128, None] == ids[None, :]] = -np.inf
            for i, scores in enumerate(product):
                # a vector may stand in several lists of the group
                room = min(len(scores), (k + 1) * max(replicas, 1))
                floor = np.partition(scores, len(scores) - room)[len(scores) - room]
                near = np.flatnonzero((scores >= floor - 1e-9) & np.isfinite(scores))
                near_ids, first = np.unique(ids[near], return_index=True)
                value = (x[near[first]] * q[at + i]).cumsum(axis=1)[:, -1] if len(near) else np.zeros(0)
                best = np.lexsort((near_ids, -value))[:k]
                found_q.append(np.full(len(best), q_ids[at + i])), found_v.append(near_ids[best]), found_s.append(value[best])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pd.DataFrame({"query_id": join(found_q, np.int64), "vec_id": join(found_v, np.int64), "score": join(found_s, float)})

    met = dealt.groupBy("grp", "block").cogroup(asked.groupBy("grp", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
