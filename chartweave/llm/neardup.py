"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct five-word shingles. Two small collections, of
``bands`` minhash tuples each, are computed; the table keys are all pairs of a tuple of the
left and one of the right collection. So ``bands``**2 tables need 2 * bands * rows minhashes
only. Two documents of similarity s share a table with probability
(1 - (1 - s**rows)**bands)**2: 0.9999 at 0.75 with the defaults, more above.

Documents with the same set are one node from the start. Tables hold ids only: keys that one
node alone has are dropped, and of buckets with the same members, which near copies have in
most of their tables, one is kept. The buckets left meet one-permutation sketches (512 bins) of
large sets and the 32-bit digests of small ones. Pairs that cannot be told to be below the
threshold come out once, in the first table they share; pairs whose link is already certain
through other pairs of the bucket do not: of each pair of groups one that a sketch or the
digests take for certain comes out. Every pair that comes out is confirmed on
full sets; where a link that a sketch took for certain fails, the nodes tied by it are compared
once more, and then only confirmed links keep pairs from coming out. In oversize buckets all
members are first compared with one of them on full sets; those linked to it need not meet each
other, the others meet them and each other in cells of bounded size, so a hot bucket is many
small ones and every pair of it still meets. Classes are the connected components of the
confirmed links, found by alternating star operations on the links as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.llm._shared import LOWER, drop, join_unique, mix, span_hashes, stash, steps, text_bytes, word_spans

SHINGLE = 5
BINS = 512
#: Members up to which a set travels to its buckets as a whole, in 32-bit digests.
SMALL = 256
#: Standard errors that a sketch's estimate must lie below the threshold to rule a link out:
#: a pair exactly at the threshold is missed with a chance of 2e-4, like that of the tables.
CERTAINTY = 3.5
#: Rows of a bucket above which it is dealt into cells of about so many rows.
SPLIT_BUCKET = 3000
#: Rows of keys, ids and counts that are broadcast at most (some 40 bytes each).
FEW_ROWS = 1_000_000
#: Low bits of a table key that hold the number of the table; up to 16 bands.
TABLE_BITS = 8
#: Sets of a round's hubs that are broadcast at most; beyond, join by shuffle.
BROADCAST_SETS = 1000
#: Ids of one column are broadcast up to this many (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 500_000
_rng = np.random.Generator(np.random.PCG64(977))
_MULTIPLIERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_SALTS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted 64-bit digests of its distinct shingles: runs of ``shingle``
    words, or all words if there are fewer; without words none."""
    every, offsets = text_bytes(column)
    for low, high in steps(offsets):
        data = LOWER[every[offsets[low] : offsets[high]]]
        own = offsets[low : high + 1] - offsets[low]
        starts, ends, first = word_spans(data, own)
        words = span_hashes(data, starts, ends)
        with np.errstate(over="ignore"):
            n = max(len(words) - shingle + 1, 0)
            run = np.zeros(n, np.uint64)
            for k in range(shingle):
                run += mix(words[k : k + n] + _WORD_SALTS[k])
                run = run * np.uint64(0x9E3779B97F4A7C15)
            run = mix(run)
            for i in range(high - low):
                a, b = first[i], first[i + 1]
                if b - a >= shingle:
                    yield np.unique(run[a : b - shingle + 1])
                elif b > a:
                    h = np.uint64(b - a)
                    for w in words[a:b]:
                        h = mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
                    yield np.array([h], np.uint64)
                else:
                    yield np.zeros(0, np.uint64)


def minhashes(members: np.ndarray, count: int) -> np.ndarray:
    """``count`` minhashes of a non-empty set of digests."""
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(members), 4096):
            h = members[at : at + 4096, None] * _MULTIPLIERS[None, :count]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(out, h.min(axis=0), out=out)
    return out


def sketch(members: np.ndarray) -> bytes:
    """What a bucket knows of a set: its sorted 32-bit digests if it has up to SMALL members,
    else a byte for each of BINS bins, see ``marks_of``."""
    h = np.unique((mix(members + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32))
    if len(members) <= SMALL:
        return h.tobytes()
    return marks_of(h, np.zeros(len(h), int), 1).tobytes()


def marks_of(digests: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """A byte for each row and bin: 0 if no digest falls there, else a fingerprint of the
    smallest. Digests ascend in every row."""
    bins = (digests >> np.uint32(32 - 9)).astype(np.int64)
    first = np.ones(len(digests), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (row[1:] != row[:-1])
    out = np.zeros((rows, BINS), np.uint8)
    out[row[first], bins[first]] = (digests[first] % np.uint32(255) + np.uint32(1)).astype(np.uint8)
    return out


FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("_a", T.LongType()),
        T.StructField("_b", T.LongType()),
        T.StructField("_left", T.ArrayType(T.IntegerType())),
        T.StructField("_right", T.ArrayType(T.IntegerType())),
        T.StructField("_sketch", T.BinaryType()),
    ]
)


def features(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Set size, digest of the set, both collections and the sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b, left, right, sketches = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                if not len(s):
                    for x in (a, b, left, right, sketches):
                        x.append(None)
                    continue
                with np.errstate(over="ignore"):
                    a.append(int(mix(s).sum().view(np.int64)))
                    b.append(int(mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum().view(np.int64)))
                    m = minhashes(s, 2 * bands * rows).reshape(2 * bands, rows)
                    t = np.zeros(2 * bands, np.uint64)
                    for k in range(rows):
                        t = mix(t * np.uint64(0x9E3779B97F4A7C15) + m[:, k])
                t = (t >> np.uint64(32)).astype(np.uint32).view(np.int32)
                left.append(t[:bands])
                right.append(t[bands:])
                sketches.append(sketch(s))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            columns = [pa.array(x, k) for x, k in zip((sizes, a, b, left, right, sketches), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=FEATURES.fieldNames())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def _bucket_pairs(percent: int, trust: bool):
    """Pairs (a, b, sure) of a partition sorted by bucket; sure ones tie groups with ``trust``; buckets come out of the stream one by one."""

    similarity = percent / 100

    def enough_shared(flat, at, i: int, partners: np.ndarray) -> np.ndarray:
        """Whether small set ``i`` and each of the small sets ``partners`` reach the threshold."""
        own, lengths = flat[at[i] : at[i + 1]], at[partners + 1] - at[partners]
        offsets = np.r_[0, np.cumsum(lengths)[:-1]]
        theirs = flat[np.arange(lengths.sum()) + np.repeat(at[partners] - offsets, lengths)]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        shared = np.add.reduceat(hit, offsets, dtype=np.int64)
        return 100 * shared >= percent * (len(own) + lengths - shared)

    def pairs_of(ids, labels, table, sizes, lefts, rights, marks, flat, at, out) -> None:
        n, bands = len(ids), lefts.shape[1]
        full = marks > 0
        group = np.unique(labels, return_inverse=True)[1]
        asked: list[np.ndarray] = []  # pairs that a sketch leaves open

        def here(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether this is the first table that they share."""
            return (lefts[i] == lefts[j]).argmax(axis=1) * bands + (rights[i] == rights[j]).argmax(axis=1) == table

        def show(i: np.ndarray, j: np.ndarray, sure: bool) -> None:
            out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.full(len(i), int(sure))]))

        def show_here(i: int, j: np.ndarray) -> None:
            i = np.full(len(j), i)
            first = here(i, j)
            show(i[first], j[first], True)

        for i in range(n - 1):
            rest = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
            if not len(rest):
                continue
            same = (marks[rest] == marks[i]) & full[i]
            used = (full[rest] | full[i]).sum(axis=1)
            share = same.sum(axis=1) / used
            # bins are draws without replacement from the union of both sets, whose size at
            # the threshold is known: small sets are seen almost whole
            union = (sizes[rest] + sizes[i]) / (1 + similarity)
            unseen = np.clip((union - used) / np.maximum(union - 1, 1), 0.02, 1)
            slack = CERTAINTY * np.sqrt(similarity * (1 - similarity) * unseen / used)
            near = share >= similarity - slack
            if not near.any():
                continue
            found, sure = rest[near], share[near] >= similarity + slack[near] + 1.0 / 255
            asked.append(np.stack([np.full((~sure).sum(), i), found[~sure]]))
            if not trust:
                show_here(i, found[sure])
                continue
            # one sure pair for every group that it ties to this one
            ties, first = np.unique(group[found[sure]], return_index=True)
            show_here(i, found[sure][first])
            group[np.isin(group, ties)] = group[i]
        if not asked:
            return
        i, j = np.concatenate(asked, axis=1)
        open_still = (group[i] != group[j]) & here(i, j)
        i, j = i[open_still], j[open_still]
        whole = (sizes[i] <= SMALL) & (sizes[j] <= SMALL)
        show(i[~whole], j[~whole], False)
        # small sets are here as a whole: what they do not reach is no link
        i, j = i[whole], j[whole]
        for k in np.unique(i):
            partners = j[i == k]
            partners = partners[group[partners] != group[k]]
            if len(partners):
                linked = partners[enough_shared(flat, at, k, partners)]
                if trust and len(linked):
                    ties, first = np.unique(group[linked], return_index=True)
                    linked = linked[first]
                    group[np.isin(group, ties)] = group[k]
                show(np.full(len(linked), k), linked, True)

    def flush(tables: list[pa.Table]):
        t = pa.concat_tables(tables).combine_chunks()
        col = lambda name: t.column(name).chunk(0)
        key, ids = col("_key").to_numpy(), col("doc_id").to_numpy()
        sizes, labels = col("n_shingles").to_numpy(), col("_label").to_numpy()
        n, table = len(key), col("_table").to_numpy()
        lefts, rights = (col(c).flatten().to_numpy().reshape(n, -1) for c in ("_left", "_right"))
        known, small = col("_sketch").to_pylist(), sizes <= SMALL
        at = np.r_[0, np.cumsum([len(k) // 4 if few else 0 for k, few in zip(known, small)])]
        flat = np.frombuffer(b"".join(k for k, few in zip(known, small) if few), np.uint32)
        marks = marks_of(flat, np.repeat(np.arange(n), np.diff(at)), n)
        marks[~small] = np.frombuffer(b"".join(k for k, few in zip(known, small) if not few), np.uint8).reshape(-1, BINS)
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        out: list[np.ndarray] = []
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high - low > 1:
                part = slice(low, high)
                pairs_of(ids[part], labels[part], table[low], sizes[part], lefts[part], rights[part], marks[part], flat, at[low : high + 1], out)
        both = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(both[2] > 0)], names=["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = t.column("_key").chunk(0).to_numpy()
            tail = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if not len(key):
                continue
            # all but the last bucket of the batch are complete
            if held and held[-1].column("_key")[-1].as_py() == key[-1]:
                held.append(t)
                rows += len(key)
                continue
            held.append(t.slice(0, tail))
            rows += tail
            if rows:
                yield flush(held)
            held, rows = [t.slice(tail)], len(key) - tail
        if rows:
            yield flush(held)

    return run


def table_rows(nodes: DataFrame, bands: int) -> DataFrame:
    """(doc_id, _label, _key, _i, _l) of every node and table."""
    lefts = F.posexplode("_left").alias("_i", "_l")
    rows = nodes.select("doc_id", "_label", lefts, "_right").select("doc_id", "_label", "_i", "_l", F.posexplode("_right").alias("_j", "_r"))
    table = F.col("_i") * F.lit(bands) + F.col("_j")
    # the key's low bits tell the table
    key = F.shiftleft(F.xxhash64("_l", "_r"), TABLE_BITS).bitwiseOR(table.cast("long"))
    return rows.select("doc_id", "_label", key.alias("_key"), "_i", "_l")


def table_of(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).cast("int")


def few_rows(table: DataFrame) -> DataFrame:
    """A written table of narrow rows (keys, ids, counts), to be broadcast if it has at most
    ``FEW_ROWS``; a longer one is joined by shuffle, whose skewed parts Spark splits."""
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table


def dealt_rows(docs: DataFrame, nodes: DataFrame, percent: int, bands: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, _key, _table, _tied) of the buckets, oversize ones as cells, and the links confirmed on
    the way. ``_tied`` is the label that such a link gives a node; nodes of one label are known
    to be one class and are not compared."""
    rows = table_rows(nodes, bands)
    # a bucket is oversize only if its left tuple is: twelve rows a node are counted, not 144
    tuples = nodes.select(F.posexplode("_left").alias("_i", "_l")).groupBy("_i", "_l").agg(F.count(F.lit(1)).alias("_n"))
    tuples = stash(tuples.where(F.col("_n") > SPLIT_BUCKET).drop("_n"), "near-tuples")
    links, cells, tied = None, None, None
    if not tuples.isEmpty():
        counts = rows.join(few_rows(tuples), ["_i", "_l"]).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        oversize = stash(counts.where(F.col("_n") > SPLIT_BUCKET).drop("_n"), "near-oversize")
        if not oversize.isEmpty():
            hot = stash(rows.join(few_rows(oversize), "_key").select("doc_id", "_label", "_key"), "near-hot")
            rows = rows.join(few_rows(oversize), "_key", "left_anti")
            tied, links = _tied(docs, hot, percent)
            cells = _cells(tied)
            drop(hot)
    counted = rows.select("doc_id", "_key").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_key")))
    # counted rows lie together by key: a bucket becomes an array of ids without another shuffle
    members = counted.where("_n > 1").groupBy("_key").agg(F.sort_array(F.collect_list("doc_id")).alias("_ids"))
    # of tables that give the same bucket the first one stands for all
    once = members.groupBy("_ids").agg(F.min(table_of(F.col("_key"))).alias("_table"))
    shared = once.select(F.explode("_ids").alias("doc_id"), F.xxhash64("_ids").alias("_key"), "_table", F.lit(None).cast("long").alias("_tied"))
    buckets = stash(shared if cells is None else shared.unionByName(cells), "near-buckets")
    drop(tuples, tied)
    return buckets, links


def _tied(docs: DataFrame, hot: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """``hot`` with the label of a hub that a node is linked to, and these links. The hub of a
    bucket is one of its nodes, in most buckets of a family the same one; what stays unlinked
    gets another hub, as long as a bucket's rest is oversize and hubs find links."""
    done, rest, links = [], hot, None
    while True:
        hubs = rest.groupBy("_key").agg(F.min_by(F.struct("doc_id", "_label"), F.xxhash64("doc_id")).alias("_hub"), F.count(F.lit(1)).alias("_n"))
        hubs = stash(hubs.where(F.col("_n") > SPLIT_BUCKET).select("_key", F.col("_hub.doc_id").alias("_hub"), F.col("_hub._label").alias("_own")), "near-hubs")
        if hubs.isEmpty():
            break
        asked = rest.join(few_rows(hubs), "_key")
        pairs = stash(asked.where("doc_id <> _hub AND _label <> _own").select(F.col("_hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "near-asked")
        found = confirmed_links(docs, pairs, percent, hubs=True)
        drop(pairs)
        links = found if links is None else links.unionByName(found)
        linked = asked.join(found, (asked["_hub"] == found["a"]) & (asked["doc_id"] == found["b"]), "left")
        ties = linked.withColumn("_tie", F.col("b").isNotNull() | (F.col("doc_id") == F.col("_hub")) | (F.col("_label") == F.col("_own")))
        ties = stash(ties.select("_key", "doc_id", F.when(F.col("_tie"), F.col("_own")).otherwise(F.col("_label")).alias("_label"), "_tie"), "near-ties")
        done += [ties.where("_tie").drop("_tie"), rest.join(few_rows(hubs.select("_key")), "_key", "left_anti")]
        rest = ties.where("NOT _tie").drop("_tie")
        if 10 * ties.where("_tie").count() < ties.count():
            break
    for part in done:
        rest = rest.unionByName(part)
    return stash(rest.select("doc_id", "_label", "_key"), "near-tied"), links


def _cells(hot: DataFrame) -> DataFrame:
    """Oversize buckets as cells: the nodes of a bucket's most frequent label are dealt into
    blocks, the others too; every block of the others meets every block."""
    sizes = hot.groupBy("_key", "_label").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.groupBy("_key").agg(F.max_by("_label", F.struct("_n", "_label")).alias("_main"), F.max("_n").alias("_m"), F.sum("_n").alias("_all"))
    half = F.lit(max(SPLIT_BUCKET // 2, 1))
    count = lambda n: F.ceil(n / half).cast("int")
    sizes = stash(sizes.where("_all > _m").select("_key", "_main", count(F.col("_m")).alias("_p"), count(F.col("_all") - F.col("_m")).alias("_q")), "near-sizes")
    rows = hot.join(few_rows(sizes), "_key")
    main = F.col("_label") == F.col("_main")
    block = F.pmod(F.xxhash64("doc_id"), F.when(main, F.col("_p")).otherwise(F.col("_q"))).cast("int")
    rows = rows.withColumn("_block", block)
    each = lambda n, cell: F.transform(F.sequence(F.lit(0), n - 1), cell)
    mine = F.col("_block")
    against = each(F.col("_q"), lambda x: F.array(F.lit(0), mine, x))
    others = F.concat(each(F.col("_p"), lambda x: F.array(F.lit(0), x, mine)), each(F.col("_q"), lambda x: F.array(F.lit(1), F.least(mine, x), F.greatest(mine, x))))
    rows = rows.select("doc_id", "_label", "_key", F.explode(F.when(main, against).otherwise(others)).alias("_cell"))
    return rows.select("doc_id", F.xxhash64("_key", "_cell").alias("_key"), table_of(F.col("_key")).alias("_table"), F.col("_label").alias("_tied"))


PAIRS = "a long, b long, sure boolean"


def candidate_pairs(docs: DataFrame, nodes: DataFrame, percent: int, bands: int, trust: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, sure) of nodes that share a table and whose sketches do not rule a link out,
    and the links confirmed on the way. With ``trust`` pairs that sure ones tie are left out."""
    buckets, links = dealt_rows(docs, nodes, percent, bands)
    sketched = buckets.join(nodes, "doc_id").select("_key", "_table", "doc_id", F.coalesce("_tied", "_label").alias("_label"), "n_shingles", "_left", "_right", "_sketch")
    dealt = sketched.repartition("_key").sortWithinPartitions("_key", "doc_id")
    return dealt.mapInArrow(_bucket_pairs(percent, trust), PAIRS).where("a <> b").distinct(), links


def confirmed_links(docs: DataFrame, pairs: DataFrame, percent: int, hubs: bool = False) -> DataFrame:
    """Pairs whose full sets have 100 * shared >= percent * together. With ``hubs`` a few ids
    stand as ``a`` of most pairs."""
    roles = F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.lit(True).alias("_a"), F.lit(False).alias("_b")), F.struct(F.col("b").alias("doc_id"), F.lit(False).alias("_a"), F.lit(True).alias("_b"))))
    wanted = pairs.select(roles.alias("r")).groupBy(F.col("r.doc_id").alias("_wanted")).agg(F.bool_or("r._a").alias("_a"), F.bool_or("r._b").alias("_b"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["doc_id", "_a", "_b", "members"])

    wanted = stash(wanted, "near-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few(wanted), F.col("doc_id") == F.col("_wanted")).select("doc_id", "_a", "_b", "text")
    members = stash(texts.mapInArrow(sets, "doc_id long, _a boolean, _b boolean, members binary"), "near-sets")
    ours = members.where("_a").select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    if hubs and ours.count() <= BROADCAST_SETS:
        ours = F.broadcast(ours)
    # a few ids stand as ``a`` of most pairs: the other set goes to its pairs first
    both = pairs.join(members.where("_b").select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b").join(ours, "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            good = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([good.column(0), good.column(1)], names=["a", "b"])

    found = stash(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near-found")
    drop(wanted, members)
    return found


def all_links(docs: DataFrame, nodes: DataFrame, percent: int, bands: int) -> DataFrame:
    """Confirmed links that tie all classes. Pairs that a sure pair kept back are looked at again
    where that pair has failed: among the nodes that sure pairs tie to it, with the classes
    confirmed so far as labels."""
    found, tied = candidate_pairs(docs, nodes, percent, bands)
    pairs = stash(found, "near-pairs")
    links = _with(confirmed_links(docs, pairs.select("a", "b"), percent), tied)
    sure = pairs.where("sure").select("a", "b")
    failed = stash(sure.join(links, ["a", "b"], "left_anti"), "near-failed")
    if failed.isEmpty():
        return links
    groups = stash(components(_with(sure, tied)), "near-sure")
    # the smallest node of a component has no row there; b is never it
    heads = stash(groups.join(failed.select(F.col("b").alias("node")), "node").select("component").distinct(), "near-heads")
    opened = groups.join(few(heads), "component").select(F.col("node").alias("doc_id")).unionByName(heads.select(F.col("component").alias("doc_id")))
    opened = stash(opened.distinct(), "near-opened")
    classes = components(links.join(few(opened), links["a"] == opened["doc_id"]).select("a", "b"))
    labels = opened.join(classes, opened["doc_id"] == classes["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("_label"))
    again = stash(nodes.drop("_label").join(stash(labels, "near-labels"), "doc_id").select(*nodes.columns), "near-again")
    found, more = candidate_pairs(docs, again, percent, bands, trust=False)
    found = stash(found.select("a", "b").distinct(), "near-pairs")
    links = _with(links.unionByName(confirmed_links(docs, found, percent)), more)
    drop(pairs, failed, groups, heads, opened, found)
    return links


def _with(links: DataFrame, more: DataFrame | None) -> DataFrame:
    return links if more is None else links.unionByName(more)


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node with a link the smallest node it reaches.

    Alternates large-star and small-star until the links are stars; each round is an
    aggregate and a join by key, written to the shared folder, so rounds do not pile up.
    The centre of a large class has a row for each member. So the smallest neighbours are
    tables of their own, with one row a node: Spark then broadcasts them if they are small and
    splits the partition of a centre if not, which it cannot do to a join that shares its
    exchange with an aggregate."""
    edges, mark = _stars(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "near-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = stash(large.where("u <> v").distinct(), "near-down")
        lower = stash(down.groupBy("u").agg(F.min("v").alias("m")), "near-least")
        small = down.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        again, now = _stars(small.select("e.u", "e.v").where("u <> v"))
        drop(edges, least, down, lower)
        edges = again
        if now == mark:
            break
        mark = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _stars(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The distinct edges as a table, with a number of rows and checksums observed as they are
    written: equal for equal tables."""
    seen, h = Observation(), F.xxhash64("u", "v")
    counted = edges.distinct().observe(seen, F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"))
    return stash(counted, "near-links"), seen.get


def near_classes(docs: DataFrame, percent: int = 75, bands: int = 12, rows: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Linked documents share the smallest doc_id of their class as component_id; ``kept`` marks
    that document. Null and empty texts have no shingles and stand alone. A null doc_id
    takes no part: component_id null, kept true. Rows that repeat a doc_id are one document
    with several sets. Empty tables give no rows. No group, bucket or class is capped."""
    known = stash(features(docs, bands, rows), "near-features")
    narrow = known.select("doc_id", "n_shingles", "_a", "_b")
    filled = known.where("doc_id IS NOT NULL AND n_shingles > 0")
    keys = ["n_shingles", "_a", "_b"]
    groups = stash(filled.groupBy(*keys).agg(F.min("doc_id").alias("_rep"), F.count(F.lit(1)).alias("_rows")), "near-groups")
    repeats, copies = has_repeats(filled), None
    if repeats:
        leads = groups.select(F.col("_rep").alias("doc_id"), *keys)
        nodes = filled.join(leads, ["doc_id", *keys]).dropDuplicates(["doc_id", "_a", "_b"])
    else:
        # the copies, fewer than the leads, are what a join has to take away
        leads = groups.select(F.col("_rep").alias("doc_id"))
        copies = stash(filled.select("doc_id").join(leads, "doc_id", "left_anti"), "near-copies")
        nodes = filled.join(few(copies), "doc_id", "left_anti")
    nodes = nodes.select("doc_id", F.col("doc_id").alias("_label"), "n_shingles", "_left", "_right", "_sketch")
    links = all_links(docs, nodes, percent, bands)
    full = narrow.where("doc_id IS NOT NULL AND n_shingles > 0")
    total = known.count()
    if repeats:
        # a doc_id that stands on several rows ties their sets together
        own = stash(join_unique(full, groups, keys, total).select("doc_id", "_rep").distinct(), "near-own")
        first = own.groupBy("doc_id").agg(F.min("_rep").alias("_first"))
        links = links.unionByName(own.join(first, "doc_id").where("_rep <> _first").select(F.col("_first").alias("a"), F.col("_rep").alias("b")))
    found = components(links)
    # classes go to the groups of equal sets, one row each, before they meet the documents
    classes = stash(groups.join(found, groups["_rep"] == found["node"], "left").drop("node"), "near-classes")
    drop(groups, copies)
    empty = narrow.where("doc_id IS NULL OR n_shingles = 0").withColumns({"_rep": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    out = join_unique(full, classes, keys, total).drop("_rows").unionByName(empty)
    label = F.coalesce("component", "_rep", "doc_id")
    if repeats:
        label = F.min(label).over(Window.partitionBy("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), label)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", kept)


def has_repeats(docs: DataFrame) -> bool:
    """Whether a non-null doc_id stands on several rows."""
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def few(ids: DataFrame) -> DataFrame:
    """``ids`` (a stashed table of single longs) marked for broadcast if its counted size allows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are not kept; columns as they are. Repeated
    doc_ids keep one row (the one with the smallest text, as bytes). Rows with a null doc_id stay."""
    gone = stash(near_classes(docs, **options).where("NOT kept").select("doc_id").distinct(), "near-gone")
    side = few(gone)
    out = docs.join(side, docs["doc_id"] == side["doc_id"], "left_anti")
    if not has_repeats(docs):
        return out
    # the columns of the input may have any name: they travel as one struct
    rows = out.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    first = Window.partitionBy("doc_id").orderBy("text")
    once = rows.where("doc_id IS NOT NULL").withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return once.select("_row.*").unionByName(out.where("doc_id IS NULL"))
