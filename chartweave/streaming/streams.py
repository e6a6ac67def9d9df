"""The request-driven work as streams: counts by time, points seen once, documents as they come."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chartweave.operators import redaction
from chartweave.operators.history import message_preview
from chartweave.operators.ingest import new_points
from chartweave.operators.vectors import upsert_points
from chartweave.sources.files import READERS, extract_text
from chartweave.sources.scratch import delete_folder, folder_exists, shared_folder, stash

def removed_counts(stream: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(window_start, type, removed): sums of ``n`` by type and window of ``ts``; rows later
    than ``delay`` are ignored, state of closed windows is dropped."""
    sums = stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "type").agg(F.sum("n").alias("removed"))
    return sums.select(F.col("w.start").alias("window_start"), "type", "removed")


def dedup_points(stream: DataFrame, key: str = "point_id", delay: str = "2 hours") -> DataFrame:
    """Each key once as long as its copies come within ``delay`` of each other."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is there now, into Parquet in the shared folder, and read it."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def upsert_buckets(fresh: DataFrame, folder: str, buckets: int = 64) -> None:
    """Lay points over those stored under ``folder``, which is partitioned by ``doc_type`` and
    ``bucket`` (of the point's id): only partitions that ``fresh`` has points for are read and
    written anew, each as one file. The merged rows are written aside first, so that a run that
    fails leaves the store as it was, and a second run of the same points the same rows. Points
    without a type go into one of their own."""
    spark = fresh.sparkSession
    fresh = stash(fresh.withColumn("bucket", F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int")), "fresh")
    touched = fresh.select("doc_type", "bucket").distinct()
    merged = fresh
    if folder_exists(spark, folder):
        # the scan reads the partitions of the filter alone; there are at most types x buckets of them
        names = [(r["doc_type"], r["bucket"]) for r in touched.collect()]
        wanted = F.lit(False)
        for kind in {k for k, _ in names}:
            wanted = wanted | (F.col("doc_type").eqNullSafe(F.lit(kind)) & F.col("bucket").isin([n for k, n in names if k == kind]))
        stored = spark.read.schema(fresh.schema).parquet(folder).where(wanted).select(*fresh.columns)
        merged = stash(upsert_points(stored, fresh.withColumn("arrival", F.lit(0))), "merged")
    rows = merged.repartition("doc_type", "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_type", "bucket").parquet(folder)


def ingest(stream: DataFrame, key: str, chunk, load, base: str, name: str = "", buckets: int = 64) -> StreamingQuery:
    """Start taking documents (key, text) as they come to points: redacted, gated, cut,
    embedded. Points go into the bucketed store ``points`` under ``base``; what was held back
    stands in a folder of each micro-batch, which one that runs again after a failure overwrites."""

    def step(batch: DataFrame, number: int) -> None:
        clean, held = redaction.gate_split(redaction.redact_documents(batch))
        upsert_buckets(new_points(clean.select(key, "text"), chunk, load, name, "user_upload"), f"{base}/points", buckets)
        held.select(key, "reason").write.mode("overwrite").parquet(f"{base}/quarantine/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()


#: Fixed value: bytes of an uploaded file at most.
MOST_BYTES = 20 * 1024 * 1024


def uploaded_files(spark: SparkSession, root: str) -> DataFrame:
    """The stream of files that come into a folder: path, suffix, length, content. Lock files
    are left out, and empty ones, which Spark's file source passes over; a file of no known kind
    or size keeps its row, for its outcome."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.where(~name.startswith("~$")).select("path", suffix.alias("suffix"), "length", "content")


def take_uploads(files: DataFrame, chunk, load, folder: str, name: str = "", buckets: int = 64) -> DataFrame:
    """Files (path, suffix, length, content) to points in the bucketed store ``folder``; what
    became of each: path, status, chunks, removed_count, removed_by_type. A status is ingested
    or why not: BAD_REQUEST (a kind or size that is not taken), EXTRACTION_ERROR,
    EMPTY_DOCUMENT, PII_DETECTED, NO_CHUNKS. Neither content nor text is kept of those."""
    taken = F.col("suffix").isin(*READERS, "doc") & (F.col("length") > 0) & (F.col("length") <= MOST_BYTES)
    bad = files.where(~taken).select("path", F.lit("BAD_REQUEST").alias("status"))
    read = stash(redaction.redact_documents(extract_text(files.where(taken)).withColumn("blank", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == "")), "uploads")
    status = F.when(F.col("extract_error").isNotNull(), "EXTRACTION_ERROR").when(F.col("blank"), "EMPTY_DOCUMENT").when(~F.col("clean"), "PII_DETECTED")
    told = read.select("path", status.alias("status"), "removed_count", "removed_by_type")
    clean = read.where(status.isNull()).select("path", "text")
    upsert_buckets(new_points(clean, chunk, load, name, "user_upload"), folder, buckets)
    cut = chunk(clean).groupBy("path").agg(F.count(F.lit(1)).alias("chunks"))
    good = told.join(cut, "path", "left")
    last = F.coalesce("status", F.when(F.col("chunks").isNull(), "NO_CHUNKS").otherwise("ingested"))
    ready = last == "ingested"
    done = good.select("path", last.alias("status"), F.when(ready, F.col("chunks")).otherwise(0).cast("long").alias("chunks"), F.when(ready, F.col("removed_count")).otherwise(0).alias("removed_count"), F.when(ready, F.col("removed_by_type")).alias("removed_by_type"))
    none = bad.select("path", "status", F.lit(0).cast("long").alias("chunks"), F.lit(0).alias("removed_count"), F.lit(None).cast("map<string,int>").alias("removed_by_type"))
    return done.unionByName(none)


def ingest_uploads(files: DataFrame, chunk, load, base: str, name: str = "", buckets: int = 64) -> StreamingQuery:
    """Start taking uploaded files (``uploaded_files``) to points, extraction included. Under
    ``base``: the store ``points``, and ``outcomes/batch=`` of each micro-batch."""

    def step(batch: DataFrame, number: int) -> None:
        take_uploads(batch, chunk, load, f"{base}/points", name, buckets).write.mode("overwrite").parquet(f"{base}/outcomes/batch={number}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()


def uploaded_points(spark: SparkSession, base: str) -> DataFrame:
    """The points so far, each once: the store as it stands."""
    return spark.read.parquet(f"{base}/points").drop("bucket")


class ThreadProcessor(StatefulProcessor):
    """One value a thread: its last message, the last read of either side, and the times of the
    messages behind these reads. Times decide, whatever the order of arrival: a late read
    clears what is not newer than itself, a late message behind no read counts."""

    STATE = "at long, id long, body string, admin_read long, user_read long, by_admin array<long>, by_user array<long>"
    OUT = "thread_id long, last_message_at long, last_id long, body string, unread_by_admin long, unread_by_user long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.thread = handle.getValueState("thread", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, last, body, *sides = self.thread.get() if self.thread.exists() else (None, None, None, None, None, [], [])
        read, unread = dict(zip(("admin", "user"), sides[:2], strict=True)), {k: list(v) for k, v in zip(("admin", "user"), sides[2:], strict=True)}
        for f in rows:
            for when, number, kind, text in zip(*(f[c].tolist() for c in ("at", "id", "kind", "body")), strict=True):
                if kind in ("user", "support"):
                    unread["admin" if kind == "user" else "user"].append(when)
                    if at is None or (when, number) >= (at, last):
                        at, last, body = when, number, text
                elif kind in ("admin_read", "user_read"):
                    who = kind.removesuffix("_read")
                    read[who] = when if read[who] is None else max(read[who], when)
            for who, since in read.items():
                if since is not None:
                    unread[who] = [t for t in unread[who] if t > since]
        self.thread.update((at, last, body, read["admin"], read["user"], unread["admin"], unread["user"]))
        columns = [pd.Series([key[0]], dtype="int64"), *(pd.Series([v], dtype="Int64") for v in (at, last)), pd.Series([body], dtype=object), *(pd.Series([len(unread[w])], dtype="int64") for w in ("admin", "user"))]
        yield pd.DataFrame(dict(zip((c.split()[0] for c in self.OUT.split(", ")), columns, strict=True)))

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state the RocksDB provider keeps; the session's setting stays."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        return start()
    finally:
        spark.conf.set(name, before)


#: Batches after which the changes of threads are laid over one another, into one table.
SNAPSHOT_EVERY = 32


def stream_threads(stream: DataFrame, base: str, snapshot_every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """Start keeping every thread's last message and unread counters from events (thread_id,
    at, id, kind, body; kind is user or support for messages, admin_read or user_read). State
    is one value a thread; a micro-batch writes the threads it touches, in a folder of its own
    under ``base``, so that a batch run again after a failure writes the same. Every
    ``snapshot_every`` batches the changes become one table and their folders go."""
    spark = stream.sparkSession
    events = stream.where("thread_id IS NOT NULL").select("thread_id", F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), "kind", "body")
    kept = events.groupBy("thread_id").transformWithStateInPandas(ThreadProcessor(), ThreadProcessor.OUT, "Update", "None")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch={number}")
        if (number + 1) % snapshot_every == 0:
            newest_threads(batch.sparkSession, base, number).write.mode("overwrite").parquet(f"{base}/snapshots/batch={number}")
            # what the snapshot before this one was made of: a batch that runs again needs no more
            for old in _numbers(batch.sparkSession, f"{base}/changes"):
                if old <= number - snapshot_every:
                    delete_folder(batch.sparkSession, f"{base}/changes/batch={old}")
            for old in _numbers(batch.sparkSession, f"{base}/snapshots")[:-2]:
                delete_folder(batch.sparkSession, f"{base}/snapshots/batch={old}")

    return with_rocksdb(spark, lambda: kept.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole batches in a folder, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    whole = lambda status: system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in system.listStatus(path) if whole(s))


def newest_threads(spark: SparkSession, base: str, until: int | None = None) -> DataFrame:
    """Every thread as of batch ``until`` (null: the last): the snapshot before and the changes
    since, of which the newest row of a thread stands."""
    found = [n for n in _numbers(spark, f"{base}/snapshots") if until is None or n < until]
    since = found[-1] if found else -1
    rows = spark.createDataFrame([], ThreadProcessor.OUT + ", batch int")
    if found:
        rows = rows.unionByName(spark.read.schema(ThreadProcessor.OUT).parquet(f"{base}/snapshots/batch={since}").withColumn("batch", F.lit(since)))
    for n in _numbers(spark, f"{base}/changes"):
        if n > since and (until is None or n <= until):
            rows = rows.unionByName(spark.read.schema(ThreadProcessor.OUT).parquet(f"{base}/changes/batch={n}").withColumn("batch", F.lit(n)))
    last = F.max_by(F.struct("last_message_at", "last_id", "body", "unread_by_admin", "unread_by_user"), F.col("batch")).alias("t")
    return rows.groupBy("thread_id").agg(last).select("thread_id", "t.*")


def current_threads(spark: SparkSession, base: str) -> DataFrame:
    """The threads after the last batch; one that was only read so far has no message."""
    return newest_threads(spark, base).select("thread_id", "last_message_at", message_preview(F.col("body")).alias("last_message_preview"), "unread_by_admin", "unread_by_user")


class SeenProcessor(StatefulProcessor):
    """One value a bucket: a Bloom filter of the ids that came so far, in layers that are added
    as they fill. Tells, for each id of a batch once, whether it may have come before."""

    def __init__(self, bits: int):
        self.bits = bits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ids long, filters binary")

    def _places(self, ids: list[str]) -> np.ndarray:
        """Seven places of each id, from the halves of one digest."""
        raw = np.frombuffer(b"".join(hashlib.blake2b(i.encode(), digest_size=16).digest() for i in ids), np.uint64).reshape(-1, 2)
        with np.errstate(over="ignore"):
            return ((raw[:, :1] + np.arange(7, dtype=np.uint64) * (raw[:, 1:] | np.uint64(1))) % np.uint64(self.bits)).astype(np.int64)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, blob = self.seen.get() if self.seen.exists() else (0, b"")
        layers = np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool).reshape(-1, self.bits)
        told: set[str] = set()
        for f in rows:
            fresh = [i for i in dict.fromkeys(f["point_id"].tolist()) if i not in told]
            if not fresh:
                continue
            told.update(fresh)
            places = self._places(fresh)
            maybe = np.zeros(len(fresh), bool)
            for layer in layers:
                maybe |= layer[places].all(axis=1)
            # a layer of ten bits an id errs for one new id in a hundred
            for low in range(0, len(fresh)):
                if count % (self.bits // 10) == 0:
                    layers = np.concatenate([layers, np.zeros((1, self.bits), bool)])
                layers[-1][places[low]] = True
                count += 1
            yield pd.DataFrame({"bucket": key[0], "point_id": fresh, "maybe": maybe})
        self.seen.update((count, np.packbits(layers).tobytes()))

    def close(self) -> None:
        pass


def stream_new_points(stream: DataFrame, base: str, buckets: int = 64, bits: int = 1 << 20) -> StreamingQuery:
    """Start keeping each ``point_id`` (text) that was never there before, without a limit of
    time. Ids are dealt into ``buckets``; a bucket's Bloom filter tells most new ids at once,
    and only those that it does not exclude meet the stored ids of their buckets in an exact
    anti-join. Under ``base``: ``points/batch=/bucket=`` (point_id) and ``report/batch=`` (ids,
    asked, new). A batch that runs again meets only ids of the batches before it and writes the
    same. Null ids are passed over."""
    ids = stream.where("point_id IS NOT NULL").select("point_id", F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int").alias("bucket"))
    told = ids.groupBy("bucket").transformWithStateInPandas(SeenProcessor(bits), "bucket int, point_id string, maybe boolean", "Update", "None")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = stash(batch, "told")
        asked = [r["bucket"] for r in rows.where("maybe").select("bucket").distinct().collect()]
        new = rows.where("NOT maybe").select("point_id", "bucket")
        if asked:
            # partitions of other buckets and of this batch are never read
            stored = spark.read.schema("point_id string, batch int, bucket int").option("basePath", f"{base}/points").parquet(f"{base}/points") if number else spark.createDataFrame([], "point_id string, batch int, bucket int")
            known = stored.where((F.col("batch") < number) & F.col("bucket").isin(asked)).select("point_id")
            new = new.unionByName(rows.where("maybe").select("point_id", "bucket").join(known, "point_id", "left_anti"))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/points/batch={number}")
        written = spark.read.schema("point_id string, bucket int").parquet(f"{base}/points/batch={number}").count()
        sums = rows.agg(F.count(F.lit(1)).alias("ids"), F.count_if("maybe").alias("asked")).withColumn("new", F.lit(written).cast("long"))
        sums.write.mode("overwrite").parquet(f"{base}/report/batch={number}")

    return with_rocksdb(stream.sparkSession, lambda: told.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())


def seen_points(spark: SparkSession, base: str) -> DataFrame:
    """Every id once."""
    return spark.read.schema("point_id string, batch int, bucket int").parquet(f"{base}/points").select("point_id")


def skipped_joins(spark: SparkSession, base: str) -> DataFrame:
    """By batch: ids, those asked for in the stored points, new ones, and the share that the
    filters spared the join."""
    rows = spark.read.schema("ids long, asked long, new long, batch int").parquet(f"{base}/report")
    return rows.select("batch", "ids", "asked", "new", (1 - F.col("asked") / F.col("ids")).alias("skipped"))


#: What is kept of a session: times in microseconds, ``due`` (when it is forgotten) in milliseconds.
_SESSION = np.dtype([("id", np.int64), ("doctor", np.int64), ("issued", np.int64), ("ended", np.int64), ("due", np.int64), ("told", np.bool_)])


def stream_sessions(stream: DataFrame, days: float = 3, delay: str = "2 hours", buckets: int = 1024) -> DataFrame:
    """Closed sessions (session_id, doctor_id, issued_at, closed_at, reason) from events
    (session_id, doctor_id, kind, ts) as they come: a session begins with its first login and
    is closed by the first refresh or logout (revoked; one logged before the login closes it at
    once), else when event time passes its life of ``days`` (expired). Each is told once, if no event comes more than ``delay`` late: what is
    remembered of a closed one goes when its life is over. State is a few numbers a session, kept
    for ``buckets`` of sessions together, so that a call takes all rows of a bucket at once."""
    life, never, null = int(days * 86_400_000_000), 1 << 62, -(1 << 63)  # microseconds

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = np.frombuffer(state.get[0], _SESSION) if state.exists else np.zeros(0, _SESSION)
        now = state.getCurrentWatermarkMs()
        come = [] if state.hasTimedOut else [f[["session_id", "doctor_id", "begun", "at"]] for f in frames]
        ids = np.unique(np.concatenate([old["id"], *[f["session_id"].to_numpy() for f in come]]))
        held = np.zeros(len(ids), _SESSION)
        held["id"], held["issued"], held["ended"] = ids, never, never
        held[np.searchsorted(ids, old["id"])] = old
        touched = np.zeros(len(ids), bool)
        for f in come:
            at, place, begun = f["at"].to_numpy(), np.searchsorted(ids, f["session_id"].to_numpy()), f["begun"].to_numpy(bool)
            touched[place] = True
            np.minimum.at(held["ended"], place[~begun], at[~begun])
            logins = np.flatnonzero(begun)
            logins = logins[np.argsort(at[logins], kind="stable")]
            who, first = np.unique(place[logins], return_index=True)
            first = logins[first]
            earlier = at[first] < held["issued"][who]
            held["doctor"][who[earlier]], held["issued"][who[earlier]] = f["doctor_id"].to_numpy()[first[earlier]], at[first[earlier]]
        revoked = (held["issued"] < never) & (held["ended"] < held["issued"] + life) & ~held["told"]
        held["told"] |= revoked
        last = np.minimum(held["issued"], held["ended"]) + life
        # what event time has passed already is over with the next batch
        held["due"] = np.where(touched, np.maximum(last // 1000, now + 1), held["due"])
        over = ~touched & (held["due"] < now)
        expired = over & (held["issued"] < never) & ~held["told"]
        closed = np.r_[np.maximum(held["ended"], held["issued"])[revoked], held["issued"][expired] + life]
        if len(closed):
            out = np.r_[held[revoked], held[expired]]
            yield pd.DataFrame({"session_id": out["id"], "doctor_id": out["doctor"], "issued": out["issued"], "closed": closed, "reason": ["revoked"] * int(revoked.sum()) + ["expired"] * int(expired.sum())})
        kept = held[~over]
        if not len(kept):
            state.remove()
            return
        state.update((kept.tobytes(),))
        state.setTimeoutTimestamp(max(int(kept["due"].min()), now, 1))

    known = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(null)).alias(name)
    rows = stream.where(F.col("kind").isin("login", "refresh", "logout") & F.col("ts").isNotNull())
    rows = rows.select(known("session_id"), known("doctor_id"), (F.col("kind") == "login").alias("begun"), "ts", F.unix_micros("ts").alias("at"))
    closed = (
        rows.withWatermark("ts", delay)
        .withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(step, "session_id long, doctor_id long, issued long, closed long, reason string", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    )
    given = lambda name: F.nullif(F.col(name), F.lit(null)).alias(name)
    return closed.select(given("session_id"), given("doctor_id"), F.timestamp_micros("issued").alias("issued_at"), F.timestamp_micros("closed").alias("closed_at"), "reason")
