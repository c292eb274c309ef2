"""Event streams of crawl jobs and requests, each with a batch twin of the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from listmill.functions import columns as C
from listmill.operators import extract, sections
from listmill.streaming import states, store

DELAY = "10 minutes"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_job_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Events as a stream of Parquet files."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def sink_table(rows: DataFrame, path: str, checkpoint: str, partition: str | None = None):
    """A stream into a table, each row exactly once: a micro-batch has a folder of its own, which it writes again if it runs again.

    The table is read with read_sink(); `partition` names a column by which each batch is dealt to folders. Takes what is there and stops.
    """

    def write(batch: DataFrame, k: int) -> None:
        out = batch.write.mode("overwrite")
        (out.partitionBy(partition) if partition else out).parquet(f"{path}/batch={k}")

    return ingest(rows, write, checkpoint)


def read_sink(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of sink_table() with `batch`, the micro-batch they came in."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def counters(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts of each kind for each job; the same code for a batch or, in update mode, a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", DELAY)
    return events.groupBy("job_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def windowed(events: DataFrame, width: str = "1 day") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", DELAY)
    return events.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def first_seen(urls: DataFrame) -> DataFrame:
    """One row for each (job, url): for streams within the watermark."""
    return urls.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["job_id", "url"]) if urls.isStreaming else urls.dropDuplicates(["job_id", "url"])


def _in_order(requests: DataFrame, step: Callable[[list[float], float], bool], name: str, seconds: float) -> DataFrame:
    """requests(key, t, id) with what `step(held, t)` says of each; it keeps what it must know of a key's earlier ones in `held`.

    A batch deals the rows by key, sorts and streams them, so that a key of any size holds only `held`. A stream keeps `held`
    as the key's state until `seconds` after its last time; it gives the same rows if a key's requests arrive in order, and not
    later than DELAY after those of other keys.
    """
    schema = f"key long, t double, id long, {name} boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for frame in frames:
            out = []
            for k, t in zip(frame["key"], frame["t"], strict=True):
                if k != key:
                    key, held = k, []
                out.append(step(held, t))
            yield frame.assign(**{name: out})

    rows = requests.select("key", "t", "id")
    if requests.isStreaming:
        timed = rows.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).withWatermark("ts", DELAY)
        return states.expiring(timed, "key", states.Held(step, seconds, name), schema)
    return rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInPandas(run, schema)


def rate_limit(requests: DataFrame, most: int, seconds: float) -> DataFrame:
    """requests(key, t, id) with `admitted`: fewer than `most` admitted in the last `seconds`; 0 turns the limit off."""

    def step(held: list[float], t: float) -> bool:
        if most <= 0 or seconds <= 0:
            return True
        while held and held[0] <= t - seconds:
            held.pop(0)
        if len(held) >= most:
            return False
        held.append(t)
        return True

    return _in_order(requests, step, "admitted", seconds)


def ttl_reuse(requests: DataFrame, ttl: float) -> DataFrame:
    """requests(key, t, id) with `hit`: fetched less than ttl ago; a miss fetches and restarts the time, a hit does not."""

    def step(held: list[float], t: float) -> bool:
        if held and t - held[0] < ttl:
            return True
        held[:] = [t]
        return False

    return _in_order(requests, step, "hit", ttl)


def heartbeats(events: DataFrame, seconds: float) -> DataFrame:
    """Gaps after which a job counts as failed: events that follow their predecessor by more than `seconds`."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return events.withColumn("gap", gap).where(F.col("gap") > seconds)


def stale(events: DataFrame, seconds: int) -> DataFrame:
    """Events after which a job was silent for more than `seconds`, so that it counts as failed: (job_id, event_id, ts).

    The last silence of a job counts once events have moved on by `seconds` and DELAY. Streams fail such a job by a timer on
    event time, or when its next event arrives first; they give the same rows if a job's events arrive in order.
    """
    if events.isStreaming:
        return _stream_stale(events, seconds)
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    end = events.agg((F.max("ts") - F.expr(f"INTERVAL {DELAY}")).alias("end"))  # one row
    rows = events.withColumn("next", F.lead("ts").over(w)).crossJoin(F.broadcast(end))
    silent = F.coalesce(F.unix_millis("next"), F.unix_millis("end")) - F.unix_millis("ts") > 1000 * seconds
    return rows.where(silent).select("job_id", "event_id", "ts")


def _stream_stale(events: DataFrame, seconds: int) -> DataFrame:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, event = state.get if state.exists else (None, None)
        out = []
        if state.hasTimedOut:
            out.append((last, event))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["ms", "event_id"])
            for t, e in zip(rows["ms"].tolist(), rows["event_id"].tolist(), strict=True):
                if last is not None and t - last > 1000 * seconds:
                    out.append((last, event))
                last, event = t, e
            if last + 1000 * seconds < state.getCurrentWatermarkMs():
                out.append((last, event))
                if state.exists:
                    state.remove()
            else:
                state.update((last, event))
                state.setTimeoutTimestamp(max(last + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]] * len(out), "event_id": [o[1] for o in out], "ms": [o[0] for o in out]})

    rows = events.withWatermark("ts", DELAY).select("job_id", "ts", "event_id", F.unix_millis("ts").alias("ms")).groupBy("job_id")
    rows = rows.applyInPandasWithState(step, "job_id long, event_id long, ms long", "last long, event long", "append", GroupStateTimeout.EventTimeTimeout)
    return rows.select("job_id", "event_id", F.timestamp_millis("ms").alias("ts"))


#: Legal moves of a job: the state before, what is asked, and the state after.
MOVES = {("pending", "start"): "running", ("pending", "cancel"): "cancelled", ("running", "fail"): "failed", ("running", "complete"): "completed"}


def _moved(state: str, asked: bool, action: str | None) -> tuple[str, bool]:
    """State of a job, and whether its end is asked for, after an action."""
    after = "cancelled" if asked and (state, action) == ("running", "complete") else MOVES.get((state, action), state)
    return after, asked or (state, action) == ("running", "cancel")


#: States that a job stays in.
ENDED = ("completed", "failed", "cancelled")
#: Seconds for which a job that has ended is kept.
KEPT = 3600


def _folded(seconds: float | None) -> Callable[[tuple | None, list[tuple]], tuple]:
    """fold((state, asked, ms of the last event) or None, [(ms, action)]); a job that ended more than `seconds` before an event begins anew."""

    def fold(job: tuple | None, events: list[tuple]) -> tuple:
        state, asked, last = job or ("pending", False, None)
        for ms, action in events:
            if seconds is not None and state in ENDED and ms - last > 1000 * seconds:
                state, asked = "pending", False
            state, asked = _moved(state, asked, action)
            last = ms
        return state, asked, last

    return fold


def lifecycle(events: DataFrame, seconds: float | None = None) -> DataFrame:
    """Final state of each job after folding its events (start, complete, fail, cancel) in order; illegal moves are ignored.

    With `seconds`, a job that has ended is forgotten so long after its last event, and a later event begins a new one. The sorted
    events are streamed, and only the state is kept, whatever the number of a job's events. Streams give, in update mode, the
    state of each job that had events, and drop the state of forgotten jobs; the last is that of the batch if a job's events
    arrive in order, and not later than DELAY after those of other jobs.
    """
    schema = f"job_id {events.schema['job_id'].dataType.simpleString()}, state string"
    fold = _folded(seconds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, job, begun = None, None, False
        for batch in batches:
            jobs, states_of, kind = [], [], batch["job_id"].type
            for k, ms, action in zip(batch["job_id"].to_pylist(), batch["ms"].to_pylist(), batch["action"].to_pylist(), strict=True):
                if not begun or k != key:
                    if begun:
                        jobs.append(key)
                        states_of.append(job[0])
                    key, job, begun = k, None, True
                job = fold(job, [(ms, action)])
            yield pa.RecordBatch.from_arrays([pa.array(jobs, kind), pa.array(states_of, pa.string())], ["job_id", "state"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([job[0]], pa.string())], ["job_id", "state"])

    # without an end, times are asked for nothing: any order of ts will do
    ms = F.unix_millis("ts") if seconds is not None or events.isStreaming else F.lit(0).cast("long")
    rows = events.select("job_id", "ts", "event_id", "action", ms.alias("ms"))
    if events.isStreaming:
        return states.expiring(rows.withWatermark("ts", DELAY), "job_id", states.Lifecycle(fold, ENDED, seconds), schema, "update")
    return rows.repartition("job_id").sortWithinPartitions("job_id", "ts", "event_id", "action").select("job_id", "action", "ms").mapInArrow(run, schema)


def evict(jobs: DataFrame, now: Column, seconds: int = KEPT, at: str = "finished_at") -> DataFrame:
    """jobs(status, finished_at) without those that ended more than `seconds` before `now`; jobs without an end stay."""
    old = F.col("status").isin(*ENDED) & (F.unix_micros(F.col(at).cast("timestamp")) < F.unix_micros(now.cast("timestamp")) - 1_000_000 * seconds)
    return jobs.where(~F.coalesce(old, F.lit(False)))


def progress_feed(snapshots: DataFrame, terminal: tuple[str, ...] = ("completed", "failed", "cancelled"), every: int = 15, most: int = 3600) -> DataFrame:
    """What followers of a job see: (job_id, t, event, event_id), t in seconds after the job's first snapshot.

    snapshots(job_id, ts, event_id, status, progress). A new status or progress is an event; every `every` seconds before
    the last snapshot there is a heartbeat; the feed is done at the first terminal status, or after `most` seconds.
    Streams give the same rows if a job's snapshots arrive in order.
    """
    if snapshots.isStreaming:
        return _stream_feed(snapshots, terminal, every, most)
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    t = F.unix_timestamp("ts") - F.unix_timestamp(F.min("ts").over(Window.partitionBy("job_id")))
    rows = snapshots.withColumn("t", t).withColumn("closing", F.col("status").isin(*terminal) | (F.col("t") > most))
    new_status, new_progress = (~F.col(c).eqNullSafe(F.lag(c).over(w)) | (F.row_number().over(w) == 1) for c in ("status", "progress"))
    rows = rows.withColumns({"kind": F.when(new_status, "status").when(new_progress, "progress"), "closed": F.sum(F.col("closing").cast("int")).over(w) - F.col("closing").cast("int")}).where("closed = 0")
    last = F.least("t", F.lit(most))
    seen = F.array_compact(F.array(F.when(F.col("t") <= most, F.col("kind")), F.when(F.col("closing"), "done")))
    events = rows.select("job_id", last.alias("t"), F.explode(seen).alias("event"), "event_id")
    ends = rows.groupBy("job_id").agg(F.max(last).alias("m")).where(F.col("m") > every)
    beats = ends.select("job_id", F.explode(F.sequence(F.lit(every).cast("long"), F.col("m") - 1, F.lit(every).cast("long"))).alias("t"), F.lit("heartbeat").alias("event"), F.lit(None).cast("long").alias("event_id"))
    return events.unionByName(beats)


def _stream_feed(snapshots: DataFrame, terminal: tuple[str, ...], every: int, most: int) -> DataFrame:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, at, status, progress, done = state.get if state.exists else (None, 0, None, None, False)
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ts, event_id, s, p in rows[["ts", "event_id", "status", "progress"]].itertuples(index=False):
            if done:
                break
            second = int(ts.timestamp() // 1)
            first = since is None
            since = second if first else since
            t = min(second - since, most)
            out += [(key[0], b, "heartbeat", None) for b in range((max(at - 1, 0) // every + 1) * every, t, every)]
            if second - since <= most and (first or s != status or p != progress):
                out.append((key[0], t, "status" if first or s != status else "progress", event_id))
            at, status, progress, done = t, s, p, s in terminal or second - since > most
            if done:
                out.append((key[0], t, "done", event_id))
        state.update((since, at, status, progress, done))
        yield pd.DataFrame({"job_id": [o[0] for o in out], "t": [o[1] for o in out], "event": [o[2] for o in out], "event_id": pd.array([o[3] for o in out], "Int64")})

    rows = snapshots.select("job_id", "ts", "event_id", "status", "progress").groupBy("job_id")
    kept = "since long, at long, status string, progress string, done boolean"
    return rows.applyInPandasWithState(step, "job_id long, t long, event string, event_id long", kept, "append", GroupStateTimeout.NoTimeout)


def ingest(pages: DataFrame, handle, checkpoint: str):
    """Micro-batches of pages through `handle(batch, id)`; takes what is there and stops."""
    return pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_listings(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Rows for store.merge_batch() of pages(page_id, url, html[, site_key, job_id]); selectors names those of title, price, area and images.

    Without a site_key the url's host is the partner. Of pages of one url the largest page_id wins there.
    """
    nodes = extract.page_nodes(pages)
    plain = {f: s for f, s in selectors.items() if f != "images"}
    values = extract.extract_direct(nodes, plain) if plain else pages.select("page_id")
    title, price, area = (F.col(c) if c in selectors else F.lit(None).cast("string") for c in ("title", "price", "area"))
    rows = pages.where("url IS NOT NULL").join(values, "page_id")
    if "images" in selectors:
        rows = rows.join(sections.images(nodes, pages.select("page_id", "url"), selectors["images"]).select("page_id", "images"), "page_id", "left")
    images = F.col("images") if "images" in selectors else F.lit(None).cast("array<string>")
    partner = F.col("site_key") if "site_key" in pages.columns else store.host(F.col("url"))
    job = F.col("job_id") if "job_id" in pages.columns else F.lit(None)
    return rows.select(
        F.col("url").alias("source_url"), partner.alias("source_partner"), C.clean_text(title).alias("title"), C.price_amount(price).cast("decimal(18,2)").alias("price_amount"), C.currency(price).alias("price_currency"),
        C.area(area).cast("double").alias("area_useful_m2"), images.alias("images"), job.cast("long").alias("scrape_job_id"), F.col("page_id").alias("ord"),
    )


def ingest_listings(pages: DataFrame, selectors: dict[str, str], path: str, checkpoint: str):
    """Pages taken in micro-batches through extraction, normalisation and merge into the listing table at `path` (store.py).

    A micro-batch that runs again after a failure changes nothing twice. A store belongs to one checkpoint.
    """

    def handle(batch: DataFrame, k: int) -> None:
        store.merge_batch(path, page_listings(batch, selectors), k)

    return ingest(pages, handle, checkpoint)
