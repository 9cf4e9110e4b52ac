"""Streaming jobs.

Each job reads new files, writes its output below ``folder`` and keeps its
stream checkpoint there.  Output and state of a micro-batch go to a path named
by the batch number and are overwritten if the batch is repeated, so a restart
neither loses nor doubles rows.  State that outlives a batch is a table joined
with the skew-safe batch operators, so a frequent key costs no single task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from offerloom.operators.dedupe import OFFER_KEY, URL_KEY
from offerloom.operators.extract import extract_products
from offerloom.operators.ratelimit import (
    DEFAULT_LIMIT,
    DEFAULT_WINDOW_SECONDS,
    UNKNOWN_KEY,
    admit,
    micros,
    rate_limit,
)
from offerloom.streaming import packing

# All that is there, then stop; a job may be given another one, such as {"processingTime": "1 minute"}.
TRIGGER = {"availableNow": True}

# How long the keys kept of a job are remembered after it kept its last row under them.
JOB_TTL_SECONDS = 24 * 3600
# Keys of a keyed rate limit are grouped in as many classes of their hash.
KEY_CLASSES = 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run_batches(
    stream: DataFrame,
    folder: str,
    body: Callable[[DataFrame, int], None],
    trigger: dict | None = None,
    mode: str = "append",
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or TRIGGER))
        .foreachBatch(body)
        .start()
    )


def _batch_path(folder: str, name: str, batch_id: int) -> str:
    return f"{folder}/{name}/batch={batch_id}"


def read_batches(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All rows written by the batches of a job, with their batch number."""
    return spark.read.parquet(f"{folder}/{name}")


def stream_extract(pages: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """New pages to products in ``folder``/products; stateless, exactly once by the file sink."""
    return (
        extract_products(pages)
        .writeStream.format("parquet")
        .option("path", f"{folder}/products")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or TRIGGER))
        .start()
    )


class _KeepFirst(StatefulProcessor):
    """The keys kept of one job, in two lists; each entry leaves ``ttl`` milliseconds after it was written.

    Lists are read and extended in one call per batch, where maps would need one per key.  Rows come and go packed.
    """

    def __init__(self, job: str, order: list[str], first: int, second: int, ttl: int | None):
        self.job, self.order, self.widths, self.ttl = job, order, (first, second), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        def keys(name: str, width: int):
            names = ", ".join(f"k{i} string" for i in range(width))
            return handle.getListState(name, names, self.ttl)

        self.lists = [keys("first", self.widths[0]), keys("second", self.widths[1])]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        table = packing.from_bytes(row["_rows"] for row in rows)
        in_order = [(c, "ascending") for c in self.order]
        table = table.take(pc.sort_indices(table, sort_keys=in_order, null_placement="at_start"))
        names = [f"_key{i}" for i in range(sum(self.widths))]
        # Of the rows of one pair of keys only the first can be kept.
        pair = np.zeros(len(table), dtype=np.int64)
        for name in names:
            codes = packing.codes_of(table[name])
            pair = np.unique(pair * (codes.max() + 1) + codes, return_inverse=True)[1]
        firsts = np.sort(np.unique(pair, return_index=True)[1])
        open_rows = table.select(names).take(firsts).to_pydict()
        first, kept_at = self.widths[0], []
        seen, new = [{tuple(k) for k in known.get()} for known in self.lists], ([], [])
        for at, keys in zip(firsts.tolist(), zip(*[open_rows[n] for n in names], strict=True), strict=True):
            own = [keys[:first], keys[first:]]
            if own[0] not in seen[0] and own[1] not in seen[1]:
                for kept, added, name in zip(seen, new, own, strict=True):
                    kept.add(name)
                    added.append(name)
                kept_at.append(at)
        for known, added in zip(self.lists, new, strict=True):
            if added:
                known.appendList(added)
        if kept_at:
            yield packing.packed_row(table.drop_columns(names).take(kept_at))

    def close(self) -> None:
        pass


@contextmanager
def _keyed_state(spark: SparkSession, empty_batches: bool = False) -> Iterator[None]:
    """Settings of streams with keyed state; a query keeps those it was started with.

    Without batches that have no rows, a query over what is there ends; entries past their time are
    left out of sight at once and removed with the next rows.  Timers of event time need such
    batches, and end with the watermark.
    """
    settings = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower(),
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def stream_dedupe(
    rows: DataFrame,
    folder: str,
    order: list[str],
    first: list[str] | None = None,
    second: list[str] | None = None,
    job: str = "job_id",
    trigger: dict | None = None,
    ttl_seconds: int | None = JOB_TTL_SECONDS,
) -> StreamingQuery:
    """Keep-first by two keys per job across batches, into ``folder``/kept.

    The rows of a batch are read in ``order``.  The keys kept of a job are keyed state that expires
    ``ttl_seconds`` after they were written (never if None), so that jobs long finished take no
    room.  A job's new rows meet in one task, packed: a request has at most 200 URLs.
    """
    first, second = first or OFFER_KEY, second or URL_KEY
    keys = {f"_key{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate([*first, *second])}
    ttl = ttl_seconds * 1000 if ttl_seconds is not None else None
    processor = _KeepFirst(job, order, len(first), len(second), ttl)
    packed = packing.pack(rows.withColumns(keys), job)
    kept = packing.unpack(packed.groupBy(job).transformWithState(processor, packing.PACKED, "Append", "ProcessingTime"), rows.schema)
    with _keyed_state(rows.sparkSession):
        return (
            kept.writeStream.format("parquet")
            .option("path", f"{folder}/kept")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or TRIGGER))
            .start()
        )


def stream_rate_limit(
    hits: DataFrame,
    folder: str,
    limit: int = DEFAULT_LIMIT,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    key: str = "key",
    ts: str = "ts",
    tie_break: str = "event_id",
    lateness_seconds: int = 0,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Rate limiting across batches, into ``folder``/decided.

    A hit is decided once one ``lateness_seconds`` newer was seen; until then it
    is held with the state, so hits that arrive out of order by less are put in
    order.  Older ones than that go to ``folder``/late.  The state proper are the
    last ``limit`` admitted hits of each key inside the window; read again in
    front of the new ones they give the same state.
    """
    columns = hits.columns

    def literal(value) -> Column:
        # A time without a zone must not pass through the zone of the session.
        naive = dict(hits.dtypes)[ts] == "timestamp_ntz" and value is not None
        return F.lit(value.isoformat()).cast("timestamp_ntz") if naive else F.lit(value)

    def seconds(n: int) -> Column:
        return F.make_dt_interval(secs=F.lit(n))

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Every batch leaves a state, so all but the first one have one before them.
        state = spark.read.parquet(_batch_path(folder, "state", batch_id - 1)) if batch_id else None
        waiting = batch.withColumn("_old", F.lit(False))
        marks = batch.agg((F.max(ts) - seconds(lateness_seconds)).alias("_settled"))
        if state is not None:
            settled = state.agg(F.max("_settled")).first()[0]
            if settled is not None:
                late = F.col(ts) < literal(settled)
                batch.filter(late).write.mode("overwrite").parquet(_batch_path(folder, "late", batch_id))
                waiting = waiting.filter(~late)
            carried = state.filter(F.col(ts).isNotNull()).select(*columns, (~F.col("_pending")).alias("_old"))
            waiting = waiting.unionByName(carried)
            marks = marks.unionByName(state.select("_settled")).agg(F.max("_settled").alias("_settled"))
        settled = literal(marks.first()[0])
        decided = rate_limit(waiting.filter(F.col(ts) <= settled), limit, window_seconds, key, ts, tie_break)
        decided.filter(~F.col("_old")).drop("_old").write.mode("overwrite").parquet(
            _batch_path(folder, "decided", batch_id)
        )
        recent = decided.filter(F.col("admitted") & (F.col(ts) >= settled - seconds(window_seconds))).select(*columns)
        last = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie_break))
        kept = recent.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= limit).drop("_n")
        pending = waiting.filter(F.col(ts) > settled).select(*columns)
        rows = kept.withColumn("_pending", F.lit(False)).unionByName(pending.withColumn("_pending", F.lit(True)))
        rows.unionByName(marks, allowMissingColumns=True).write.mode("overwrite").parquet(
            _batch_path(folder, "state", batch_id)
        )

    return _run_batches(hits, folder, body, trigger)


class _AdmitInOrder(StatefulProcessor):
    """Hits of the keys of one class: those not yet decided as a list, and per key the times last admitted.

    A timer is set for the oldest hit that waits; when the watermark has passed it, all hits the
    watermark has passed are decided in order.  A timer also clears the times of a key once the last
    of them has left the window and nothing of it waits.  Hits come, wait and go packed.
    """

    def __init__(self, names: list[str], tie_break: str, limit: int, window: int):
        self.names, self.tie_break, self.limit, self.window = names, tie_break, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", packing.PACKED)
        self.known = handle.getValueState("known", "keys binary, timer bigint")

    def _set_timer(self, old: int | None, at: int | None) -> None:
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
            if at is not None:
                self.handle.registerTimer(at)

    def _out(self, hits: pa.Table, admitted: np.ndarray | None) -> Row:
        none = pa.nulls(len(hits), pa.bool_())
        verdict = none if admitted is None else pa.array(admitted)
        late = pa.array(np.full(len(hits), admitted is None))
        return packing.packed_row(hits.select(self.names).append_column("admitted", verdict).append_column("late", late))

    def _state(self) -> tuple[dict[str, tuple[list[int], int]], int | None]:
        """Per key the times last admitted and that of its last decided hit; the timer."""
        if not self.known.exists():
            return {}, None
        keys, timer = self.known.get()
        held = packing.from_bytes([keys]).to_pydict()
        return {k: (r, n) for k, r, n in zip(held["key"], held["recent"], held["last"], strict=True)}, timer

    def _update(self, keys: dict[str, tuple[list[int], int]], timer: int) -> None:
        recent, last = [r for r, _ in keys.values()], [n for _, n in keys.values()]
        arrays = [pa.array(keys, pa.string()), pa.array(recent, pa.list_(pa.int64())), pa.array(last, pa.int64())]
        self.known.update((packing.to_bytes(pa.table(arrays, ["key", "recent", "last"])), timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        keys, timer = self._state()
        hits = packing.from_bytes(row["_rows"] for row in rows)
        times = hits["_t"].to_numpy()
        late = (times // 1000 < mark - 1) if mark > 0 else np.zeros(len(times), dtype=bool)
        # Few hits are older than what was decided of any key without the watermark having passed them.
        newest = max((last for _, last in keys.values()), default=None)
        if newest is not None:
            for i in np.flatnonzero(~late & (times < newest)).tolist():
                known = keys.get(hits["_key"][i].as_py())
                late[i] = known is not None and times[i] < known[1]
        if late.any():
            yield self._out(hits.filter(pa.array(late)), None)
        if not late.all():
            self.waiting.appendValue((packing.to_bytes(hits.filter(pa.array(~late))),))
            oldest = int(times[~late].min()) // 1000
            # Of a timer for clearing the state and one for a hit the earlier one decides what is due.
            at = oldest if timer is None else min(timer, oldest)
            self._set_timer(timer, at)
            self._update(keys, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        keys, _ = self._state()
        ends = []
        if self.waiting.exists():
            hits = packing.from_bytes(value for (value,) in self.waiting.get())
            is_due = hits["_t"].to_numpy() // 1000 < mark
            due, rest = hits.filter(pa.array(is_due)), hits.filter(pa.array(~is_due))
            if len(due):
                yield self._out(*self._decide(due, keys))
                self.waiting.put([(packing.to_bytes(rest),)]) if len(rest) else self.waiting.clear()
            if len(rest):
                ends.append(pc.min(rest["_t"]).as_py() // 1000)
        for name, (recent, last) in list(keys.items()):
            recent = [t for t in recent if t // 1000 >= mark - self.window // 1000 - 1]
            if recent:
                keys[name] = recent, last
                ends.append((recent[-1] + self.window) // 1000 + 1)
            else:
                del keys[name]
        # The timer that called is gone; another one is set for what comes next.
        if ends:
            self.handle.registerTimer(min(ends))
            self._update(keys, min(ends))
        else:
            self.known.clear()

    def _decide(self, due: pa.Table, keys: dict[str, tuple[list[int], int]]) -> tuple[pa.Table, np.ndarray]:
        """The hits in order by key with whether they are admitted; ``keys`` are brought up to date."""
        order = [(c, "ascending") for c in ("_key", "_t", self.tie_break)]
        due = due.take(pc.sort_indices(due, sort_keys=order, null_placement="at_start"))
        times, names = due["_t"].to_numpy(), due["_key"]
        admitted = np.zeros(len(due), dtype=bool)
        for start, end in packing.runs(packing.codes_of(names)):
            name = names[start].as_py()
            recent = deque(keys[name][0] if name in keys else ())
            admitted[start:end] = admit(times[start:end], recent, self.limit, self.window)
            keys[name] = list(recent), int(times[end - 1])
        return due, admitted

    def close(self) -> None:
        pass


def stream_rate_limit_keyed(
    hits: DataFrame,
    folder: str,
    limit: int = DEFAULT_LIMIT,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    key: str = "key",
    ts: str = "ts",
    tie_break: str = "event_id",
    lateness_seconds: int = 0,
    trigger: dict | None = None,
    classes: int = KEY_CLASSES,
) -> StreamingQuery:
    """Rate limiting as keyed state under a watermark, into ``folder``/hits with ``admitted`` and ``late``.

    The watermark follows the newest hit by ``lateness_seconds``, in milliseconds.  A hit waits
    until the watermark has passed it, so hits out of order by less are decided in order; one the
    watermark had passed before it came is written as ``late``, undecided.  The state of a key goes
    when its last admitted hit has left the window.  Hits without a time are left out.

    The keys of a class of their hashes share the calls of the state, of which a hit would need
    several otherwise; with many more keys or hits give more ``classes``, the same for all runs of a
    stream.  All hits of a key meet in one task; where one key holds much of the traffic,
    ``stream_rate_limit`` spreads it.
    """
    names = hits.columns
    prepared = (
        hits.filter(F.col(ts).isNotNull())
        .withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(UNKNOWN_KEY)))
        .withColumn("_t", micros(hits, ts))
        # A timer fires when the watermark is past it, and the newest hit is to be decided as well.
        .withColumn("_at", F.timestamp_micros(F.col("_t") + 1000))
        .withWatermark("_at", f"{lateness_seconds} seconds")
        # Late hits are set aside below; a column with the mark would have Spark drop them.
        .drop("_at")
    )
    out = T.StructType(
        [*hits.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("late", T.BooleanType())]
    )
    processor = _AdmitInOrder(names, tie_break, limit, window_seconds * 1_000_000)
    classed = prepared.withColumn("_class", F.pmod(F.xxhash64("_key"), F.lit(classes)))
    decided = packing.pack(classed, "_class").groupBy("_class").transformWithState(processor, packing.PACKED, "Append", "EventTime")
    with _keyed_state(hits.sparkSession, empty_batches=True):
        return (
            packing.unpack(decided, out)
            .writeStream.format("parquet")
            .option("path", f"{folder}/hits")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or TRIGGER))
            .start()
        )


COUNTERS = ["total_candidate_urls", "processed_urls", "found_products", "errors"]
RUN_TOTALS = "run_totals"


def _counters() -> list[Column]:
    def number(flag: str) -> Column:
        return F.count_if(F.coalesce(F.col(flag), F.lit(False)))

    counted = [F.count("*"), number("processed"), number("found"), number("error")]
    return [count.alias(name) for count, name in zip(counted, COUNTERS, strict=True)]


def stream_progress(
    items: DataFrame, folder: str, trigger: dict | None = None, ttl_seconds: int = JOB_TTL_SECONDS
) -> StreamingQuery:
    """Running counters per job from items(job_id, processed, found, error), into ``folder``/progress.

    The counters are a streaming aggregation in update mode, so a job with much
    of the input is counted where its items are; each batch writes what it
    changed.  A job is counted anew in every period of ``ttl_seconds``, by the
    time of the batch, and the watermark removes the state of a period
    ``ttl_seconds`` after its end: jobs that are over take no room, and one that
    goes on later loses nothing, as ``latest_progress`` adds its periods.  The
    counters over all items of a batch are observed as it runs (``run_totals``).
    """
    seen = items.observe(RUN_TOTALS, *_counters()).withColumn("_seen", F.current_timestamp())
    period = F.window("_seen", f"{ttl_seconds} seconds").alias("_period")
    counters = (
        seen.withWatermark("_seen", f"{ttl_seconds} seconds")
        .groupBy("job_id", period)
        .agg(*_counters())
        .select("job_id", F.col("_period.start").alias("period"), *COUNTERS)
    )

    def body(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(folder, "progress", batch_id))

    return _run_batches(counters, folder, body, trigger, mode="update")


def latest_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The newest counters of each job."""
    written = read_batches(spark, folder, "progress")
    newest = written.groupBy("job_id", "period").agg(F.max_by(F.struct(*COUNTERS), "batch").alias("_last"))
    return newest.groupBy("job_id").agg(*[F.sum(f"_last.{c}").alias(c) for c in COUNTERS])


def run_totals(query: StreamingQuery) -> dict[str, int]:
    """The counters over all items a run of ``stream_progress`` has read since it was started.

    They cover the batches a query reports on, the last ``spark.sql.streaming.numRecentProgressUpdates``.
    """
    totals = dict.fromkeys(COUNTERS, 0)
    for progress in query.recentProgress:
        observed = progress["observedMetrics"].get(RUN_TOTALS)
        if observed is not None:
            for name in COUNTERS:
                totals[name] += observed[name]
    return totals
