"""Rate limiting: admit an event unless its key had enough admitted ones lately.

Whether an event is admitted depends on the admitted ones before it, so events
of a key must be read in order, but not by one task.  The events are range
partitioned by (key, time), which cuts a frequent key into many partitions of
equal size.  Each partition is read as a stream of batches; only the
recently admitted times (at most ``limit`` of them) cross a partition border.
Partitions filled entirely by one key without a pause run again, all at once, from what the
one before ended with, until no entry changes: twice where traffic is below the limit now
and then, and at worst, under steady traffic above it, once per partition.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.plans.checkpoints import checkpoint

# The limit the service applies per client.
DEFAULT_LIMIT = 10
DEFAULT_WINDOW_SECONDS = 60
# Fixed value: the name under which clients without one are counted.
UNKNOWN_KEY = "unknown"


def admit(times: Sequence[int], recent: deque, limit: int, window: int) -> np.ndarray:
    """Admission of one key's events in time order; ``recent`` is carried along."""
    admitted = np.zeros(len(times), dtype=bool)
    if limit <= 0:
        return admitted
    i = 0
    while i < len(times):
        while recent and recent[0] < times[i] - window:
            recent.popleft()
        if len(recent) >= limit:
            # Nothing more is admitted until the oldest leaves the window.
            i = int(np.searchsorted(times, recent[0] + window, side="right"))
        else:
            admitted[i] = True
            recent.append(int(times[i]))
            i += 1
    return admitted


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal keys in sorted keys."""
    starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return zip(starts, starts[1:], strict=False)


class _Reader:
    """Reads the sorted batches of one partition and keeps the state of the current key."""

    def __init__(self, limit: int, window: int, entry: list[int]):
        self.limit, self.window = limit, window
        self.recent: deque = deque(entry)
        self.first_key = self.key = None
        self.first_time = self.part = self.last_time = None
        self.gap = False

    def read(self, batch: pd.DataFrame) -> np.ndarray:
        keys, times = batch["_key"].to_numpy(), batch["_t"].to_numpy()
        admitted = np.zeros(len(batch), dtype=bool)
        for start, end in _runs(keys):
            if self.first_key is None:
                self.first_key, self.first_time = keys[start], int(times[start])
                self.part = int(batch["_part"].iloc[0])
            elif keys[start] != self.key:
                self.recent = deque()
            if keys[start] == self.key and times[start] - self.last_time > self.window:
                self.gap = True
            if (np.diff(times[start:end]) > self.window).any():
                self.gap = True
            self.key, self.last_time = keys[start], int(times[end - 1])
            admitted[start:end] = admit(times[start:end], self.recent, self.limit, self.window)
        return admitted


def _summarize(limit: int, window: int, entries: dict[int, list[int]]):
    """One row per partition: its first and last key and the state it ends with."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None
        for batch in batches:
            if len(batch):
                reader = reader or _Reader(limit, window, entries.get(int(batch["_part"].iloc[0]), []))
                reader.read(batch)
        if reader is not None:
            yield pd.DataFrame(
                {
                    "part": [reader.part],
                    "first_key": [reader.first_key],
                    "last_key": [reader.key],
                    "first_time": [reader.first_time],
                    "recent": [list(reader.recent)],
                    "gap": [reader.gap],
                }
            )

    return run


def _decide(limit: int, window: int, entries: dict[int, list[int]]):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None
        for batch in batches:
            if len(batch):
                reader = reader or _Reader(limit, window, entries.get(int(batch["_part"].iloc[0]), []))
                yield batch.assign(admitted=reader.read(batch))

    return run


def _entry_states(ordered: DataFrame, limit: int, window: int) -> dict[int, list[int]]:
    """State each partition starts with; only partitions that start non-empty are listed."""
    schema = "part INT, first_key STRING, last_key STRING, first_time BIGINT, recent ARRAY<BIGINT>, gap BOOLEAN"
    slim = ordered.select("_part", "_key", "_t")

    def summaries(df: DataFrame, entries: dict[int, list[int]]) -> dict[int, T.Row]:
        return {r.part: r for r in df.mapInPandas(_summarize(limit, window, entries), schema).collect()}

    # One small row per partition comes back to the driver.
    known = summaries(slim, {})
    order = sorted(known)
    entries: dict[int, list[int]] = {part: [] for part in order}
    while True:
        changed: dict[int, list[int]] = {}
        for before, part in zip(order, order[1:], strict=False):
            row, previous = known[part], known[before]
            state = list(previous.recent) if previous.last_key == row.first_key else []
            state = [t for t in state if t >= row.first_time - window]
            if state != entries[part]:
                changed[part] = state
        entries.update(changed)
        # Behind a pause longer than the window nothing of the entry state is left.
        again = {p: s for p, s in changed.items() if known[p].first_key == known[p].last_key and not known[p].gap}
        if not again:
            return {part: state for part, state in entries.items() if state}
        # Every partition runs from the state the one before ended with last time.  Once no entry changes, all
        # are right, for the first one is; that is soon, where what a partition ends with does not depend on its entry.
        known.update(summaries(slim.filter(F.col("_part").isin(list(again))), again))


def micros(hits: DataFrame, ts: str) -> Column:
    """Microseconds of a time; of one without a zone by its own date and clock."""
    at = F.col(ts)
    if dict(hits.dtypes)[ts] != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    clock = F.hour(at) * 3600 + F.minute(at) * 60
    fraction = F.extract(F.lit("SECOND"), at) * 1_000_000
    return (F.unix_date(at.cast("date")).cast("long") * 86400 + clock) * 1_000_000 + fraction.cast("long")


def rate_limit(
    hits: DataFrame,
    limit: int = DEFAULT_LIMIT,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    key: str = "key",
    ts: str = "ts",
    tie_break: str = "event_id",
) -> DataFrame:
    """The hits with ``admitted``, per key in order of (ts, tie_break).

    Refused hits do not count against later ones; an admitted one exactly
    ``window_seconds`` old still does.  Hits without a key count under one name;
    hits without a time are left out.  Times without a zone are taken as they are.
    """
    window = window_seconds * 1_000_000
    order = ["_key", "_t", tie_break]
    prepared = hits.filter(F.col(ts).isNotNull()).withColumns(
        {"_key": F.coalesce(F.col(key).cast("string"), F.lit(UNKNOWN_KEY)), "_t": micros(hits, ts)}
    )
    ordered = checkpoint(
        prepared.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
    )
    entries = _entry_states(ordered, limit, window)
    schema = T.StructType([*ordered.schema.fields, T.StructField("admitted", T.BooleanType())])
    return ordered.mapInPandas(_decide(limit, window, entries), schema).drop("_key", "_t", "_part")
