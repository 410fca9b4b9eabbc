"""Decisions that depend on earlier decisions: admission by rate, throttling, and their streaming forms.

In batch, each key's events are split at pauses after which nothing of the past counts; a task then reads a run's events one
after another and remembers only what the rule needs (the last admissions), however many events a key has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quillstone.functions import constants as C
from quillstone.sources.library import ship
from quillstone.sources.tables import keep, running


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_runs(events: DataFrame, key: str, us: str, id_col: str, gap: int) -> DataFrame:
    """events with run: the time at which the run of events began that this one belongs to; a run ends where the next event
    of the key comes ``gap`` microseconds later or more.

    Events are dealt by ranges of (key, time, id), so a key that holds a third of all rows lies in many
    partitions; what a partition must know of those before it is one row for each.
    """
    order = [F.col(key), F.col(us), F.col(id_col)]
    part = keep(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.shiftright(F.monotonically_increasing_id(), 33)))
    ends = part.groupBy("__p").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(us).alias("t")), "__at").alias("end"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    ends = F.broadcast(ends.select("__p", F.lag("end").over(Window.orderBy("__p")).alias("__end")))
    here = Window.partitionBy("__p").orderBy("__at")
    last = F.coalesce(F.lag(F.struct(F.col(key).alias("k"), F.col(us).alias("t"))).over(here), F.col("__end"))
    rows = part.join(ends, "__p").withColumn("__last", last)
    begins = F.col("__last").isNull() | ~F.col("__last.k").eqNullSafe(F.col(key)) | (F.col(us) - F.col("__last.t") >= gap)
    rows = keep(rows.withColumn("__begin", F.when(begins, F.col(us))).drop("__end", "__last"))
    starts = rows.groupBy("__p").agg(F.max_by("__begin", F.when(F.col("__begin").isNotNull(), F.col("__at"))).alias("start"))
    carried = F.broadcast(starts.select("__p", F.last("start", ignorenulls=True).over(before).alias("__start")))
    own = F.last("__begin", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(carried, "__p").withColumn("run", F.coalesce(own, F.col("__start"))).drop("__p", "__at", "__begin", "__start")


def _scan(events: DataFrame, key: str, ts: str, id_col: str, gap: int, decide, forced: str | None = None) -> DataFrame:
    """Decisions by key in the order of time; after a pause of ``gap`` a key's state is empty, so each run of events is
    decided by itself and runs are dealt over all tasks."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id_col)}
    force = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    dealt = with_runs(events.select(F.col(key), F.col(id_col), _micros(ts).alias("us"), force.alias("force")), key, "us", id_col, gap)
    sorted_ = dealt.select(key, id_col, "us", "run", "force").repartition(F.col(key), F.col("run")).sortWithinPartitions(key, "run", "us", id_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = deque(), None
        for batch in batches:
            out = []
            for k, us, run, force in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if last != (k, run):
                    state, last = deque(), (k, run)
                out.append(decide(state, us, force))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w == 0 for w in out], pa.bool_()), pa.array(out, pa.int64())], [key, id_col, "admitted", "wait_us"])

    return sorted_.mapInArrow(scan, f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, admitted boolean, wait_us long")


def admit(events: DataFrame, key: str, ts: str, id_col: str, limit: int = C.RATE_LIMIT, window_s: int = C.RATE_WINDOW_S) -> DataFrame:
    """At most ``limit`` admissions of a key within any trailing window; refused events don't count. Of refused ones
    retry_after_s tells the full seconds until the oldest admission leaves the window, plus one."""
    size = window_s * 1_000_000

    def decide(state: deque, us: int, force: bool) -> int:
        while state and state[0] <= us - size:
            state.popleft()
        if len(state) >= limit:
            return max(1, state[0] + size - us)
        state.append(us)
        return 0

    out = _scan(events, key, ts, id_col, size, decide)
    return out.withColumn("retry_after_s", F.when(~F.col("admitted"), F.floor(F.col("wait_us") / 1_000_000) + 1)).drop("wait_us")


def throttle(events: DataFrame, key: str, ts: str, id_col: str, gap_s: float = 0.1, final: str | None = None) -> DataFrame:
    """An event passes if the last one that passed lies at least the gap before it; one whose ``final`` column is true
    passes always."""
    size = int(gap_s * 1_000_000)

    def decide(state: deque, us: int, force: bool) -> int:
        if state and us - state[0] < size and not force:
            return max(1, state[0] + size - us)
        state.clear()
        state.append(us)
        return 0

    return _scan(events, key, ts, id_col, size, decide, final).drop("wait_us")


def offered(events: DataFrame, key: str, ts: str, window_s: int = C.RATE_WINDOW_S) -> DataFrame:
    """events with n_offered: events of the key within the trailing window, each itself and those of its time included.

    Every event counts those up to its time less those before its window. Both are running counts at two marks
    that are sorted in among the events, so a key with any share of the rows lies in many partitions.
    """
    named = keep(events.withColumn("__row", F.monotonically_increasing_id()).withColumn("__us", _micros(ts)))
    marks = F.array(*(F.struct((F.col("__us") - before).alias("us"), F.lit(kind).alias("kind")) for before, kind in ((window_s * 1_000_000, 0), (0, 1), (0, 2))))
    each = named.where("__us IS NOT NULL").select(F.col(key).alias("k"), "__row", F.explode(marks).alias("x")).select("k", "__row", "x.us", "x.kind")
    counted = running(each, "k", ["us", "kind", "__row"], {"n": (F.col("kind") == 1).cast("long")}).where("kind <> 1")
    n = counted.groupBy("__row").agg(F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(-F.col("n"))).alias("n_offered"))
    return named.join(n, "__row", "left").drop("__row", "__us")


def debounce(events: DataFrame, key: str, ts: str, id_col: str, gap_s: float) -> DataFrame:
    """The last event of every run of events that follow one another within the gap. Runs are found by with_runs(), and each
    is summed up to its last event before anything of it is shuffled."""
    gap = int(gap_s * 1_000_000)
    if gap <= 0:
        return events
    runs = with_runs(events.withColumn("__us", _micros(ts)), key, "__us", id_col, gap)
    last = runs.groupBy(key, "run").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in events.columns)), F.struct("__us", id_col)).alias("last"))
    return last.select("last.*")


def windowed_counts(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window under a watermark; works on streams and tables."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", gap: str = "30 minutes", by: str = "user_id") -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n")


def admit_stream(stream: DataFrame, key: str, ts: str, id_col: str, limit: int = C.RATE_LIMIT, window_s: int = C.RATE_WINDOW_S, late: str = "1 minute") -> DataFrame:
    """admit() over a stream: the admissions of the trailing window are the state of a key, at most ``limit`` times. The
    state is dropped once the watermark, ``late`` behind the newest event, has passed its window."""
    size = window_s * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = deque(state.get[0] if state.exists else ())
        parts = [(b[ts].astype("datetime64[us]").astype("int64").to_numpy(), b[id_col].to_numpy()) for b in batches]  # two numbers a row
        times, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, times))
        out = []
        for us in times[order].tolist():
            while taken and taken[0] <= us - size:
                taken.popleft()
            out.append(len(taken) < limit)
            if out[-1]:
                taken.append(us)
        state.update((list(taken),))
        state.setTimeoutTimestamp(max(int(times.max()) // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], id_col: ids[order], "admitted": out})

    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, id_col)}
    marked = stream.withWatermark(ts, late)
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, admitted boolean", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


class Ordered(StatefulProcessor):
    """Events of a key wait in its state until the watermark says that none before them can come; then they are taken in the
    order of time, however the stream dealt them. ``wait_us`` is how long after an event's time that has to be so."""

    def __init__(self, key: str, ts: str, id_col: str, kinds: dict[str, str], wait_us: int, forced: str | None = None):
        self.key, self.ts, self.id_col, self.kinds, self.wait_us, self.forced = key, ts, id_col, kinds, wait_us, forced

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"us long, id {self.kinds[self.id_col]}, force boolean")
        self.last = handle.getValueState("last", "us long")

    def _due(self, us: int) -> int:
        """The watermark in milliseconds at which an event is taken."""
        return -((-us - self.wait_us) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for b in rows:
            us = b[self.ts].astype("datetime64[us]").astype("int64")
            force = b[self.forced].fillna(False).astype(bool) if self.forced else [False] * len(b)
            new += zip(us.tolist(), b[self.id_col].tolist(), force, strict=True)
        self.pending.appendList(new)
        for due in {self._due(us) for us, _, _ in new}:
            self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(x) for x in self.pending.get()) if self.pending.exists() else []
        due = [x for x in waiting if self._due(x[0]) <= now]
        rest = waiting[len(due) :]
        if due:
            yield self.take(key, due, rest)
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
        elif not waiting:
            self.settled(now)

    def take(self, key: tuple, due: list[tuple], rest: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def settled(self, now: int) -> None:
        """Called by a timer when nothing waits."""

    def close(self) -> None:
        pass


class Throttled(Ordered):
    def __init__(self, *args, gap_us: int, **more):
        super().__init__(*args, **more)
        self.gap_us = gap_us

    def take(self, key: tuple, due: list[tuple], rest: list[tuple]) -> pd.DataFrame:
        last = self.last.get()[0] if self.last.exists() else None
        passed = []
        for us, _, force in due:
            passed.append(force or last is None or us - last >= self.gap_us)
            last = us if passed[-1] else last
        self.last.update((last,))
        self.handle.registerTimer(-((-last - self.gap_us) // 1000))  # from then on the key needs no state
        return pd.DataFrame({self.key: key[0], self.id_col: [i for _, i, _ in due], "admitted": passed})

    def settled(self, now: int) -> None:
        if self.last.exists() and self.last.get()[0] + self.gap_us <= now * 1000:
            self.last.clear()


class Debounced(Ordered):
    def take(self, key: tuple, due: list[tuple], rest: list[tuple]) -> pd.DataFrame:
        after = [*due[1:], *rest[:1]]
        out = [x for i, x in enumerate(due) if i >= len(after) or after[i][0] - x[0] >= self.wait_us]
        return pd.DataFrame({self.key: key[0], self.id_col: [i for _, i, _ in out], self.ts: pd.to_datetime([us for us, _, _ in out], unit="us")})


def _ordered_stream(stream: DataFrame, processor: Ordered, key: str, ts: str, late: str, out: str) -> DataFrame:
    ship(stream.sparkSession)
    return stream.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")


def _kinds(stream: DataFrame, *columns: str) -> dict[str, str]:
    return {c: stream.schema[c].dataType.simpleString() for c in columns}


def throttle_stream(stream: DataFrame, key: str, ts: str, id_col: str, gap_s: float = 0.1, final: str | None = None, late: str = "1 minute") -> DataFrame:
    """throttle() over a stream: key, id, admitted, once the watermark has passed an event, so events may come in any order
    within ``late``. A key's state is its waiting events and the last one that passed, and goes when that is a
    gap ago. Needs the RocksDB state store."""
    kinds = _kinds(stream, key, id_col)
    rule = Throttled(key, ts, id_col, kinds, 0, final, gap_us=int(gap_s * 1_000_000))
    return _ordered_stream(stream, rule, key, ts, late, f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, admitted boolean")


def debounce_stream(stream: DataFrame, key: str, ts: str, id_col: str, gap_s: float, late: str = "1 minute") -> DataFrame:
    """debounce() over a stream: key, id and time of the last event of every run, as soon as the watermark shows that the
    gap after it stays empty. A key's state is what came within the gap and ``late``. Needs the RocksDB state store."""
    kinds = _kinds(stream, key, id_col, ts)
    rule = Debounced(key, ts, id_col, kinds, int(gap_s * 1_000_000))
    return _ordered_stream(stream, rule, key, ts, late, f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, `{ts}` {kinds[ts]}")
