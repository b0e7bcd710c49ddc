"""Streams of beats: bins with watermarks, and ramps as they end, in whatever order beats come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship


def tumbling_bins(events: DataFrame, width: str = "30 seconds", late: str = "1 minute", value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean and SD per bin of event time; bins close once the watermark has passed them."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = stamped.groupBy(F.window("ts", width), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.select(F.col("window.start").alias("bin_start"), *keys, "n", "mean", "sd")


RAMP = "subject string, phase string, direction string, start_t double, end_t double, n_beats long, slope double"
#: The beat before, and the ramp that is open: where it began, its number of beats and the sums of its beats less the first one.
OPEN = "phase string, t double, sbp double, rri double, direction string, start double, x0 double, y0 double, n long, sx double, sy double, sxx double, sxy double"
WAITING = "t double, sbp double, rri double"


class Ramps(StatefulProcessor):
    """Beats of one subject wait until the watermark has passed them and are then taken in order of time.

    A subject's state is the beats that wait, as many as the allowed lateness holds, one beat and seven numbers. A ramp is emitted by the
    beat that ends it, by the first beat of another phase, or by a timer at its phase's end.
    """

    def __init__(self, phases: list[tuple[str, float, float]], least_step: float, least_beats: int):
        self.phases, self.least_step, self.least_beats = phases, least_step, least_beats

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()]
        for pdf in rows:
            held += pdf[["t", "sbp", "rri"]].itertuples(index=False, name=None)
        yield self._taken(key, held, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._taken(key, [tuple(r) for r in self.waiting.get()], timerValues)

    def close(self) -> None:
        pass

    def _taken(self, key, held: list[tuple], timers) -> pd.DataFrame:
        now = timers.getCurrentWatermarkInMs() / 1000
        state = list(self.open.get()) if self.open.exists() else [None] * len(OPEN.split(", "))
        ready, out = sorted(r for r in held if r[0] <= now), []
        held = [r for r in held if r[0] > now]
        for t, sbp, rri in ready:
            phase = next((p for p in self.phases if p[1] <= t < p[2]), None)
            if phase is None or (state[1] is not None and t < state[1]):
                continue
            if state[0] is not None and phase[0] != state[0]:
                out += self._closed(key, state)
                state = [None] * len(state)
            state = self._step(key, state, phase[0], t, sbp, rri, out)
        ends = {p[0]: p[2] for p in self.phases}
        if state[0] is not None and ends[state[0]] <= now:
            out += self._closed(key, state)
            state = [None] * len(state)
        if state[0] is None:
            self.open.clear()
        else:
            self.open.update(tuple(state))
            self.handle.registerTimer(int(ends[state[0]] * 1000) + 1)
        self.waiting.clear()
        if held:
            self.waiting.put(held)
            self.handle.registerTimer(int(max(r[0] for r in held) * 1000) + 1)
        return pd.DataFrame(out, columns=[f.split()[0] for f in RAMP.split(", ")])

    def _step(self, key, s: list, phase: str, t: float, sbp: float, rri: float, out: list[tuple]) -> list:
        _, lt, ls, lr, direction, start, x0, y0, n, sx, sy, sxx, sxy = s
        d = None if ls is None else sbp - ls
        way = None if d is None or not abs(d) >= self.least_step or d == 0 else "up" if d > 0 else "down"
        if direction and way != direction:
            out += self._closed(key, s)
            direction = None
        if way and not direction:
            direction, start, x0, y0, n, sx, sy, sxx, sxy = way, lt, ls, lr, 1, 0.0, 0.0, 0.0, 0.0
        if way:
            x, y = sbp - x0, rri - y0
            n, sx, sy, sxx, sxy = n + 1, sx + x, sy + y, sxx + x * x, sxy + x * y
        return [phase, t, sbp, rri, direction, start, x0, y0, n, sx, sy, sxx, sxy]

    def _closed(self, key, s: list) -> list[tuple]:
        phase, t, _, _, direction, start, _, _, n, sx, sy, sxx, sxy = s
        if not direction or n < self.least_beats:
            return []
        spread = sxx - sx * sx / n
        return [(key[0], phase, direction, start, t, n, (sxy - sx * sy / n) / spread if spread > 0 else None)]


def online_ramps(beats: DataFrame, phases: list[tuple[str, float, float]] | None = None, late: str = "1 minute", least_step: float = 1.0, least_beats: int = 3) -> DataFrame:
    """Ramps of a stream of beats(subject, t in seconds, sbp, rri) within phases (name, from, before), as in a batch of all its beats.

    Beats may come in any order as long as none is later than ``late`` behind the latest; what is later is dropped. A ramp
    is emitted once the watermark has passed the beat, or the end of the phase, that ends it. Beats of no phase are
    left out; without ``phases`` all time is one, which never ends. The state store has to be RocksDB (see ``use_rocksdb``).
    """
    phases = phases or [("all", float("-inf"), 253_402_300_799.0)]
    ship(beats.sparkSession)
    rows = beats.select("subject", F.col("t").cast("double").alias("t"), F.col("sbp").cast("double").alias("sbp"), F.col("rri").cast("double").alias("rri"))
    rows = rows.where("subject is not null and t is not null and sbp is not null").withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return rows.groupBy("subject").transformWithStateInPandas(Ramps(phases, least_step, least_beats), RAMP, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """The store that states with timers need, for the streams that the session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
