"""GPS tracks: one accumulator for batch and stream.

A device's fixes are folded in order. A fix not newer than the last is dropped, which is the policy for
late data; a new segment or a gap of more than 30 s starts afresh. In batch that lets a long track be
cut into runs, so no task folds a whole device; the stream keeps the same state for each device.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import EARTH_M

GAP_MS, WORST_M, WORST_HEIGHT_M, FASTEST, SLOWEST, DEADBAND_M, STEP_M = 30_000, 50, 15, 12, 0.5, 3, 5
FIX = "device bigint, time_ms bigint, x double, y double, z double, accuracy double, alt_accuracy double, segment bigint"
STATS = "device bigint, distance double, moving_s double, gain double, points bigint"


def valid_fix(x: Column, y: Column, z: Column, time_ms: Column) -> Column:
    """Whether a fix has a usable place and time; not-a-number is none, a null height is allowed."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c)
    return ok(x) & ok(y) & (F.abs(x) <= 180) & (F.abs(y) <= 90) & (z.isNull() | ~F.isnan(z)) & F.coalesce(time_ms > 0, F.lit(False))


def metres(a, b) -> float:
    dy, dx = math.radians(b[2] - a[2]), math.radians(b[1] - a[1])
    h = math.sin(dy / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(dx / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, h)))


def _number(v):
    return None if v is None or v != v else float(v)


@dataclass
class Track:
    """Totals so far and what the next fix is measured against: (time, x, y, accuracy), a height, the last fix."""

    distance: float = 0.0
    moving_s: float = 0.0
    gain: float = 0.0
    points: int = 0
    last: tuple | None = None
    anchor: tuple | None = None
    height: float | None = field(default=None)

    def add(self, time_ms, x, y, z, accuracy, alt_accuracy, segment) -> bool:
        """Fold one fix in; False if it came too late."""
        if self.last and time_ms <= self.last[0]:
            return False
        fresh = self.last is None or self.last[1] != segment or time_ms - self.last[0] > GAP_MS
        self.last, self.points = (time_ms, segment), self.points + 1
        accuracy, alt_accuracy, z = _number(accuracy), _number(alt_accuracy), _number(z)
        if fresh:
            self.anchor = self.height = None
        if accuracy is None or not 0 <= accuracy <= WORST_M:
            self.anchor = self.height = None
            return True
        height = z if z is not None and alt_accuracy is not None and 0 <= alt_accuracy <= WORST_HEIGHT_M else None
        here = (time_ms, x, y, accuracy)
        if self.anchor is not None:
            seconds, way = (time_ms - self.anchor[0]) / 1000, metres(self.anchor, here)
            if seconds <= GAP_MS / 1000 and way / seconds <= FASTEST:
                if way < max(DEADBAND_M, (self.anchor[3] + accuracy) / 2) or way / seconds < SLOWEST:
                    return True  # standing still
                self.distance, self.moving_s, self.anchor = self.distance + way, self.moving_s + seconds, here
                if height is None or self.height is None:
                    self.height = height
                elif abs(height - self.height) >= STEP_M:
                    self.gain, self.height = self.gain + max(0.0, height - self.height), height
                return True
        self.anchor, self.height = here, height  # a first good fix, or a jump
        return True

    def fold(self, pdf: pd.DataFrame) -> Track:
        for r in pdf.itertuples(index=False):
            self.add(r.time_ms, r.x, r.y, r.z, r.accuracy, r.alt_accuracy, r.segment)
        return self


def _fixes(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select("device", "time_ms", "x", "y", "z", "accuracy", "alt_accuracy", "segment").filter(
        c("device").isNotNull() & c("segment").isNotNull() & valid_fix(c("x"), c("y"), c("z"), c("time_ms"))
    )


def track_stats(df: DataFrame) -> DataFrame:
    """Totals of each device's fixes, taken in order of time (equal times count once, the first by place)."""
    w = Window.partitionBy("device").orderBy("time_ms", "segment", "x", "y")
    before = F.lag(F.struct("time_ms", "segment")).over(w)
    new = before.isNull() | (before["segment"] != F.col("segment")) | (F.col("time_ms") - before["time_ms"] > GAP_MS)
    runs = _fixes(df).withColumn("new", new.cast("int")).withColumn("late", F.coalesce(before["time_ms"] == F.col("time_ms"), F.lit(False)))
    runs = runs.filter("not late").withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Track().fold(pdf.sort_values(["time_ms", "segment", "x", "y"], kind="stable"))
        return pd.DataFrame([(pdf["device"].iloc[0], t.distance, t.moving_s, t.gain, t.points)], columns=["device", "distance", "moving_s", "gain", "points"])

    parts = runs.groupBy("device", "run").applyInPandas(fold, STATS)
    return parts.groupBy("device").agg(*(F.sum(c).alias(c) for c in ("distance", "moving_s", "gain", "points")))


_STATE = "distance double, moving_s double, gain double, points bigint, last_ms bigint, last_segment bigint, anchor_ms bigint, anchor_x double, anchor_y double, anchor_accuracy double, height double"


def stream_track_stats(df: DataFrame) -> DataFrame:
    """Totals of each device after every micro-batch, over a streaming frame of fixes.

    A batch's fixes are sorted by time first; fixes older than what was folded already are dropped.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Track()
        if state.exists:
            d, m, g, n, lt, ls, at, ax, ay, aa, h = state.get
            t = Track(d, m, g, n, None if lt is None else (lt, ls), None if at is None else (at, ax, ay, aa), h)
        pdf = pd.concat(list(batches)).sort_values(["time_ms", "segment", "x", "y"], kind="stable")
        t.fold(pdf)
        last, anchor = t.last or (None, None), t.anchor or (None,) * 4
        state.update((t.distance, t.moving_s, t.gain, t.points, *last, *anchor, t.height))
        yield pd.DataFrame([(key[0], t.distance, t.moving_s, t.gain, t.points)], columns=["device", "distance", "moving_s", "gain", "points"])

    return _fixes(df).groupBy("device").applyInPandasWithState(step, STATS, _STATE, "update", GroupStateTimeout.NoTimeout)


def stream_minute_counts(df: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Requests of each role in each minute; what is later than the watermark is dropped with its window."""
    return df.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "role").agg(F.count("*").alias("n"))
