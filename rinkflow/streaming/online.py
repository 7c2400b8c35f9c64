"""Row context and the filter on streams: keyed state, event-time timers, and a watermark that decides what is final.

Both operators take rows in any order of arrival inside the watermark's delay. They keep rows that may still get a predecessor, and
write a row once the watermark has passed its time, with the values that the batch operators (``operators.sequences``, ``plans.kalman``)
give on all rows that were not too late. Rows behind the watermark are dropped by Spark. State lies in RocksDB and follows the query's
checkpoint, so a query that is started again goes on where it stopped.

Within a key, ``order`` and ``axis`` must not fall as the event time rises; rows of one time may have any. Rows without a time or
order take no part. Rows travel through the state as JSON text, so any column that JSON can hold keeps its type and its nulls.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rinkflow.functions.numeric import obs_noise
from rinkflow.operators.sizing import settle
from rinkflow.plans.kalman import BASE_NOISE, FIRST_MEAN, FIRST_VARIANCE, PROCESS_NOISE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
#: Microseconds survive the text.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
#: Rows of a key that lie in one element of its state: Spark hands elements over one by one.
PARCEL = 1000


def _packed(df: DataFrame, time: str, order: str, tie: str | None, **more: Column) -> DataFrame:
    last = F.col(tie).cast("string") if tie else F.xxhash64(*df.columns).cast("string")
    packed = {
        "ms": F.unix_millis(F.col(time).cast("timestamp")),
        "place": F.col(order).cast("long"),
        "tie": F.coalesce(last, F.lit("")),
        **more,
        "text": F.to_json(F.struct(*df.columns), JSON),
    }
    rows = df.where(F.col(time).isNotNull() & F.col(order).isNotNull())
    return rows.withColumns({f"row_{n}": c for n, c in packed.items()})


def _tuples(frames: Iterator[pd.DataFrame], names: Sequence[str]) -> list[tuple]:
    out = []
    for frame in frames:
        columns = [[None if v is None or v != v else v for v in frame[f"row_{n}"].tolist()] for n in names]
        out += zip(*columns, strict=True)
    return out


class _Timed(StatefulProcessor):
    """Rows wait for the watermark; timers stand at the times of waiting rows."""

    fields = "rows string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)

    def parcels(self, rows: list[tuple]) -> list[tuple]:
        return [(json.dumps(rows[i : i + PARCEL]),) for i in range(0, len(rows), PARCEL)]

    def held(self, state) -> list[tuple]:
        return [tuple(row) for (text,) in state.get() for row in json.loads(text)]

    def wait(self, rows: list[tuple]) -> None:
        self.waiting.appendList(self.parcels(rows))
        self.handle.registerTimer(int(min(r[0] for r in rows)))

    def keep(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(self.parcels(rows))
        else:
            state.clear()

    def close(self) -> None:
        pass


class _Context(_Timed):
    names = ("ms", "place", "tie", "axis", "flags", "text")

    def __init__(self, lags: Sequence[int], frames: Sequence[tuple[int, int]], idle: int):
        self.lags, self.frames, self.idle = list(lags), list(frames), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ms), int(place), tie, axis if axis is None else int(axis), int(flags), text) for ms, place, tie, axis, flags, text in _tuples(rows, self.names)]
        if new:
            self.wait(new)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, kept = self.held(self.waiting), self.held(self.kept)
        ready = sorted((r for r in waiting if r[0] <= now), key=lambda r: r[1:3])
        rest = [r for r in waiting if r[0] > now]
        if not ready:
            # An idle timer: nothing came for so long that the key's context is given up.
            if not rest and kept and max(r[0] for r in kept) + self.idle <= now:
                self.kept.clear()
            return
        seen = sorted(kept, key=lambda r: r[1:3]) + ready
        first = len(kept)
        out = {"__text": [r[5] for r in ready]}
        for lag in self.lags:
            out[f"__lag{lag}"] = [seen[first + i - lag][5] if first + i >= lag else None for i in range(len(ready))]
        for i, (lo, hi) in enumerate(self.frames):
            axis = sorted(r[3] for r in seen if r[3] is not None and r[4] >> i & 1)
            out[f"__n{i}"] = [0 if r[3] is None else bisect_right(axis, r[3] + hi) - bisect_left(axis, r[3] + lo) for r in ready]
        # What later rows can reach: the last rows in order, and the rows of the axis not further back than the frames.
        back = max(self.lags, default=0)
        known = [r[3] for r in seen if r[3] is not None]
        reach = max(known) + min((lo for lo, _ in self.frames), default=0) if known else 0
        tail = len(seen) - back
        last = max(r[0] for r in ready)
        idle = not rest and last + self.idle <= now
        self.keep(self.kept, [] if idle else [r for i, r in enumerate(seen) if i >= tail or (self.frames and r[3] is not None and r[3] >= reach)])
        self.keep(self.waiting, rest)
        if not idle:
            self.handle.registerTimer(min(r[0] for r in rest) if rest else last + self.idle)
        yield pd.DataFrame(out)


def online_context(
    stream: DataFrame,
    keys: Sequence[str],
    order: str,
    time: str,
    lags: Mapping[str, tuple[str, int]],
    counts: Mapping[str, tuple[Column, str, int, int]] | None = None,
    tie: str | None = None,
    late: str = "10 minutes",
    idle_ms: int = 3_600_000,
) -> DataFrame:
    """Rows with values of earlier rows and counts of earlier rows in a range, each written once the watermark has passed it.

    ``lags`` is ``{new: (column, k)}`` as for ``neighbours`` with k > 0; ``counts`` is ``{new: (flag, axis, lo, hi)}`` with
    lo <= hi < 0 as for ``range_counts``, of one axis. A key's state is dropped when the watermark is ``idle_ms`` past its last row;
    a row that comes later still starts a new context.
    """
    counts = dict(counts or {})
    if any(k <= 0 for _, k in lags.values()) or any(not lo <= hi < 0 for _, _, lo, hi in counts.values()):
        raise ValueError("a stream has earlier rows only: lags are positive, frames end before the row")
    axes = {axis for _, axis, _, _ in counts.values()}
    if len(axes) > 1:
        raise ValueError(f"counts of one axis, not of {sorted(axes)}")
    axis = F.col(axes.pop()).cast("long") if axes else F.lit(None).cast("long")
    flags = sum((F.when(flag, F.lit(1 << i)).otherwise(0).cast("long") for i, (flag, *_) in enumerate(counts.values())), F.lit(0).cast("long"))
    steps = sorted({k for _, k in lags.values()})
    frames = [(lo, hi) for _, _, lo, hi in counts.values()]
    rows = _packed(stream.withWatermark(time, late), time, order, tie, axis=axis, flags=flags)
    schema = ", ".join(["__text string", *[f"__lag{k} string" for k in steps], *[f"__n{i} long" for i in range(len(frames))]])
    found = (
        rows.select(*keys, time, *[f"row_{n}" for n in _Context.names])
        .groupBy(*keys)
        .transformWithStateInPandas(_Context(steps, frames, idle_ms), schema, "Append", "EventTime")
    )
    texts = {n: F.from_json(n, stream.schema, JSON) for n in ("__text", *[f"__lag{k}" for k in steps])}
    read = found.withColumns(texts)
    old = [F.col(f"__lag{k}").getField(c).alias(new) for new, (c, k) in lags.items()]
    return read.select("__text.*", *old, *[F.col(f"__n{i}").alias(new) for i, new in enumerate(counts)])


class Curve:
    """A bounded piecewise linear curve on the driver's side of a stream; beyond its ends the first and last piece go on."""

    def __init__(self, points: DataFrame, x: str, y: str):
        kept = settle(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y")))
        if not kept.small:
            raise ValueError("a curve for a stream must be within the session's limit of small tables")
        table = kept.df.orderBy("x").toPandas()
        self.x, self.y = table["x"].to_numpy(), table["y"].to_numpy(np.float64)

    def at(self, x: float) -> float | None:
        if len(self.x) < 2:
            return float(self.y[0]) if len(self.x) else None
        i = min(max(int(np.searchsorted(self.x, x, "right")) - 1, 0), len(self.x) - 2)
        return float(self.y[i] + (self.y[i + 1] - self.y[i]) / (self.x[i + 1] - self.x[i]) * (x - self.x[i]))


class _Filter(_Timed):
    names = ("ms", "place", "tie", "z", "noise", "age", "text")

    def __init__(self, curve: Curve, q: float, min_steps: int):
        self.curve, self.q, self.min_steps = curve, q, min_steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.base = handle.getValueState("base", "step long, mean double, var double, age double")

    def folded(self, rows: list[tuple]) -> list[tuple]:
        """(step, mean, variance, age) after each row, from the last final state on."""
        step, mean, var, age = self.base.get() or (0, FIRST_MEAN, FIRST_VARIANCE, None)
        out = []
        for _, _, _, z, noise, now, _ in rows:
            m, p = mean, var
            if step:
                rate = None if age is None else self.curve.at(age)
                offset = rate * (now - age) if rate is not None and now is not None else 0.0
                m, p = mean + offset, var + self.q
            gain = p / (p + noise)
            step, mean, var, age = step + 1, m + gain * (z - m), (1 - gain) * p, now
            out.append((step, mean, var, age))
        return out

    def rows_out(self, rows: list[tuple], states: list[tuple], final: bool) -> pd.DataFrame:
        return pd.DataFrame(
            {"__text": [r[6] for r in rows], "step": [s[0] for s in states], "mean": [s[1] for s in states], "var": [s[2] for s in states], "final": final}
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ms), int(place), tie, z, noise, age, text) for ms, place, tie, z, noise, age, text in _tuples(rows, self.names) if z is not None and noise is not None]
        if not new:
            return
        self.wait(new)
        # Replay the kept suffix: what comes before all new rows stays as it was written.
        suffix = sorted(self.held(self.waiting), key=lambda r: r[1:3])
        since = min(suffix.index(r) for r in new)
        yield self.rows_out(suffix[since:], self.folded(suffix)[since:], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        suffix = sorted(self.held(self.waiting), key=lambda r: r[1:3])
        ready = next((i for i, r in enumerate(suffix) if r[0] > now), len(suffix))
        step = (self.base.get() or (0,))[0]
        if ready and step + ready >= self.min_steps:
            states = self.folded(suffix[:ready])
            self.base.update(states[-1])
            self.keep(self.waiting, suffix[ready:])
            yield self.rows_out(suffix[:ready], states, True)
        later = [r[0] for r in suffix if r[0] > now]
        if later:
            self.handle.registerTimer(min(later))


def online_filter(
    stream: DataFrame,
    drift: DataFrame,
    time: str,
    key: str = "goalie_id",
    order: str = "season",
    z: str = "talent",
    age: str = "age",
    shots: str = "shots_faced",
    tie: str | None = None,
    q: float = PROCESS_NOISE,
    late: str = "10 minutes",
    min_steps: int = 2,
    drift_x: str = "age",
    drift_y: str = "yearly_drift",
) -> DataFrame:
    """The filter of ``plans.kalman`` on a stream: the rows with ``step, kalman_talent, variance, final``.

    Every new row replays the series from the last final state on and writes its step and the ones after it as provisional. Once
    the watermark has passed them, steps are written as final, and only the state after them is kept: mean, variance, step, age. A
    series is final from ``min_steps`` rows on. Rows without a value or shots take no part. Series are never dropped: four numbers each.
    """
    noise = obs_noise(BASE_NOISE, F.col(shots)).cast("double")
    rows = _packed(stream.withWatermark(time, late), time, order, tie, z=F.col(z).cast("double"), noise=noise, age=F.col(age).cast("double"))
    found = (
        rows.select(key, time, *[f"row_{n}" for n in _Filter.names])
        .groupBy(key)
        .transformWithStateInPandas(
            _Filter(Curve(drift, drift_x, drift_y), q, min_steps), "__text string, step long, mean double, var double, final boolean", "Append", "EventTime"
        )
    )
    read = found.withColumn("__text", F.from_json("__text", stream.schema, JSON))
    return read.select("__text.*", "step", F.col("mean").alias("kalman_talent"), F.col("var").alias("variance"), "final")


def run_available(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Take what has landed, write each batch to the folder of its number (again where it is run again), and stop."""
    spark: SparkSession = rows.sparkSession
    before = spark.conf.get(PROVIDER_CONF)
    spark.conf.set(PROVIDER_CONF, ROCKSDB)
    try:
        query = (
            rows.writeStream.foreachBatch(lambda part, batch: part.write.mode("overwrite").parquet(f"{target}/batch={batch}"))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER_CONF, before)
