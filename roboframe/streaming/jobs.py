"""Streaming twins of the batch operators. Each takes a streaming DataFrame; state is keyed and small."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_masked_moments(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Running moments of each key (complete or update mode): partial and final aggregates are Spark's."""
    v = F.when(~F.isnan(x), F.col(x))
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count(v)).alias("m2"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )


class _Ordered(StatefulProcessor):
    """Rows of a key in the order of `t` within each batch; batches come in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("t")
        yield self.step(key, frame)

    def step(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class HistoryWindow(_Ordered):
    """The last past + 1 values of a key, and which slots are filled; before that the first value stands in."""

    schema = "h array<double>"
    output = "key string, t long, h array<double>, filled int"

    def __init__(self, past: int):
        self.past = past

    def step(self, key, frame):
        h = list(self.state.get()[0]) if self.state.exists() else []
        rows = []
        for t, x in zip(frame["t"], frame["x"], strict=True):
            h = [*h, float(x)][-(self.past + 1) :]
            pad = self.past + 1 - len(h)
            rows.append((str(key[0]), int(t), [h[0]] * pad + h, len(h)))
        self.state.update((h,))
        return pd.DataFrame(rows, columns=["key", "t", "h", "filled"])


class Hysteresis(_Ordered):
    """Open above high, closed below low, else as before; the first row by the midpoint."""

    schema = "open boolean"
    output = "key string, t long, is_open boolean"

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high

    def step(self, key, frame):
        now = self.state.get()[0] if self.state.exists() else None
        rows = []
        for t, x in zip(frame["t"], frame["x"], strict=True):
            if x > self.high:
                now = True
            elif x < self.low:
                now = False
            elif now is None:
                now = bool(x >= (self.low + self.high) / 2)
            rows.append((str(key[0]), int(t), now))
        self.state.update((now,))
        return pd.DataFrame(rows, columns=["key", "t", "is_open"])


class EveryNth(_Ordered):
    """The first and every n-th row of a key, counted over batches."""

    schema = "k long"
    output = "key string, t long, k long"

    def __init__(self, n: int):
        if n < 1:
            raise ValueError("n must be 1 or more")
        self.n = n

    def step(self, key, frame):
        k = self.state.get()[0] if self.state.exists() else 0
        numbers = range(k + 1, k + 1 + len(frame))
        self.state.update((k + len(frame),))
        rows = [(str(key[0]), int(t), i) for t, i in zip(frame["t"], numbers, strict=True) if i == 1 or i % self.n == 0]
        return pd.DataFrame(rows, columns=["key", "t", "k"])


class ActionBuffer(_Ordered):
    """A queue of predicted steps: rows with `plan` refill it, rows without one take its head; an empty queue repeats
    the last step, marked as not valid."""

    schema = "queue array<double>, last double"
    output = "key string, t long, action double, valid boolean, remaining int"

    def step(self, key, frame):
        queue, last = self.state.get() if self.state.exists() else ([], None)
        queue, rows = list(queue or []), []
        for t, plan in zip(frame["t"], frame["plan"], strict=True):
            if plan is not None and len(plan):
                queue = [float(p) for p in plan]
                continue
            valid = bool(queue)
            last = queue.pop(0) if queue else last
            rows.append((str(key[0]), int(t), last, valid, len(queue)))
        self.state.update((queue, last))
        return pd.DataFrame(rows, columns=["key", "t", "action", "valid", "remaining"])


def stateful(rows: DataFrame, key: str, processor: _Ordered) -> DataFrame:
    """Run a processor per key; needs the RocksDB state store."""
    return rows.groupBy(key).transformWithStateInPandas(processor, outputStructType=processor.output, outputMode="append", timeMode="none")


class Rollouts(StatefulProcessor):
    """The newest state of each rollout as result files arrive. A rollout is told when it is first seen (`open`), when it is
    final (`final`), and when it has been pending for `patience` milliseconds after its last file (`lost`).

    Its state goes when the watermark has passed its last file by `patience` (none is left then for finals), or is told
    `lost`; files that come later than the watermark are not read by Spark, so none opens it again. Until then a final
    rollout stays final, whatever comes.
    """

    # times as microseconds, rows as they are: a frame for each rollout costs more than all else
    output = "task string, model string, demo_id long, event string, success boolean, duration double, at long"
    told = Row(*[c.split()[0] for c in output.split(", ")])

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rollout = handle.getValueState("rollout", "at long, success boolean, pending boolean, duration double")

    def _timer(self, at: int) -> int:
        return at // 1000 + self.patience

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # each call on state or timers goes to the executor and back, so none is made without need
        before = known = self.rollout.get()
        rows, told = sorted(rows, key=lambda r: r["at"]), []
        if known is None:
            told.append(self._row(key, "open", None, None, rows[0]["at"]))
        for r in rows:
            at, duration = r["at"], r["duration"]
            if known is not None and (not known[2] or at < known[0]):
                continue
            known = (at, r["success"], bool(r["pending"]), None if duration is None or duration != duration else duration)
            if not known[2]:
                told.append(self._row(key, "final", known[1], known[3], at))
        if before is None or known != tuple(before):
            self.rollout.update(known)
        # a rollout has one timer, by its last file
        if before is None or before[0] != known[0]:
            if before is not None:
                self.handle.deleteTimer(self._timer(before[0]))
            self.handle.registerTimer(self._timer(known[0]))
        return iter(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at, success, pending, duration = self.rollout.get()
        self.rollout.clear()
        return iter([self._row(key, "lost", success, duration, at)] if pending else [])

    def _row(self, key, event, success, duration, at) -> Row:
        return self.told(*key, event, success, duration, at)

    def close(self) -> None:
        pass


def stream_results(rollouts: DataFrame, delay: str = "10 minutes", patience: int = 3_600_000) -> DataFrame:
    """rollouts(task, model, demo_id, success, pending, duration, stamp) as files arrive -> what becomes of each rollout, in
    append mode; state is bounded by the rollouts of the last `delay` and `patience`. Rows without a stamp are older than all."""
    stamp = F.col("stamp").cast("timestamp")
    rows = rollouts.select("task", "model", "demo_id", "success", "pending", F.col("duration").cast("double").alias("duration"), stamp.alias("stamp"))
    rows = rows.withWatermark("stamp", delay).withColumn("at", F.coalesce(F.unix_micros("stamp"), F.lit(0)))
    out = rows.groupBy("task", "model", "demo_id").transformWithState(
        Rollouts(patience), outputStructType=Rollouts.output, outputMode="append", timeMode="EventTime"
    )
    return out.withColumn("stamp", F.timestamp_micros("at")).drop("at")


class Moments(StatefulProcessor):
    """Count, mean, sum of squares around it, least and greatest value of each key, told anew after each batch. A saved state
    may stand at the beginning."""

    output = "key string, n long, mean double, m2 double, min double, max double"
    schema = "n long, mean double, m2 double, min double, max double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", self.schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0]
        self.state.update((int(r["n"]), float(r["mean"]), float(r["m2"]), float(r["min"]), float(r["max"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get() if self.state.exists() else (0, 0.0, 0.0, None, None)
        for frame in rows:
            x = frame["x"].to_numpy(float)
            x = x[~pd.isna(x)]
            if len(x):
                n, mean, m2, low, high = state
                m, k = float(x.mean()), len(x)
                apart = m - mean
                low = float(x.min()) if low is None else min(low, float(x.min()))
                high = float(x.max()) if high is None else max(high, float(x.max()))
                state = (n + k, mean + apart * k / (n + k), m2 + float(((x - m) ** 2).sum()) + apart * apart * n * k / (n + k), low, high)
        if state[0]:
            self.state.update(state)
            yield pd.DataFrame([(str(key[0]), *state)], columns=["key", "n", "mean", "m2", "min", "max"])

    def close(self) -> None:
        pass


def resumed_moments(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """rows(key, x) as they arrive, saved(key, n, mean, m2, min, max) of what came before -> the moments of all, for each key
    that a batch brings rows of, after that batch (append mode; the newest row of a key, which has its largest n, holds)."""
    return rows.groupBy("key").transformWithStateInPandas(
        Moments(), outputStructType=Moments.output, outputMode="append", timeMode="None", initialState=saved.groupBy("key")
    )


def saved_moments(state: DataFrame) -> DataFrame:
    """Moments in the state of a stream, as Spark's state source reads it from a checkpoint."""
    return state.select(F.col("key.key").alias("key"), "value.*")
