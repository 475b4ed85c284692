"""Running moments by key over a stream, held in a state of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "n long, mean_x double, mean_y double, cxx double, cyy double, cxy double, last long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(a: tuple, b: tuple) -> tuple:
    """The moments (count, means, sums of squared and mixed deviations) of two sets together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
    return n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w


class Moments(StatefulProcessor):
    """Each batch's rows of a key are joined to the moments so far; a key without rows for ``idle`` milliseconds of event time is closed.

    Rows come out as they stand after a batch, and once more with ``closed`` when a key's time is over; then its state goes.
    """

    def __init__(self, key: str, idle: int):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("moments", STATE)

    def _row(self, key: tuple, held: tuple, closed: bool) -> pd.DataFrame:
        n, mx, my, cxx, cyy, cxy, last = held
        return pd.DataFrame({self.key: [key[0]], "n": [n], "mean_x": [mx], "mean_y": [my], "var_x": [cxx / n], "var_y": [cyy / n], "cov_xy": [cxy / n], "last": [last], "closed": [closed]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
        if held[0] and held[6] + self.idle <= timerValues.getCurrentWatermarkInMs():
            # Its time was over before these rows, which come ahead of the timer.
            yield self._row(key, held, True)
            held = (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
        moments, last = held[:6], held[6]
        for part in rows:
            last = max(last, int(part["at"].max()))
            good = part.dropna(subset=["x", "y"])
            if len(good):
                x, y = good["x"].to_numpy(float), good["y"].to_numpy(float)
                mx, my = x.mean(), y.mean()
                moments = joined(moments, (len(x), mx, my, ((x - mx) ** 2).sum(), ((y - my) ** 2).sum(), ((x - mx) * (y - my)).sum()))
        held = (int(moments[0]), *(float(v) for v in moments[1:]), last)
        self.state.update(held)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.idle)
        if held[0]:
            yield self._row(key, held, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        self.state.clear()
        if held and held[0]:
            yield self._row(key, held, True)

    def close(self) -> None:
        pass


def running_moments(stream: DataFrame, key: str, x: str, y: str, idle: int, late: str) -> DataFrame:
    """Count, means, variances and covariance of ``x`` and ``y`` by ``key``, in update mode.

    Args: a stream with event times ``ts``; ``idle``: milliseconds of event time without rows that close a key; ``late``: rows this much
    later than the newest are dropped.  Returns ``key, n, mean_x, mean_y, var_x, var_y, cov_xy`` (of the population), ``last`` (the key's newest
    event time in milliseconds) and ``closed``.  Rows with a null x or y only keep the key open; a key of such rows alone gives none.
    The query needs the RocksDB state store (``PROVIDER``, ``ROCKS``).
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.withWatermark("ts", late).select(key, "ts", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.unix_millis("ts").alias("at"))
    schema = f"{key} {kind}, n long, mean_x double, mean_y double, var_x double, var_y double, cov_xy double, last long, closed boolean"
    return rows.groupBy(key).transformWithStateInPandas(Moments(key, idle), schema, "Update", "EventTime")
