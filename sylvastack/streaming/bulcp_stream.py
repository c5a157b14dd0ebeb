"""The Bayesian update online: the last posterior of each pixel is state, and every observation emits the next one."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.series import _checked

#: Where Spark keeps the state of such streams.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "pixel_id long, t int, p array<double>, late boolean, ended boolean"


def _sent(p: np.ndarray) -> np.ndarray:
    """NaN in lists would come out of Arrow as null; no posterior is infinite, so infinity stands for it on the way."""
    return np.where(np.isnan(p), np.inf, p)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which timers and expiring state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Posteriors(StatefulProcessor):
    """State of a pixel: the t and the posterior of its last observation, and a timer that ends it."""

    def __init__(self, leveler: float, keep_ms: int, on_zero: str) -> None:
        self.leveler, self.keep_ms, self.on_zero = leveler, keep_ms, on_zero

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t int, p array<double>")

    def step(self, before: np.ndarray | None, now: np.ndarray) -> np.ndarray:
        if before is None:
            return now
        product = before * now
        if self.on_zero == "carry" and product.sum() == 0:
            return before
        with np.errstate(invalid="ignore"):
            return self.leveler * product / product.sum() + (1 - self.leveler) / len(product)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, before = self.last.get() if self.last.exists() else (None, None)
        before = None if before is None else np.array(before, float)
        every = pd.concat(list(rows)).sort_values("t", kind="stable")
        late = np.zeros(len(every), bool) if latest is None else (every["t"] <= latest).to_numpy()
        out = []
        for p, skip in zip(every["p"], late):
            now = np.asarray(p, float)
            if not skip:
                now = before = self.step(before, now)
            out.append(_sent(now))
        if not late.all():
            self.last.update((int(every["t"].iloc[-1]), before.tolist()))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(every["ms"].max()) + self.keep_ms)
        yield pd.DataFrame({"pixel_id": key[0], "t": every["t"].to_numpy(), "p": out, "late": late, "ended": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t, p = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"pixel_id": [key[0]], "t": [t], "p": [_sent(np.array(p, float))], "late": [False], "ended": [True]})

    def close(self) -> None:
        pass


def bulcp_updates(stream: DataFrame, leveler: float = 0.8, time: str = "acquired", delay: str = "30 days", keep_days: int = 400, on_zero: str = "nan") -> DataFrame:
    """(pixel_id, t, p, late, ended) of a stream with pixel_id, t, p and the event time ``time``; start it within ``rocksdb``.

    Each observation gives its posterior: the batch update, carried on from one micro-batch to the next. A micro-batch
    folds its observations of a pixel in order of t. One that is not later than the last folded in an earlier micro-batch
    is late: it changes nothing and comes out as it came in, with late true, a side output for the reader to split off.
    What is behind the watermark, ``delay`` before the greatest event time seen and not before 1970, is dropped by Spark, which counts it. When the
    watermark passes ``keep_days`` after a pixel's last observation, its state ends and its last posterior comes out once
    more, with ended true; so state holds the pixels of that time only. Zero products give NaN, or with ``on_zero`` carry the posterior before.
    """
    _checked(leveler, on_zero)
    timed = stream.withWatermark(time, delay).select("pixel_id", "t", "p", time, F.unix_millis(time).alias("ms"))
    folded = timed.groupBy("pixel_id").transformWithStateInPandas(Posteriors(leveler, keep_days * 86_400_000, on_zero), _OUT, "append", "EventTime")
    return folded.withColumn("p", F.transform("p", lambda x: F.when(x == float("inf"), float("nan")).otherwise(x)))


def bulcp_stream(stream: DataFrame, leveler: float = 0.8) -> DataFrame:
    """(pixel_id, t, p): the posteriors alone, for a stream whose t counts days from 0 on; late rows are left out."""
    timed = stream.withColumn("acquired", F.timestamp_seconds((F.col("t").cast("long") + 1) * 86_400))
    return bulcp_updates(timed, leveler).where("not late and not ended").select("pixel_id", "t", "p")
