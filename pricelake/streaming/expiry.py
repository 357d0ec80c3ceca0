"""Rows that expire: a stream keeps each key's last row with its deadline, and tells of those whose deadline the watermark passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Expiring(StatefulProcessor):
    """State: a key's last deadline, in milliseconds, or -1 where it has none, and when that row was; a timer for the deadline."""

    def __init__(self, keys: list[str], time: str, deadline: str):
        self.keys, self.time, self.deadline = keys, time, deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "deadline long, at long")

    def _told(self, key: tuple, deadlines: list[int]) -> pd.DataFrame:
        made = {k: [v] * len(deadlines) for k, v in zip(self.keys, key, strict=True)}
        return pd.DataFrame(made | {"expired_at": pd.to_datetime(deadlines, unit="ms")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A batch's rows of a key in the order of their times; of these, two numbers a row are held."""
        now, last = self.held.get() if self.held.exists() else (None, None)
        before, gone = now, []
        parts = [tuple(f[c].astype("datetime64[ms]").astype("int64").where(f[c].notna(), -1).to_numpy() for c in (self.time, self.deadline)) for f in rows if len(f)]
        times, deadlines = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((deadlines, times))
        for at, deadline in zip(times[order].tolist(), deadlines[order].tolist(), strict=True):
            if last is not None and at < last:
                continue
            if now is not None and 0 <= now <= at:
                gone.append(now)
            now, last = deadline, at
        if before is not None and before >= 0 and now != before:
            self.handle.deleteTimer(before)
        self.held.update((now, last))
        if now >= 0 and now != before:
            self.handle.registerTimer(now)
        if gone:
            yield self._told(key, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get()[0] if self.held.exists() else None
        if held is not None and held == expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self._told(key, [held])

    def close(self) -> None:
        pass


def expired(rows: DataFrame, keys: list[str], time: str, deadline: str, late: str = "1 hour") -> DataFrame:
    """(keys, expired_at) of a stream's rows: price exceptions by their end, unused groups by when they were last seen and an age.

    A later row of a key replaces the deadline of the one before, and a null deadline lifts it; a row that comes after
    a later one of its key in an earlier batch is passed over. A key expires when a row of it comes
    at or after its deadline, or when the watermark (the greatest time less ``late``) passes the deadline; its state is dropped
    then. Times count by milliseconds. The session must keep state in RocksDB, which ``keeping_state`` sets.
    """
    fields = [f for f in rows.schema.fields if f.name in keys]
    stream = rows.select(*keys, F.date_trunc("millisecond", time).alias(time), F.date_trunc("millisecond", deadline).alias(deadline)).withWatermark(time, late)
    out = StructType([*sorted(fields, key=lambda f: keys.index(f.name)), StructField("expired_at", TimestampType())])
    return stream.groupBy(*keys).transformWithStateInPandas(_Expiring(keys, time, deadline), out, outputMode="Append", timeMode="EventTime")


class keeping_state:
    """Within it, queries that start keep their state in RocksDB."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(_STORE, None)
        self.spark.conf.set(_STORE, _ROCKS)

    def __exit__(self, *_) -> None:
        self.spark.conf.unset(_STORE) if self.before is None else self.spark.conf.set(_STORE, self.before)


def purged(rows: DataFrame, keys: list[str], time: str, deadline: str, until) -> DataFrame:
    """The batch form: the keys that are left at ``until``, each with its last deadline."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(deadline), time).alias("_s")).select(*keys, F.col(f"_s.{deadline}").alias(deadline))
    return last.where(F.col(deadline).isNull() | (F.col(deadline) > F.lit(until)))
