"""Encoded states kept across a stream, as keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assayer.session import package_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reuse(StatefulProcessor):
    """Keeps one encoded value per (state, horizon) until the watermark passes the horizon's end."""

    def __init__(self, state: str, encode: Callable[[str | None], Any], code: str, horizon: int, columns: list[str]):
        self.state, self.encode, self.code, self.horizon, self.columns = state, encode, code, horizon, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("code", f"code {self.code}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.value.exists()
        code = self.value.get()[0] if known else None
        for batch in rows:
            if not len(batch):
                continue
            if not known:
                code = self.encode(batch[self.state].iloc[0])
                self.value.update((code,))
                self.handle.registerTimer((int(key[1]) + 1) * self.horizon * 1000)
            out = batch[self.columns].copy()
            out["code"] = [code] * len(out)
            out["fresh"] = [not known] + [False] * (len(out) - 1)
            known = True
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def reuse_states(
    rows: DataFrame, state: str, time: str, encode: Callable[[str | None], Any], *, code: str, delay: str, horizon: int
) -> DataFrame:
    """The rows of a stream with ``code`` (of the DDL type ``code``), the encoding of their state, and ``fresh`` on the row that caused it.

    ``encode`` runs once per distinct state and horizon of ``horizon`` seconds of event time, whatever the micro-batches; the value waits in the
    state store for later rows, out of order or not, and is dropped when the watermark (``delay``) passes the end of its horizon. Rows behind the
    watermark of the batch before are late and get no answer. A NULL state is a state of its own; a NULL time is an error.
    The state holds the encoded values of open horizons only, never texts. A hot state is one key: its rows are handled by one task, in batches.
    """
    spark = rows.sparkSession
    package_path(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    slot = F.floor(F.unix_timestamp(time) / horizon)
    present = F.when(F.col(time).isNotNull(), F.col(time)).otherwise(F.raise_error("a row has no time").cast("timestamp"))
    keyed = rows.withColumn(time, present).withWatermark(time, delay).withColumns({"state_sha": F.sha2(F.coalesce(F.concat(F.lit("="), F.col(state)), F.lit("")), 256), "slot": slot})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return keyed.groupBy("state_sha", "slot").transformWithStateInPandas(
        statefulProcessor=Reuse(state, encode, code, horizon, rows.columns),
        outputStructType=f"{fields}, code {code}, fresh boolean", outputMode="Append", timeMode="EventTime",
    )
