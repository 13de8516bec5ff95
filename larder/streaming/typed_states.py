"""Streaming operators with typed state: ``transformWithStateInPandas`` (S6, and E3/E4 in the silver stream).

``lags_stream``: each series (store, product) keeps its last quantities as a list, as many as the
longest lag, and the newest moment it has seen.

``boundaries_stream`` is the same operator as in ``agent_streams``, with state kept by field and by key:

- a value of the stream's last part and the number of parts so far;
- a map with an entry for each (group, id) that has ended.  A batch looks up the ids that it holds and
  writes those that it ends, whatever the stream has ended before;
- a timer that closes a stream after ``RETAIN_MS`` of silence.

State of this kind needs the RocksDB provider (``use_typed_state``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.operators.agentlog import PART_FIELDS
from larder.operators.features import SERIES_ORDER
from larder.streaming.agent_streams import ENDS, OUT_FIELDS, OUT_SCHEMA, RETAIN_MS, _bounded, _kind, parts_with_markers

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_typed_state(spark: SparkSession) -> None:
    """Let streams that are started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Boundaries(StatefulProcessor):
    """Starts and ends of delta runs, and what follows an end dropped, per stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "type string, id string, n bigint")
        self._ended = handle.getMapState("ended", "name string", "ord bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows)).sort_values(["seq", "sub"], kind="stable")
        finish = (parts["type"] == "finish").to_numpy()
        newest = int(parts["event_ts"].max().timestamp() * 1000)
        yield self._given_out(key, parts.iloc[:int(finish.argmax())] if finish.any() else parts, bool(finish.any()))
        for at in list(self._handle.listTimers()):
            self._handle.deleteTimer(at)
        if not finish.any():
            self._handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + RETAIN_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._given_out(key, pd.DataFrame(columns=PART_FIELDS), True)

    def _given_out(self, key, parts: pd.DataFrame, closing: bool) -> pd.DataFrame:
        last_type, last_id, n = self._last.get() if self._last.exists() else (None, None, 0)
        before = pd.DataFrame([{**{f: None for f in PART_FIELDS}, "type": last_type, "id": last_id}], dtype=object)
        rows = pd.concat([before, parts[PART_FIELDS]], ignore_index=True).astype(object)
        out = _bounded(rows.where(rows.notna(), None), closing)
        out["ord"] = n + 1 + np.arange(len(out))
        # the first end of a (kind, id) is the last part that it has; a flush isn't subject to that
        name = (_kind(out["type"].astype("string")) + ":" + out["id"].astype("string")).astype(object)
        end = out["type"].isin(ENDS) & ~out["is_flush"]
        known = {x for x in name.dropna().unique() if self._ended.containsKey((x,))}
        past = name.isin(known) | (end.groupby(name).cumsum() - end > 0)
        keep = name.isna() | out["is_flush"] | ~past.fillna(False).astype(bool)
        if closing:
            self._last.clear()
            self._ended.clear()
        else:
            for x, ord_ in zip(name[end], out["ord"][end]):
                if x not in known:
                    known.add(x)
                    self._ended.updateValue((x,), (int(ord_),))
            self._last.update((rows["type"].iloc[-1], rows["id"].iloc[-1], int(n + len(out))))
        return out[keep].assign(stream_id=key[0])[OUT_FIELDS].reset_index(drop=True)

    def close(self) -> None:
        pass


def boundaries_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Boundaries and end-dedup over an event stream, as ``agent_streams.boundaries_stream`` gives them."""
    use_typed_state(events.sparkSession)
    parts = parts_with_markers(events).withColumn("event_ts", F.col("ts").cast("timestamp")).withWatermark("event_ts", delay)
    return parts.groupBy("stream_id").transformWithStateInPandas(Boundaries(), OUT_SCHEMA, "append", "EventTime")


class Lags(StatefulProcessor):
    """Quantities of earlier rows of a series, over its batches."""

    def __init__(self, lags: tuple[int, ...], columns: list[str]):
        self._lags, self._columns = lags, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tail = handle.getListState("tail", "quantity bigint")
        self._newest = handle.getValueState("newest", "moment timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch.sort_values([c for c in SERIES_ORDER if c in batch], kind="stable", na_position="last").reset_index(drop=True)
        tail = [q for q, in self._tail.get()]
        quantities = tail + [None if pd.isna(q) else int(q) for q in batch["quantity"]]
        for n in self._lags:
            back = len(tail) - n
            batch[f"quantity_lag_{n}"] = pd.array([quantities[i + back] if i + back >= 0 else None for i in range(len(batch))], "Int64")
        moment = pd.to_datetime(batch["transaction_ts"])
        newest = self._newest.get()[0] if self._newest.exists() else None
        batch["is_late"] = (moment < pd.Timestamp(newest)).fillna(False) if newest is not None else False
        self._tail.put([(q,) for q in quantities[-max(self._lags):]])
        if moment.notna().any():
            top = moment.max()
            self._newest.update((max(top, pd.Timestamp(newest)) if newest is not None else top,))
        yield batch[self._columns]

    def close(self) -> None:
        pass


def lags_stream(sales: DataFrame, lags: tuple[int, ...] = (1, 7)) -> DataFrame:
    """A stream of sales with ``quantity_lag_n`` and ``is_late``.

    Within a batch a series stands in its usual order, and batches follow each other.  So if no
    row is late (older than the newest of its series in earlier batches), lags are those that
    ``lag_features`` gives for all rows at once.  A late row stands where it arrives, behind the rows
    of earlier batches: its lags, and those of the rows behind it, are taken in that order; it is marked.
    """
    use_typed_state(sales.sparkSession)
    made = [f"{n} {k}" for n, k in [*((f"quantity_lag_{n}", "bigint") for n in lags), ("is_late", "boolean")]]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sales.schema.fields), *made])
    columns = [*sales.columns, *(m.split()[0] for m in made)]
    return sales.groupBy("store_id", "product_id").transformWithStateInPandas(Lags(lags, columns), schema, "append", "None")
