"""Streaming twins of the agent-log jobs.

* S4: idle expiry - a stream's activity session closes 5 minutes after its
  last event (``session_window`` with an event-time watermark).
* S6: per-stream boundary injection and end-dedup as a stateful operator.
  The state of one stream is its last part, the number of parts so far and
  the (group, id) keys that have ended.  It lives until the stream's ``[DONE]``
  marker arrives; a stream that stalls goes on where it stood, and one that
  has been silent for ``RETAIN`` is closed as the batch job's flush would.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.operators.agentlog import PART_FIELDS, normalise_responses

DONE = "[DONE]"
IDLE = "5 minutes"
RETAIN_MS = 24 * 3600 * 1000

OUT_FIELDS = ["stream_id", "ord", "is_flush", *PART_FIELDS]
OUT_SCHEMA = "stream_id string, ord bigint, is_flush boolean, " + ", ".join(f"{f} string" for f in PART_FIELDS)
STATE_SCHEMA = "last_type string, last_id string, n bigint, ended string"
DELTAS = ("text-delta", "reasoning-delta")
ENDS = ("text-end", "reasoning-end")


def idle_sessions_stream(events: DataFrame, gap: str = IDLE, delay: str = "10 minutes") -> DataFrame:
    """Closed activity sessions per stream; emitted once the watermark passes them.

    Event times are wall-clock (UTC) values; the watermark runs on them as
    instants and the session bounds are returned wall-clock again.
    """
    e = events.withColumn("_et", F.col("ts").cast("timestamp"))
    s = (e.withWatermark("_et", delay)
         .groupBy("stream_id", F.session_window("_et", gap).alias("w"))
         .agg(F.count(F.lit(1)).alias("n_events")))
    return s.select("stream_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n_events")


def parts_with_markers(events: DataFrame) -> DataFrame:
    """Normalised parts plus one ``finish`` marker per ``[DONE]`` line (keeps ``ts``)."""
    parts = normalise_responses(events.filter(F.col("payload") != DONE))
    done = events.filter(F.col("payload") == DONE).select(
        *[c for c in events.columns if c != "payload"], F.lit(0).alias("sub"),
        *[(F.lit("finish") if f == "type" else F.lit(None).cast("string")).alias(f) for f in PART_FIELDS])
    return parts.unionByName(done)


def _kind(types: pd.Series) -> pd.Series:
    """``text`` or ``reasoning`` of a part type, else missing."""
    return types.str.extract("^(text|reasoning)-", expand=False)


def _bounded(rows: pd.DataFrame, closing: bool) -> pd.DataFrame:
    """Parts with the starts and ends of delta runs between them.

    ``rows`` begins with the part before the batch (an empty one at a stream's
    beginning), which isn't given out again.  With ``closing`` a last delta is closed.
    """
    kind, delta = _kind(rows["type"]), rows["type"].isin(DELTAS)
    run_goes_on = (delta & delta.shift(fill_value=False) & (kind == kind.shift()) & (rows["id"] == rows["id"].shift()))
    place = pd.Series(np.arange(len(rows)), rows.index)
    empty = {f: None for f in PART_FIELDS}
    opens = delta & ~run_goes_on
    opens.iloc[0] = False
    closes = (delta & ~run_goes_on.shift(-1, fill_value=False))
    if not closing:
        closes.iloc[-1] = False
    starts = pd.DataFrame({**empty, "type": kind[opens] + "-start", "id": rows["id"][opens], "at": place[opens], "step": 1, "is_flush": False})
    ends = pd.DataFrame({**empty, "type": kind[closes] + "-end", "id": rows["id"][closes], "at": place[closes], "step": 3,
                         "is_flush": place[closes] == len(rows) - 1})
    own = rows.iloc[1:].assign(at=place.iloc[1:], step=2, is_flush=False)
    return pd.concat([x for x in (starts, own, ends) if len(x)] or [own]).sort_values(["at", "step"], kind="stable")


def _boundaries(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_type, last_id, n, ended = state.getOption or (None, None, 0, "[]")
    ended = set(json.loads(ended))
    parts = [] if state.hasTimedOut else list(frames)
    before = pd.DataFrame([{**{f: None for f in PART_FIELDS}, "type": last_type, "id": last_id}], dtype=object)
    batch = pd.concat(parts).sort_values(["seq", "sub"], kind="stable") if parts else before.iloc[:0].assign(seq=0, sub=0)
    finish = (batch["type"] == "finish").to_numpy()
    closing = state.hasTimedOut or bool(finish.any())
    if finish.any():
        batch = batch.iloc[:int(finish.argmax())]
    rows = pd.concat([before, batch[PART_FIELDS]], ignore_index=True).astype(object)
    out = _bounded(rows.where(rows.notna(), None), closing)
    out["ord"] = n + 1 + np.arange(len(out))
    # the first end of a (kind, id) is the last part that it has; a flush isn't subject to that
    name = (_kind(out["type"].astype("string")) + ":" + out["id"].astype("string")).astype(object)
    end = out["type"].isin(ENDS) & ~out["is_flush"]
    past = name.isin(ended) | (end.groupby(name).cumsum() - end > 0)
    keep = name.isna() | out["is_flush"] | ~past.fillna(False).astype(bool)
    if closing:
        state.remove()
    else:
        ended |= set(name[end])
        state.update((rows["type"].iloc[-1], rows["id"].iloc[-1], n + len(out), json.dumps(sorted(ended))))
        newest = int(pd.concat([p["event_ts"] for p in parts]).max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + RETAIN_MS)
    yield out[keep].assign(stream_id=key[0])[OUT_FIELDS].reset_index(drop=True)


def boundaries_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stateful per-stream boundaries + end-dedup over an event stream.

    ``events`` has (stream_id, chat_id, started_at, seq, payload, ts) and ends
    each stream with a ``[DONE]`` payload; a stream's events arrive in order.
    Keyed by stream, so state is one response's worth.
    """
    parts = (parts_with_markers(events).withColumn("event_ts", F.col("ts").cast("timestamp"))
             .withWatermark("event_ts", delay))
    return parts.groupBy("stream_id").applyInPandasWithState(
        _boundaries, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
