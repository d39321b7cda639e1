"""Event streams. State is bounded by the delay of the caller; rows that come later than that are late and not counted.

The default delay suits a live source. A replay of stored files in any order passes ``REPLAY``, under which no row is late, and
closes its last windows through ``run_to_table``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"
REPLAY = "36500 days"
DEBOUNCE = "250 milliseconds"


def _held(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    parts = [(f["arrival"].to_numpy(np.int64), f["version"].to_numpy(np.int64)) for f in rows]
    arrival, version = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(arrival, kind="stable")
    arrival, version = arrival[order], version[order]
    before = np.empty_like(version)
    before[1:] = version[:-1]
    new = version != before
    new[0] = not state.exists or state.get[0] != version[0]
    state.update((int(version[-1]),))
    yield pd.DataFrame({"session_id": key[0], "version": version[new], "arrival": arrival[new]})


def new_versions(events: DataFrame) -> DataFrame:
    """Of (session_id, version, arrival) the events that bring another version than the one the session holds.

    The state is one number per session for ever, so neither a delay nor a watermark is involved. Of a micro-batch, whose size
    the source bounds, two numbers per event of a session are held at a time.
    """
    return events.select("session_id", "version", "arrival").groupBy("session_id").applyInPandasWithState(
        _held, "session_id long, version long, arrival long", "version long", "append", GroupStateTimeout.NoTimeout
    )


def session_counts(events: DataFrame, width: str, session: str = "session_id", time: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Events per session and time window."""
    windowed = events.withWatermark(time, delay).groupBy(F.window(time, width), session)
    return windowed.agg(F.count(F.lit(1)).alias("n_events")).select(F.col("window.start").alias("window_start"), session, "n_events")


def debounced(
    events: DataFrame, value: str, session: str = "session_id", time: str = "ts", gap: str = DEBOUNCE, delay: str = WATERMARK
) -> DataFrame:
    """The last change of every burst: events of a session closer than the gap are one burst."""
    bursts = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), session)
    return bursts.agg(F.max_by(value, time).alias(value), F.max(time).alias("sent_for"), F.count(F.lit(1)).alias("n_changes")).select(
        session, "sent_for", value, "n_changes"
    )


def order_status(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """Order status changes with the table of their session (stored sessions, read anew for every batch).

    Created orders carry their amount.
    """
    joined = changes.join(tables.select("session_id", "table_id"), "session_id", "left")
    amount = F.when(F.col("action") == "created", F.col("total_amount"))
    return joined.select("session_id", "table_id", "order_id", "status", "action", amount.alias("total_amount"))
