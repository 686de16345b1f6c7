"""Articles that arrive again: the first date, outlet and author, the last text.

The state of a link holds two copies, the earliest and the latest by time, so the outcome
does not depend on the order of arrival. A timer in event time clears a link that has not
been seen for a while; what was written of it stays in the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from weekloom.sources import buckets

STATE = "first_at long, first string, last_at long, last string"
# Times keep their microseconds on the way through the state.
JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def first_and_last(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    """One row per key and micro-batch: the earliest and the latest copy so far. A key
    whose timer has run out gives no row and loses its state."""
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else (None, None, None, None)
    first = None if held[0] is None else (held[0], held[1])
    last = None if held[2] is None else (held[2], held[3])
    for part in rows:
        for at, one, other in zip(part["at_"].tolist(), part["first_"].tolist(), part["last_"].tolist()):
            if first is None or at < first[0]:
                first = (at, one)
            if last is None or at > last[0]:
                last = (at, other)
    state.update((*first, *last))
    state.setTimeoutTimestamp(max(last[0] // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"key_": [key[0]], "first_": [first[1]], "last_": [last[1]]})


def refreshed(
    rows: DataFrame,
    key: str,
    first_cols: list[str],
    last_cols: list[str],
    *,
    ts_col: str = "published_at",
    delay: str = "1 day",
    idle_days: float = 30.0,
) -> DataFrame:
    """A row per key whenever it arrives: ``first_cols`` of its earliest copy, ``last_cols``
    of its latest. Of copies with the same time the one met first counts.

    Rows without a key or time are left out. A copy later than the watermark is dropped; a
    link idle for ``idle_days`` is forgotten, so a copy after that counts as a first one.
    """
    timed = rows.withColumn("ts_", F.col(ts_col).cast("timestamp")).where(
        F.col(key).isNotNull() & F.col("ts_").isNotNull()
    )
    packed = timed.withWatermark("ts_", delay).select(
        F.col(key).cast("string").alias("key_"),
        "ts_",
        F.unix_micros("ts_").alias("at_"),
        F.to_json(F.struct(*first_cols), JSON).alias("first_"),
        F.to_json(F.struct(*last_cols), JSON).alias("last_"),
    )
    idle_ms = int(idle_days * 86_400_000)
    out = packed.groupBy("key_").applyInPandasWithState(
        lambda key, parts, state: first_and_last(key, parts, state, idle_ms),
        "key_ string, first_ string, last_ string",
        STATE,
        "update",
        "EventTimeTimeout",
    )
    one, other = rows.select(*first_cols).schema, rows.select(*last_cols).schema
    return out.select(
        F.col("key_").cast(rows.schema[key].dataType).alias(key),
        F.from_json("first_", one, JSON).alias("first_"),
        F.from_json("last_", other, JSON).alias("last_"),
    ).select(
        key,
        *[F.col(f"first_.{c}").alias(c) for c in first_cols],
        *[F.col(f"last_.{c}").alias(c) for c in last_cols],
    )


def refresh_stream(
    rows: DataFrame,
    base: str,
    key: str,
    first_cols: list[str],
    last_cols: list[str],
    *,
    checkpoint: str,
    trigger: dict | None = None,
    n_buckets: int = 64,
    **options,
) -> StreamingQuery:
    """Keep a bucketed table (see ``sources.buckets``) of refreshed rows; ``options`` as in
    ``refreshed``. A batch that runs again after a failure gives the same table."""
    arriving = refreshed(rows, key, first_cols, last_cols, **options)

    def apply(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        if buckets.current(session, base) is None:
            buckets.create_buckets(session, base, batch, [key], buckets=n_buckets)
        else:
            buckets.merge_buckets(session, base, batch, [*first_cols, *last_cols])

    return (
        arriving.writeStream.outputMode("update").foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
