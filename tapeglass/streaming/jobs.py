"""Streaming forms of ingest and bars. Each takes a streaming (or static) frame and returns one."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeglass.operators.folds import severity_rank


def new_prints(prints: DataFrame, late: str = "1 day") -> DataFrame:
    """Prints without replays: one per trade_id within the watermark."""
    return prints.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trade_id"])


def live_bars(prints: DataFrame, width: str = "5 minutes", late: str = "1 day") -> DataFrame:
    """Bars of prints per market and window, emitted when the watermark passes."""
    windowed = prints.withWatermark("ts", late).groupBy("market_id", F.window("ts", width))
    bars = windowed.agg(
        F.min_by("yes_price", "ts").alias("open_price"),
        F.max("yes_price").alias("high_price"),
        F.min("yes_price").alias("low_price"),
        F.max_by("yes_price", "ts").alias("close_price"),
        F.count("*").alias("trade_count"),
        F.sum("count").alias("trade_volume"),
    )
    return bars.select("market_id", F.col("window.start").alias("bucket_start"), *bars.columns[2:])


def live_book_activity(book: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sliding three-minute book activity per market, every minute."""
    change = ~F.col("is_snapshot")
    sums = book.withWatermark("ts", late).groupBy("market_id", F.window("ts", "3 minutes", "1 minute")).agg(
        F.count("*").alias("book_events"),
        F.count_if(change).alias("book_deltas"),
        F.coalesce(-F.sum(F.when(change & (F.col("delta") < 0), F.col("delta"))), F.lit(0)).alias("pull_volume"),
    )
    cancel = (F.col("pull_volume") > 75) & (F.col("book_deltas") > 30)
    return sums.select("market_id", F.col("window.end").alias("at"), "book_events", "book_deltas", "pull_volume", (F.col("book_events") > 400).alias("high_churn"), cancel.alias("heavy_cancel"))


def latest_in_batch(quotes: DataFrame) -> DataFrame:
    """The last quote of each market in a micro-batch, for use in foreachBatch before a merge."""
    rest = [c for c in quotes.columns if c != "market_id"]
    return quotes.groupBy("market_id").agg(F.max_by(F.struct(*rest), F.struct("seq", "ts")).alias("r")).select("market_id", "r.*")


def live_fold(rows: DataFrame, key: str, late: str, keep_ms: int, state: str, out: str, step: Callable, ties: tuple[str, ...] = ()) -> DataFrame:
    """A stream of what ``step(state or None, at_ms, row) -> (new state, values or None)`` gives for the
    rows of each key in event-time order. Values are appended to the row as the columns ``out``.

    Rows are held until the watermark (``late`` behind the newest row) has passed them and are then
    taken in the order of ts, those of one instant by the columns ``ties``; so the result does not
    depend on how they were dealt to micro-batches. Rows behind the watermark are discarded by Spark.
    State is one tuple per key and the held rows, as one Arrow buffer; it is dropped once the
    watermark has passed the key's last row by ``keep_ms``, so choose that so long that a later row
    is treated as a first one. Needs a column ts."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ([out] if out else []))
    names = [c.split()[0] for c in out.split(",")] if out else []
    blank = len(state.split(","))

    def fold(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        old = held.get if held.exists else (None,) * blank + (False, None)
        now, waiting = (tuple(old[:blank]) if old[blank] else None), unpacked(old[blank + 1])
        arrived = [] if held.hasTimedOut else list(batches)
        frames = [f for f in [waiting, *arrived] if f is not None and len(f)]
        passed = held.getCurrentWatermarkMs()
        rest = pd.concat(frames, ignore_index=True) if frames else None
        last = None
        if rest is not None:
            rest = rest.sort_values(["ts", *ties], kind="stable", ignore_index=True)
            micros = rest["ts"].to_numpy("datetime64[us]").astype("int64")
            due = int((micros <= passed * 1000).sum())
            kept, values = [], []
            for i, row in enumerate(rest.iloc[:due].to_dict("records")):
                now, found = step(now, int(micros[i] // 1000), row)
                if found is not None:
                    kept.append(i)
                    values.append(found)
            if kept:
                yield rest.iloc[kept].assign(**{n: [v[k] for v in values] for k, n in enumerate(names)})
            last = int(micros[-1] // 1000)
            rest = rest.iloc[due:]
        if (rest is None or not len(rest)) and held.hasTimedOut and last is None:
            held.remove()
            return
        open_rows = rest is not None and len(rest) > 0
        held.update((now or (None,) * blank) + (now is not None, packed(rest) if open_rows else None))
        wanted = int(rest["ts"].to_numpy("datetime64[ms]").astype("int64")[0]) + 1 if open_rows else (last or passed) + keep_ms
        held.setTimeoutTimestamp(max(wanted, passed + 1))

    watched = rows.withWatermark("ts", late)
    held_schema = f"{state}, known boolean, waiting string"
    return watched.groupBy(key).applyInPandasWithState(fold, schema, held_schema, "append", GroupStateTimeout.EventTimeTimeout)


def packed(rows: pd.DataFrame) -> str:
    """Rows as one Arrow buffer in text."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return base64.b64encode(sink.getvalue()).decode()


def unpacked(text: str | None) -> pd.DataFrame | None:
    if text is None:
        return None
    with pa.ipc.open_stream(base64.b64decode(text)) as reader:
        return reader.read_pandas()


def live_throttle(rows: DataFrame, key: str, interval_ms: int, bypass: str | None = None, late: str = "10 minutes", ties: tuple[str, ...] = ()) -> DataFrame:
    """A stream with at most one row per key in ``interval_ms`` of event time; rows whose boolean
    column ``bypass`` is true always pass and count as written."""

    def step(now: tuple | None, at: int, row: dict) -> tuple:
        if now is not None and at - now[0] < interval_ms and not (bypass and row[bypass]):
            return now, None
        return (at,), ()

    return live_fold(rows, key, late, interval_ms, "last long", "", step, ties)


def live_suppress(quotes: DataFrame, key: str, price: str, size: str, heartbeat_ms: int = 300_000, late: str = "10 minutes") -> DataFrame:
    """Quotes worth storing: the first of a key, any whose price moved by more than 0.0001 or size by
    more than 0.01 from the last stored one, and one after ``heartbeat_ms`` without."""

    def step(now: tuple | None, at: int, row: dict) -> tuple:
        new = (at, None if pd.isna(row[price]) else float(row[price]), None if pd.isna(row[size]) else float(row[size]))
        if now is not None and at - now[0] < heartbeat_ms:
            if all(close(a, b, t) for a, b, t in zip(now[1:], new[1:], (1e-4, 1e-2), strict=True)):
                return tuple(now), None
        return new, ()

    ties = ("quote_pk",) if "quote_pk" in quotes.columns else ()
    return live_fold(quotes, key, late, heartbeat_ms, "last long, price double, size double", "", step, ties)


def close(a: float | None, b: float | None, tolerance: float) -> bool:
    if a is None or b is None:
        return a is b
    return abs(a - b) <= tolerance + 1e-12


def live_episodes(alerts: DataFrame, key: str, least_score: float = 3.0, cooldown_ms: int = 1_800_000, late: str = "10 minutes", keep_ms: int = 86_400_000) -> DataFrame:
    """Alerts with their action on the stored history (see the batch form): created, updated, or deleted
    where an alert of the stored quote (column quote_pk, if there is one) falls below ``least_score``.
    A key's memory is kept for ``keep_ms`` after its last row."""
    quoted = "quote_pk" in alerts.columns

    def step(now: tuple | None, at: int, row: dict) -> tuple:
        created, rank, quote = now or (None, -1, None)
        mine = row["quote_pk"] if quoted and not pd.isna(row["quote_pk"]) else None
        again = mine is not None and created is not None and mine == quote
        if pd.isna(row["score"]) or row["score"] < least_score:
            return ((None, -1, None), ("deleted",)) if again else ((created, rank, quote), None)
        new = severity_rank(row["severity"])
        if not again and (created is None or new > rank or at - created >= cooldown_ms):
            return (at, new, mine), ("created",)
        return (created, new, mine), ("updated",)

    ties = ("alert_pk",) if "alert_pk" in alerts.columns else ()
    return live_fold(alerts, key, late, keep_ms, "created long, rank int, quote long", "action string", step, ties)


def live_asof(rows: DataFrame, versions: DataFrame, key: str, columns: list[str], late: str = "10 minutes", keep_ms: int = 86_400_000) -> DataFrame:
    """``rows`` with the ``columns`` of the key's newest version at or before each row's time. Both are
    streams with a ts; a version that comes in later but is older counts as if it had been there."""
    kinds = {f.name: f.dataType.simpleString() for f in versions.schema if f.name in columns}
    left = [c for c in rows.columns if c not in (key, "ts")]
    both = rows.select(key, "ts", F.lit(1).alias("kind"), *left, *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    right = versions.select(key, "ts", F.lit(0).alias("kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in left], *columns)

    def step(now: tuple | None, at: int, row: dict) -> tuple:
        if row["kind"] == 0:
            return tuple(None if pd.isna(row[c]) else row[c] for c in columns), None
        return now, (now or (None,) * len(columns))

    state = ", ".join(f"v{i} {kinds[c]}" for i, c in enumerate(columns))
    out = ", ".join(f"now_{c} {kinds[c]}" for c in columns)
    found = live_fold(both.unionByName(right), key, late, keep_ms, state, out, step, ("kind",))
    return found.select(*rows.columns, *[F.col(f"now_{c}").alias(c) for c in columns])
