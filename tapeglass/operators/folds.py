"""Ordered passes with state per key, where the next decision depends on the last kept row.

Rows are dealt by key and sorted inside the partition; one pass keeps the state of the
current key only, so memory does not grow with a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

SEVERITY = ("none", "low", "medium", "high", "critical")


def severity_rank(severity: str | None) -> int:
    """0 for none, unknown and null."""
    return SEVERITY.index(severity) if severity in SEVERITY else 0


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Callable[[Any], Any]], extra: str = "") -> DataFrame:
    """``df`` with those rows for which the step of the key's fold returns a value other than None.

    ``make`` gives a fresh step function for each key; it is called with every row, as a dict of
    the columns, in order. With ``extra`` ("name type") the returned value becomes that column."""
    columns = list(df.columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ([extra] if extra else []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = object(), None
        for rows in batches:
            kept, values = [], []
            fields = [rows[c].tolist() for c in columns]
            for i, row in enumerate(zip(*fields, strict=True)):
                row = dict(zip(columns, row, strict=True))
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, step = key, make()
                value = step(row)
                if value is not None:
                    kept.append(i)
                    values.append(value)
            out = rows.iloc[kept]
            yield out.assign(**{extra.split()[0]: values}) if extra else out

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*columns).mapInPandas(run, schema)


def same(a: Any, b: Any, tolerance: float) -> bool:
    if pd.isna(a) or pd.isna(b):
        return bool(pd.isna(a) and pd.isna(b))
    return abs(float(a) - float(b)) <= tolerance + 1e-12


def suppress_unchanged(quotes: DataFrame, prices: list[str], sizes: list[str], heartbeat_us: int = 300_000_000) -> DataFrame:
    """Quotes worth storing: the first of a market, any that differs from the last stored one by more
    than 0.0001 in a price or 0.01 in a size, and one after ``heartbeat_us`` without."""

    def make():
        last: list[Any] = [None]

        def step(row: Any) -> bool | None:
            old = last[0]
            if old is not None and row["ts_us"] - old["ts_us"] < heartbeat_us:
                if all(same(row[c], old[c], 1e-4) for c in prices) and all(same(row[c], old[c], 1e-2) for c in sizes):
                    return None
            last[0] = row
            return True

        return step

    return ordered_fold(quotes, ["market_pk"], ["ts_us", "quote_pk"], make)


def throttle(rows: DataFrame, keys: list[str], order: list[str], interval_us: int | str, bypass: str | None = None) -> DataFrame:
    """At most one row per key in ``interval_us``, which may be a column; rows whose boolean column
    ``bypass`` is true always pass (and count as written). Settings of it are the history and
    projection gates, and the alert gate with the interval of a market's tier."""

    def make():
        last: list[int | None] = [None]

        def step(row: Any) -> bool | None:
            gap = row[interval_us] if isinstance(interval_us, str) else interval_us
            if last[0] is not None and row["ts_us"] - last[0] < gap and not (bypass and row[bypass]):
                return None
            last[0] = row["ts_us"]
            return True

        return step

    return ordered_fold(rows, keys, order, make)


def alert_episodes(alerts: DataFrame, least_score: float = 3.0, cooldown_us: int = 1_800_000_000) -> DataFrame:
    """What each alert does to its market's stored history: created on the first alert, on a higher
    severity than the stored one, or ``cooldown_us`` after the stored one was created; else updated,
    which takes the alert's severity into the stored one. Alerts under ``least_score`` or with a null
    score do nothing, but where there is a column quote_pk and the stored alert is of the same
    quote, it is deleted, and with it all memory of it. Unknown severities count as none."""
    quoted = "quote_pk" in alerts.columns

    def make():
        stored: list[Any] = [None, -1, None]  # created at, severity rank, quote

        def step(row: dict) -> str | None:
            quote = row["quote_pk"] if quoted else None
            again = quoted and not pd.isna(quote) and stored[0] is not None and quote == stored[2]
            if pd.isna(row["score"]) or row["score"] < least_score:
                if not again:
                    return None
                stored[:] = [None, -1, None]
                return "deleted"
            rank = severity_rank(row["severity"])
            if not again and (stored[0] is None or rank > stored[1] or row["created_us"] - stored[0] >= cooldown_us):
                stored[:] = [row["created_us"], rank, quote]
                return "created"
            stored[1:] = [rank, quote]
            return "updated"

        return step

    return ordered_fold(alerts, ["market_pk"], ["created_us", "alert_pk"], make, "action string")
