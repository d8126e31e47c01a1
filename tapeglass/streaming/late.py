"""Bars of a stream in stored tables, rows that come too late for it and their replay, and its counters."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tapeglass.sources.versions import RunLog, Versions

PARTS = "market_id string, bucket long, first_us long, last_us long, open_price double, high_price double, low_price double, close_price double, trade_count long, trade_volume double"


def bar_parts(prints: DataFrame, width_us: int) -> DataFrame:
    """Bars of prints (market_id, ts_us, yes_price, count) as parts that can be added up: with the times
    of the prints that open and close them. Prints of one instant open and close by price."""
    first, last = F.struct("ts_us", "yes_price"), F.struct("ts_us", "yes_price")
    bucket = (F.floor(F.col("ts_us") / width_us) * width_us).cast("long")
    bars = prints.groupBy("market_id", bucket.alias("bucket")).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.min(first)["yes_price"].alias("open_price"), F.max("yes_price").alias("high_price"),
        F.min("yes_price").alias("low_price"), F.max(last)["yes_price"].alias("close_price"), F.count("*").alias("trade_count"), F.sum("count").cast("double").alias("trade_volume"),
    )
    return bars.select(*[f.strip().split()[0] for f in PARTS.split(",")])


def merged_bars(parts: DataFrame) -> DataFrame:
    """One bar per market and bucket from any number of parts of it, in any order."""
    return parts.groupBy("market_id", "bucket").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.min(F.struct("first_us", "open_price"))["open_price"].alias("open_price"), F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"), F.max(F.struct("last_us", "close_price"))["close_price"].alias("close_price"), F.sum("trade_count").alias("trade_count"), F.sum("trade_volume").alias("trade_volume"),
    )


def bar_sink(versions: Versions, name: str, width_us: int, late_us: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores bars: parts of a micro-batch are added to bar_parts, rows more
    than ``late_us`` behind the newest row of all batches before go to late_prints, and progress has
    the newest time. A batch that is run again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select("market_id", "ts_us", "yes_price", "count").persist()
        try:
            newest = versions.table("progress").agg(F.max("newest_us")).first()[0] if versions.has("progress") else None
            edge = None if newest is None else newest - late_us
            timely = batch if edge is None else batch.where(F.col("ts_us") >= edge)
            late = batch.limit(0) if edge is None else batch.where(F.col("ts_us") < edge)
            seen = batch.agg(F.max("ts_us").alias("newest_us")).select(F.greatest("newest_us", F.lit(newest)).alias("newest_us"))
            versions.commit(f"{name}-{batch_id}", replace={"progress": seen}, append={"bar_parts": bar_parts(timely, width_us), "late_prints": late})
        finally:
            batch.unpersist()

    return write


def replay_late(versions: Versions, run_id: str, width_us: int) -> bool:
    """The late rows as parts of bars, and bars put together anew; the side table is empty then."""
    late = versions.table("late_prints")
    every = versions.table("bar_parts").unionByName(bar_parts(late, width_us))
    return versions.commit(run_id, replace={"bar_parts": merged_bars(every), "late_prints": late.limit(0)})


def counted(stream: DataFrame, name: str, kind: str, kept: str) -> DataFrame:
    """``stream`` with counters observed under ``name``: rows received, kept (the boolean column
    ``kept``) and dropped, in all and by each value of KINDS in the column ``kind``."""
    held = F.coalesce(F.col(kept), F.lit(False))
    columns = [F.count(F.lit(1)).alias("received"), F.count_if(held).alias("kept"), F.count_if(~held).alias("dropped")]
    for k in KINDS:
        mine = F.coalesce(F.col(kind) == k, F.lit(False))
        columns += [F.count_if(mine).alias(f"received_{k}"), F.count_if(mine & ~held).alias(f"dropped_{k}")]
    return stream.observe(name, *columns)


KINDS = ("trade", "ticker", "orderbook_snapshot", "orderbook_delta")


class CounterLog(StreamingQueryListener):
    """Writes the counters of :func:`counted` to a run log: one record per query progress and name."""

    def __init__(self, log: RunLog) -> None:
        self.log = log

    def onQueryStarted(self, event) -> None:  # noqa: N802
        at = datetime.fromisoformat(event.timestamp.replace("Z", "+00:00"))
        self.log.append([{"key": event.name or str(event.id), "status": "starting", "at_us": int(at.timestamp() * 1e6), "run": str(event.runId)}])

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        at = int(datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")).timestamp() * 1e6)
        found = p.get("observedMetrics", {})
        self.log.append(
            {"key": name, "status": "running", "at_us": at, "count": values.get("received"), "success": True, "run": f"{p['runId']}-{p['batchId']:010d}", "metadata": values} for name, values in found.items()
        )

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.log.append([{"key": str(event.id), "at_us": int(datetime.now().timestamp() * 1e6), "error": event.exception, "run": str(event.runId)}])
