"""Scores of single prints and bursts against a market's own tape, over one sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tapeglass.functions.scores import notional

HISTORY = 50
CLUSTER_US = 30_000_000


def windows(values: np.ndarray, known: np.ndarray, run: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the HISTORY known values of its market before it, oldest first and NaN where there are
    fewer, their number, and the tail for the next rows. ``run`` numbers the markets of the rows from 0;
    ``tail`` has the last known values before the first row."""
    kept, runs = np.concatenate([tail, values[known]]), np.concatenate([np.zeros(len(tail), dtype=np.int64), run[known]])
    sizes = np.bincount(runs, minlength=run[-1] + 1)
    before = np.cumsum(sizes) - sizes
    start = before + HISTORY * np.arange(len(sizes))
    flat = np.full(len(kept) + HISTORY * len(sizes), np.nan)
    flat[start[runs] + HISTORY + np.arange(len(kept)) - before[runs]] = kept
    seen = len(tail) + np.cumsum(known) - known - before[run]
    return sliding_window_view(flat, HISTORY)[start[run] + seen], np.minimum(seen, HISTORY), kept[runs == run[-1]][-HISTORY:]


def median(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the ``n`` values in each row; the rest of a row is NaN."""
    ordered, half, at = np.sort(rows, axis=1), np.minimum(n // 2, HISTORY - 1), np.arange(len(n))
    return np.where(n % 2 == 1, ordered[at, half], (ordered[at, np.maximum(half - 1, 0)] + ordered[at, half]) / 2)


def robust_z(value: np.ndarray, past: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distance from the median in scaled MADs, or in sample deviations if the MAD is 0; 0 to 6, and 0 with
    fewer than three earlier values. Squares are summed around a running mean, as equal values leave a
    false rest in a difference of sums."""
    mid = median(past, n)
    spread = median(np.abs(past - mid[:, None]), n)
    count, mean, squares = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for x in past.T:
        there = ~np.isnan(x)
        count += there
        moved = np.where(there, mean + (x - mean) / np.maximum(count, 1), mean)
        squares += np.where(there, (x - mean) * (x - moved), 0.0)
        mean = moved
    std, off = np.sqrt(squares / (n - 1)), np.abs(value - mid)
    z = np.where(spread > 1e-12, off / (1.4826 * spread), np.where(std > 1e-9, off / std, 0.0))
    return np.where((n >= 3) & ~np.isnan(value), np.minimum(6.0, z), 0.0)


def new_market(batch: pa.RecordBatch, keys: list[str], last: list | None) -> np.ndarray:
    """Whether a row has other keys than the row before it; nulls are alike."""
    first = np.zeros(batch.num_rows, dtype=bool)
    for c in keys:
        here = batch.column(c)
        a, b = here[1:], here[:-1]
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        first[1:] |= other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    first[0] = last != [batch.column(c)[0].as_py() for c in keys]
    return first


def against_history(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds price_delta, size_z, move_z, cluster and steady to sorted prints. Between batches it holds the
    last HISTORY values of one market."""

    def numbers(batch: pa.RecordBatch, c: str) -> np.ndarray:
        return pc.cast(batch.column(c), pa.float64()).to_numpy(zero_copy_only=False).astype(float)  # null as NaN

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, last = np.empty(0), None
        sizes, deltas, times, sides, price = none, none, none, none, np.nan
        for batch in batches:
            if not batch.num_rows:
                continue
            first = new_market(batch, keys, last)
            if first[0]:
                sizes, deltas, times, sides, price = none, none, none, none, np.nan
            first[0] = False
            run, here = np.cumsum(first), np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(first, here, 0))
            size, paid, ts, side = (numbers(batch, c) for c in ("log_size", "yes_price", "ts_us", "side_code"))
            # The last known price before a row, of the row's market.
            at = np.maximum.accumulate(np.where(~np.isnan(paid), here, -1))
            at = np.concatenate([[-1], at[:-1]])
            delta = np.abs(paid - np.where(at >= begin, paid[at], np.where(run == 0, price, np.nan)))
            if at[-1] >= begin[-1] or not np.isnan(paid[-1]):
                price = paid[-1] if not np.isnan(paid[-1]) else paid[at[-1]]
            elif run[-1] > 0:
                price = np.nan
            every = np.ones(len(here), dtype=bool)
            with np.errstate(invalid="ignore", divide="ignore"):
                past, n, sizes = windows(size, ~np.isnan(size), run, sizes)
                size_z = robust_z(size, past, n)
                past, n, deltas = windows(delta, ~np.isnan(delta), run, deltas)
                move_z = robust_z(delta, past, n)
                when, _, times = windows(ts, every, run, times)
                took, _, sides = windows(side, every, run, sides)
                near = when >= (ts - CLUSTER_US)[:, None]
                recent = near.sum(axis=1) + 1
                same = ((near & (took == side[:, None])).sum(axis=1) + 1) / recent
                cluster = np.where((side > 0) & ~np.isnan(ts) & (recent >= 3) & (same >= 0.65), np.minimum(3.0, (recent - 2) * same / 2), 0.0)
                sided, alike = (took[:, 1:] > 0).sum(axis=1) + (side > 0), (took[:, 1:] == side[:, None]).sum(axis=1) + 1
            steady = (side > 0) & (sided >= 4) & (alike >= 0.9 * sided)
            last = [batch.column(c)[-1].as_py() for c in keys]
            more = {"price_delta": pa.array(delta, from_pandas=True), "size_z": pa.array(size_z), "move_z": pa.array(move_z), "cluster": pa.array(cluster), "steady": pa.array(steady)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])

    return read


def multiplier(dollars: Column, cluster: Column, sudden: Column) -> Column:
    """Weight of a print by its dollars; sudden clusters of small bets have a floor."""
    # Dollars below -> weight.
    ladder = reduce(lambda c, x: c.when(dollars < x[0], x[1]), [(10, 0.03), (25, 0.05), (100, 0.20), (250, 0.45), (1000, 1.0), (5000, 1.12)], F.when(dollars.isNull(), 1.0))
    base = ladder.otherwise(1.3)
    strong = sudden & (cluster >= 3.0)
    floor = F.when(strong & (dollars < 25), 0.35).when(strong & (dollars < 100), 0.55).when(strong & (dollars < 250), 0.75).otherwise(0.0)
    return F.greatest(base, floor)


def score_prints(trades: DataFrame, keys: tuple[str, ...] = ("market_pk",)) -> DataFrame:
    """Adds score (0 to 10), reasons and the features behind them to every print.

    Input rows need market_pk, trade_pk, ts_us, count, yes_price, no_price, taker_side.
    Prints with neither price nor size get a null score. One shuffle on ``keys`` and one sort of the
    prints as they are; what is read of a print's history are the last HISTORY prints, in numpy over
    batches of rows, so a busy market costs a long sort, not memory."""
    by = list(keys)
    side = F.lower(F.coalesce("taker_side", F.lit("")))
    tape = trades.withColumns({"log_size": F.log1p(F.col("count").cast("double")), "side_code": F.when(side == "yes", 1).when(side == "no", 2).otherwise(0)})
    ordered = tape.repartition(*by).sortWithinPartitions(*by, "ts_us", "trade_pk")
    found = StructType([*ordered.schema.fields, *[StructField(c, DoubleType()) for c in ("price_delta", "size_z", "move_z", "cluster")], StructField("steady", BooleanType())])
    tape = ordered.mapInArrow(against_history(by), found)
    dollars = notional(side, F.col("count").cast("double"), F.col("yes_price"), F.col("no_price"))
    tape = tape.withColumns({"raw_move": F.least(F.lit(4.0), F.coalesce("price_delta", F.lit(0.0)) / 0.035), "dollars": dollars})
    sudden = (F.col("cluster") >= 1.5) & ~F.col("steady")
    tape = tape.withColumn("sudden", sudden).withColumn("multiplier", multiplier(F.col("dollars"), F.col("cluster"), F.col("sudden")))
    counted = F.when((F.col("size_z") >= 1.5) | (F.col("raw_move") >= 0.5) | F.col("sudden"), F.col("cluster")).otherwise(0.0)
    tape = tape.withColumn("counted_cluster", counted)
    raw = 0.45 * F.col("size_z") + 0.35 * F.col("move_z") + 0.15 * F.col("raw_move") + 0.20 * F.col("counted_cluster")
    small = F.col("sudden") & (F.col("cluster") >= 3.0) & (F.col("dollars") < 250)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("size_z") >= 2.5, "large_size_vs_recent"),
            F.when((F.col("move_z") >= 2.5) | (F.col("raw_move") >= 2.0), "price_jump_vs_recent"),
            F.when(F.col("counted_cluster") >= 1.5, "same_side_cluster"),
            F.when(F.col("dollars") < 100, "low_notional_discount").when(F.col("dollars") < 250, "modest_notional_discount")
            .when(F.col("dollars") < 1000, None).when(F.col("dollars") < 5000, "meaningful_notional").when(F.col("dollars") >= 5000, "large_notional"),
            F.when(small, "small_bet_cluster"),
        )
    )
    known = F.col("count").isNotNull() | F.col("yes_price").isNotNull()
    score = F.when(known, F.round(F.least(F.lit(10.0), raw * F.col("multiplier") / 4.5 * 10.0), 3))
    dropped = ["counted_cluster", "sudden", "steady", "side_code", "log_size"]
    return tape.withColumn("score", score).withColumn("reasons", F.when(known, reasons)).drop(*dropped)


def burst_prints(trades: DataFrame, window_us: int = CLUSTER_US) -> DataFrame:
    """Per print: prints of the market in the window from it on (window_count), how many of them
    took yes and no, and a 0 to 10 cluster score. Of prints at one instant the later ones do
    not see the earlier ones."""
    by_row = Window.partitionBy("market_pk").orderBy("ts_us", "trade_pk")
    ahead = Window.partitionBy("market_pk").orderBy("ts_us").rangeBetween(0, window_us)
    tied = Window.partitionBy("market_pk", "ts_us").orderBy("trade_pk").rowsBetween(Window.unboundedPreceding, -1)
    side = F.lower(F.coalesce("taker_side", F.lit("")))
    tape = trades.select(
        "market_pk", "trade_pk", "ts_us",
        (F.count("*").over(ahead) - F.count("*").over(tied)).alias("window_count"),
        *[(F.count_if(side == s).over(ahead) - F.count_if(side == s).over(tied)).alias(f"{s}_count") for s in ("yes", "no")],
        F.row_number().over(by_row).alias("place"),
    )
    share = F.greatest("yes_count", "no_count") / F.col("window_count")
    cluster = F.when(F.col("window_count") >= 2, F.round(F.least(F.lit(10.0), 1.2 * (F.col("window_count") - 1) * (0.5 + 0.5 * share)), 3)).otherwise(0.0)
    return tape.withColumn("cluster_score", cluster)


def burst_summary(bursts: DataFrame) -> DataFrame:
    """Per market: the fullest window, its score and the side that dominates it most; of equal
    windows the first decides. Windows where under 60 % of the prints have a side say nothing."""
    most = bursts.groupBy("market_pk").agg(F.max("window_count").alias("largest_window"))
    full = bursts.join(most, "market_pk").where("window_count = largest_window AND window_count >= 2 AND yes_count + no_count >= 0.6 * window_count")
    side = F.when(F.col("yes_count") >= F.col("no_count"), "yes").otherwise("no")
    best = full.groupBy("market_pk").agg(F.max_by(side, F.struct(F.greatest("yes_count", "no_count"), -F.col("place"))).alias("dominant_side"))
    score = F.when(F.col("largest_window") > 1, F.round(F.least(F.lit(10.0), 2 * F.sqrt(F.col("largest_window") - 1)), 3)).otherwise(0.0)
    return most.join(best, "market_pk", "left").select("market_pk", "largest_window", score.alias("burst_score"), "dominant_side")
