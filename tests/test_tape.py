from decimal import Decimal

from pyspark.sql import functions as F

from tapeglass.operators import tape

TRADE = "market_pk long, trade_pk long, ts_us long, yes_price double, no_price double, count decimal(18,2), taker_side string"


def test_equal_sizes_leave_no_deviation(spark):
    """A market's history of equal values has a deviation of 0, so no print stands out by it."""
    sizes = [Decimal(i * 317 % 20000) / 100 for i in range(1, 60)]
    rows = [(m, 100 * m + i, 60_000_000 * i, 0.5, 0.5, size if i < 52 else Decimal(500), "yes") for m, size in enumerate(sizes) for i in range(53)]
    got = tape.score_prints(spark.createDataFrame(rows, TRADE))
    assert got.where(F.col("size_z") > 0).count() == 0


def test_batches_do_not_cut_a_history(spark):
    """Prints read in batches of any length score alike, with several markets, a null one and null values."""
    rows = []
    for i in range(900):
        market, size, price = (None, 1, 2, 3)[i * 7 % 900 // 300 + (i % 2 if i % 3 else 0)], i * 37 % 90 + 1, (i * 53 % 97 + 1) / 100
        rows.append((market, i, i * i * 131 % 4_000_000_000, None if i % 11 == 0 else price, None if i % 11 == 0 else 1 - price, None if i % 13 == 0 else Decimal(size), ("yes", "no", None)[i % 3]))
    trades, found = spark.createDataFrame(rows, TRADE), []
    for most in (10_000, 7, 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        found.append({r.trade_pk: r for r in tape.score_prints(trades).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found[0]) == 900 and found[0] == found[1] == found[2]
    last, moves = {}, {}
    for market, pk, _, price, *_ in sorted(rows, key=lambda r: (r[0] or 0, r[2], r[1])):
        moves[pk] = None if price is None or market not in last else abs(price - last[market])
        if price is not None:
            last[market] = price
    assert {pk: r.price_delta for pk, r in found[0].items()} == moves


def test_history_is_read_over_one_sort(spark):
    """Only prints as they are get sorted; rows with arrays of their history in a sort made tasks large."""
    plan = tape.score_prints(spark.createDataFrame([(1, 1, 1, 0.5, 0.5, Decimal(1), "yes")], TRADE))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1
