"""Market-state alerts from the newest quotes of every market, and listings of what was flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.functions.scores import reason_code

LOOKBACK, SPREADS = 40, 30
LEAST_HISTORY, ROLLING_Z = 5, 2.8


def newest_z(series: str) -> Column:
    """Distance of the newest value of a newest-first array from the mean of the rest, in sample
    deviations; null with fewer than LEAST_HISTORY earlier values or no spread."""
    values, n = F.col(series), F.size(series) - 1
    rest = F.slice(values, 2, F.greatest(n, F.lit(1)))
    mean = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(rest, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)
    return F.when((n >= LEAST_HISTORY) & (var > 1e-18), F.abs(F.get(values, F.lit(0)) - mean) / F.sqrt(var))


def market_alerts(quotes: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """(market_pk, score, severity, reasons) of every market with quotes.

    Rolling tests compare the newest spread, price change and volume change with the
    market's recent ones; where they don't hit, fixed thresholds apply. Changes count only
    between quotes whose prices come from the same source. ``book`` adds (market_pk,
    book_points, high_churn, heavy_cancel). One shuffle on market_pk; arrays hold LOOKBACK
    values at most."""
    order = Window.partitionBy("market_pk").orderBy(F.desc("ts_us"), F.desc("quote_pk"))
    both = F.col("yes_bid").isNotNull() & F.col("yes_ask").isNotNull()
    mode = F.when(F.col("last_price").isNotNull(), "last").when(both, "mid")
    reference = F.when(F.col("last_price") > 0, F.col("last_price")).when(both, (F.col("yes_bid") + F.col("yes_ask")) / 2)
    recent = (
        quotes.withColumns({"place": F.row_number().over(order), "mode": mode, "reference": reference, "spread": F.col("yes_ask") - F.col("yes_bid")})
        .withColumns({f"before_{c}": F.lead(c).over(order) for c in ("mode", "reference", "volume")})
        .where(F.col("place") <= LOOKBACK)
    )
    inside = F.col("place") < LOOKBACK
    moved = F.when(inside & (F.col("mode") == F.col("before_mode")), F.col("reference") - F.col("before_reference"))
    traded = F.when(inside, (F.col("volume") - F.col("before_volume")).cast("double"))

    def series(value: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("place"), value.alias("v")))))
        return F.transform(listed, lambda x: x["v"])

    latest = F.min_by(F.struct("yes_bid", "yes_ask", "spread", moved.alias("moved"), traded.alias("traded")), "place")
    sums = recent.groupBy("market_pk").agg(
        series(F.when(F.col("place") <= SPREADS, F.col("spread"))).alias("spreads"), series(moved).alias("moves"), series(traded).alias("volumes"),
        latest.alias("l"), F.count("*").alias("n"),
    )
    if book is not None:
        sums = sums.join(book.select("market_pk", "book_points", "high_churn", "heavy_cancel"), "market_pk", "left")
    else:
        sums = sums.withColumns({"book_points": F.lit(0.0), "high_churn": F.lit(False), "heavy_cancel": F.lit(False)})
    hit = {s: F.coalesce(newest_z(s) > ROLLING_Z, F.lit(False)) for s in ("spreads", "moves", "volumes")}
    rated = sums.withColumns({f"{s}_hit": c for s, c in hit.items()})
    rules: list[tuple[Column, float, str]] = [
        (F.col("spreads_hit"), 2.5, "wide spread vs recent baseline"),
        (~F.col("spreads_hit") & (F.col("l.spread") > 0.12), 2.0, "wide spread"),
        ((F.col("l.yes_bid") == 0) & (F.col("l.yes_ask") == 0), 1.0, "empty visible book"),
        (F.col("moves_hit"), 3.0, "large price move vs recent"),
        (~F.col("moves_hit") & (F.abs("l.moved") >= 0.15), 3.0, "sharp price move"),
        (F.col("volumes_hit"), 2.5, "large volume change vs recent"),
        (~F.col("volumes_hit") & (F.col("l.traded") >= 50), 2.5, "large volume jump"),
        (~F.col("volumes_hit") & F.col("l.traded").between(25, 49.999999), 1.0, "moderate volume jump"),
        (F.col("n") < 2, 0.0, "limited history"),
        (F.col("high_churn"), 0.0, "high order-book event rate"),
        (F.col("heavy_cancel"), 0.0, "sustained cancel side"),
    ]
    score = sum((F.when(test, points).otherwise(0.0) for test, points, _ in rules), F.coalesce("book_points", F.lit(0.0)))
    reasons = F.array_compact(F.array(*[F.when(test, name) for test, _, name in rules]))
    scored = rated.select("market_pk", score.alias("score"), reasons.alias("reasons"))
    severity = F.when(F.col("score") >= 5, "high").when(F.col("score") >= 2.5, "medium").when(F.col("score") > 0, "low").otherwise("none")
    return scored.select("market_pk", "score", severity.alias("severity"), "reasons")


def reason_codes(flags: DataFrame, limit: int = 24) -> DataFrame:
    """(market_pk, codes): the distinct reason codes of a market in order of first appearance, the
    first ``limit`` of them. ``flags``: market_pk, trade_pk, reasons."""
    each = flags.select("market_pk", "trade_pk", F.posexplode("reasons").alias("place", "reason"))
    first = each.groupBy("market_pk", reason_code(F.col("reason")).alias("code")).agg(F.min(F.struct("trade_pk", "place")).alias("at"))
    listed = first.groupBy("market_pk").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("c"))  # one entry per distinct code
    return listed.select("market_pk", F.slice(F.transform("c", lambda x: x["code"]), 1, limit).alias("codes"))


def best_flags(flags: DataFrame, per_market: int = 5) -> DataFrame:
    """The highest scored prints of each market with their rank; ties by trade_pk."""
    rank = F.row_number().over(Window.partitionBy("market_pk").orderBy(F.desc("score"), "trade_pk"))
    return flags.withColumn("rank", rank).where(F.col("rank") <= per_market)

SPORTS = ("sports_outcome", "sports_derivative", "sports_prop")


def flag_severity(score: Column) -> Column:
    return F.when(score >= 8.5, "critical").when(score >= 7, "high").when(score >= 5, "medium").otherwise("low")


def diversified(flags: DataFrame, limit: int, sports: tuple[str, ...] = SPORTS) -> DataFrame:
    """``limit`` flags by score with variety: first one per market and three per category, then the
    rest; sports categories give four at most and one per event, a flag without an event counting as
    its market's. A report: its input is cut to the best max(25 * limit, 300) rows, and these are
    folded twice as one array, strictly and then not."""
    columns = flags.columns
    best = flags.orderBy(F.desc("score"), F.desc("ts_us"), "trade_pk").limit(max(25 * limit, 300))
    sport = F.coalesce(F.col("category").isin(*sports), F.lit(False))
    event = F.coalesce(F.concat(F.lit("e"), F.col("event_id").cast("string")), F.concat(F.lit("m"), F.col("market_pk").cast("string")))
    row = F.struct((-F.col("score")).alias("down"), (-F.col("ts_us")).alias("older"), "trade_pk", "market_pk", "category", sport.alias("sport"), event.alias("event"), F.struct(*columns).alias("flag"))
    listed = best.agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def held(chosen: Column, rule) -> Column:
        return F.size(F.filter(chosen, rule))

    def fold(rows: Column, start: Column, strict: bool) -> Column:
        def step(chosen: Column, r: Column) -> Column:
            free = ~r["sport"] | ((held(chosen, lambda x: x["sport"]) < min(limit, 4)) & ~F.exists(chosen, lambda x: x["sport"] & (x["event"] == r["event"])))
            if strict:
                apart = ~F.exists(chosen, lambda x: x["market_pk"] == r["market_pk"]) & (held(chosen, lambda x: x["category"].eqNullSafe(r["category"])) < 3)
            else:
                apart = ~F.exists(chosen, lambda x: x["trade_pk"] == r["trade_pk"])
            return F.when((F.size(chosen) < limit) & free & apart, F.concat(chosen, F.array(r))).otherwise(chosen)

        return F.aggregate(rows, start, step)

    first = fold(F.col("rows"), F.slice(F.col("rows"), 1, 0), True)
    both = listed.select("rows", first.alias("chosen")).select(fold(F.col("rows"), F.col("chosen"), False).alias("chosen"))
    return both.select(F.posexplode("chosen").alias("at", "c")).select("c.flag.*", (F.col("at") + 1).cast("long").alias("place"))


def system_counters(markets: DataFrame, trades: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: markets by status and prior, prints, contracts, and markets with flags."""
    m = markets.agg(
        F.count("*").alias("markets"), F.count_if(F.col("status") == "active").alias("active_markets"), F.count_if(F.col("prior").isin("high", "medium_high")).alias("high_prior_markets")
    )
    t = trades.agg(F.count("*").alias("prints"), F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("contracts"), F.count_distinct("market_pk").alias("traded_markets"))
    f = flags.agg(F.count_distinct("market_pk").alias("flagged_markets"))
    return m.join(t, F.lit(True)).join(f, F.lit(True))  # one row each


def baseline_of_market(markets: DataFrame, baselines: DataFrame) -> DataFrame:
    """Each market with the baseline of its category and subcategory, else of its category."""
    exact = baselines.select("category", "subcategory", F.struct("sample_size", "count_p95", "count_p99", "move_p95").alias("exact"))
    wide = baselines.where("subcategory = '*'").select("category", F.struct("sample_size", "count_p95", "count_p99", "move_p95").alias("wide"))
    joined = markets.join(exact, ["category", "subcategory"], "left").join(wide, "category", "left")
    found = F.coalesce("exact", "wide")
    scope = F.when(F.col("exact").isNotNull(), "exact").when(F.col("wide").isNotNull(), "category")
    return joined.withColumn("b", found).select("market_pk", scope.alias("scope"), "b.sample_size", "b.count_p95", "b.count_p99", "b.move_p95")
