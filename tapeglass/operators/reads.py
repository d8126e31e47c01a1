"""Reports over stored rows: series, highlights, counters, job states, audits and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.functions.filters import freshness, review_label


def uniform_series(points: DataFrame, most: int = 2200) -> DataFrame:
    """(market_pk, at, value): each market's observations at even steps, gaps interpolated linearly.

    ``points``: market_pk, unix, value, rank. Of a second the highest rank counts, of a bucket the
    highest rank and then the latest. The step grows with the span (one minute up to a day) so that
    a market has at most ``most`` points or so; null values are ignored."""
    second = points.where("value IS NOT NULL").groupBy("market_pk", "unix").agg(F.max(F.struct("rank", "value")).alias("b")).select("market_pk", "unix", "b.rank", "b.value")
    span = F.col("last") - F.col("first")
    # Span up to seconds -> step; then the next steps until the points fit.
    base = F.when(span <= 86_400, 60).when(span <= 604_800, 300).when(span <= 2_592_000, 900).otherwise(3600)
    steps = [60, 300, 900, 3600, 21_600, 86_400]
    fits = F.array_min(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: (s >= F.col("base")) & (F.ceil(span / s) + 1 <= most)))
    spans = second.groupBy("market_pk").agg(F.min("unix").alias("first"), F.max("unix").alias("last")).withColumn("base", base)
    spans = spans.withColumn("step", F.coalesce(fits, F.lit(86_400)).cast("long"))
    low, high = F.floor(F.col("first") / F.col("step")) * F.col("step"), F.ceil(F.col("last") / F.col("step")) * F.col("step")
    grid = spans.select("market_pk", "step", F.explode(F.sequence(low, high, F.col("step"))).alias("at"))
    stepped = second.join(spans.select("market_pk", "step"), "market_pk")
    direct = stepped.groupBy("market_pk", (F.floor(F.col("unix") / F.col("step")) * F.col("step")).alias("at")).agg(F.max_by("value", F.struct("rank", "unix")).alias("direct"))
    seen = second.select("market_pk", F.col("unix").alias("at"), F.lit(1).alias("kind"), F.struct("unix", "value").alias("point"))
    asked = grid.select("market_pk", "at", F.lit(0).alias("kind"))
    both = asked.unionByName(seen, allowMissingColumns=True)
    order = Window.partitionBy("market_pk").orderBy("at", "kind")
    back = Window.partitionBy("market_pk").orderBy(F.desc("at"), F.desc("kind"))
    grown = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("old", F.last("point", ignorenulls=True).over(grown(order))).withColumn("new", F.last("point", ignorenulls=True).over(grown(back)))
    share = (F.col("at") - F.col("old.unix")) / (F.col("new.unix") - F.col("old.unix"))
    between = F.col("old.value") + (F.col("new.value") - F.col("old.value")) * share
    found = met.where("kind = 0").join(direct, ["market_pk", "at"], "left")
    value = F.coalesce("direct", between, "old.value", "new.value")
    return found.select("market_pk", "at", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("value"))


def trade_highlights(trades: DataFrame) -> DataFrame:
    """Prints with big_size (at least 25 contracts and the market's upper tenth) and big_jump (0.08 or
    more from the print just before)."""
    size = F.coalesce(F.col("count").cast("double"), F.lit(0.0))
    sizes = trades.select("market_pk", size.alias("size")).where("size > 0").groupBy("market_pk", "size").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("market_pk").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = sizes.groupBy("market_pk").agg(F.sum("n").alias("total"))
    place = F.least(F.col("total") - 1, F.floor(F.col("total") * 0.9))
    tenth = sizes.withColumn("upto", upto).join(totals, "market_pk").where(F.col("upto") > place).groupBy("market_pk").agg(F.min("size").alias("p90"))
    delta = F.col("yes_price") - F.lag("yes_price").over(Window.partitionBy("market_pk").orderBy("ts_us", "trade_pk"))
    marked = trades.withColumn("delta", F.round(delta, 9)).join(tenth, "market_pk", "left")
    big = size >= F.greatest(F.lit(25.0), F.coalesce("p90", F.lit(0.0)))
    return marked.select("market_pk", "trade_pk", big.alias("big_size"), F.coalesce(F.abs("delta") >= 0.08, F.lit(False)).alias("big_jump"), "delta")


def alert_stats(alerts: DataFrame) -> DataFrame:
    high = F.col("severity").isin("high", "critical")
    return alerts.groupBy("market_pk").agg(F.count("*").alias("alerts"), F.count_if(high).alias("high_alerts"), F.max("created_us").alias("last_alert_us"))


def job_states(log: DataFrame, stale_us: int, now_us: int) -> DataFrame:
    """One row per job of a run log (key, status, at_us, count, success, error): newest status and
    count, last success and error, counters, and freshness; a newest error is shown as error."""
    newest = F.struct("at_us", "run")
    state = log.groupBy("key").agg(
        F.max_by("status", newest).alias("status"), F.max("at_us").alias("latest_us"), F.max_by(F.col("count"), F.when(F.col("count").isNotNull(), newest)).alias("count"),
        F.max(F.when(F.col("success"), F.col("at_us"))).alias("last_success_us"), F.max(F.when(F.col("status") == "error", F.col("at_us"))).alias("last_error_us"),
        F.max_by("error", F.when(F.col("error").isNotNull(), newest)).alias("last_error"),
        F.count("*").alias("beats"), F.count_if("success").alias("successes"), F.count_if(F.col("status") == "error").alias("errors"),
    )
    health = F.when(F.col("status") == "error", "error").otherwise(freshness(F.col("latest_us"), F.col("count"), stale_us, now_us))
    return state.withColumn("health", health)


def pipeline_summary(states: DataFrame) -> DataFrame:
    """One row: jobs by health and the worst of them."""
    n = {h: F.count_if(F.col("health") == h) for h in ("healthy", "stale", "empty", "error")}
    worst = F.when(n["error"] > 0, "error").when(n["stale"] > 0, "stale").when(n["healthy"] > 0, "healthy").otherwise("empty")
    return states.agg(*[c.alias(h) for h, c in n.items()], worst.alias("overall"))


def signal_history(markets: DataFrame, flags: DataFrame, news: DataFrame, alerts: DataFrame, per_market: int = 5) -> DataFrame:
    """Closed markets with their best flags, best linked news and alert counts, those before the close
    counted apart, and a review label. ``flags``: market_pk, trade_pk, ts_us, score; ``news``:
    market_pk, news_id, score."""

    def best(rows: DataFrame, key: str, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("market_pk").orderBy(F.desc("score"), key))
        top = rows.withColumn("place", place).where(F.col("place") <= per_market)
        listed = F.array_sort(F.collect_list(F.struct("place", key)))  # at most per_market entries
        return top.groupBy("market_pk").agg(F.max("score").alias(f"best_{name}"), F.array_join(F.transform(listed, lambda r: r[key]), ",").alias(f"top_{name}"))

    close = markets.select("market_pk", "close_us")
    early = flags.join(close, "market_pk").where(F.col("ts_us") < F.col("close_us")).groupBy("market_pk").agg(F.count("*").alias("flags_before_close"))
    joined = markets
    for part in (best(flags, "trade_pk", "flag"), best(news.where("score > 0"), "news_id", "news"), alert_stats(alerts).drop("last_alert_us"), early):
        joined = joined.join(part, "market_pk", "left")
    known = joined.fillna(0, ["best_flag", "best_news", "alerts", "high_alerts", "flags_before_close"])
    return known.withColumn("label", review_label(F.col("best_flag"), F.col("best_news"), F.col("alerts"), F.col("high_alerts")))


def status_audit(local: DataFrame, upstream: DataFrame) -> DataFrame:
    """One row: markets checked, missing upstream, with another status, and final upstream but active here."""
    met = local.join(upstream.select("market_pk", F.col("status").alias("theirs")), "market_pk", "left")
    ours, theirs = F.col("status"), F.col("theirs")
    final = theirs.isin("closed", "settled", "finalized") & ours.isin("active", "open")
    return met.agg(
        F.count("*").alias("checked"), F.count_if(theirs.isNull()).alias("missing"), F.count_if(theirs.isNotNull() & ~ours.eqNullSafe(theirs)).alias("mismatched"),
        F.count_if(F.coalesce(final, F.lit(False))).alias("final_but_active"),
    )


def filled(first: DataFrame, second: DataFrame, newest: str, key: str, limit: int) -> DataFrame:
    """The newest ``limit`` of ``first``, filled up from ``second``."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    return both.orderBy("source", F.desc(newest), key).limit(limit)


def ordered_union(parts: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Distinct keys of the parts, earlier parts first and by key within, at most ``limit``."""
    rows = None
    for rank, part in enumerate(parts):
        ranked = part.select(key, F.lit(rank).alias("part"))
        rows = ranked if rows is None else rows.unionByName(ranked)
    return rows.groupBy(key).agg(F.min("part").alias("part")).orderBy("part", key).limit(limit)


def first_nonempty(first: DataFrame, second: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of ``first`` by ``order``, or of ``second`` where ``first`` has none."""
    top = first.withColumn("fallback", F.lit(False)).orderBy(*order).limit(limit)
    spare = second.withColumn("fallback", F.lit(True)).orderBy(*order).limit(limit)
    both = top.unionByName(spare)
    least = F.min("fallback").over(Window.partitionBy())  # at most 2 * limit rows
    return both.withColumn("least", least).where("fallback = least").drop("least")


def signals(links: DataFrame, limit: int, floor: float, scan: int) -> DataFrame:
    """The best links that point somewhere, one per article and event, among the ``scan`` best of all
    (both are the report's limits). ``links``: news_id, market_pk, event_id, news_us, score, label, weak."""
    order = [F.desc("score"), F.desc("news_us"), F.desc("news_id"), "market_pk"]
    best = links.where(F.col("score") >= floor).orderBy(*order).limit(scan)
    kept = best.where(~F.col("weak") & F.col("label").isin("supports_yes", "supports_no"))
    place = F.row_number().over(Window.partitionBy("news_id", "event_id").orderBy(*order))
    return kept.withColumn("place", place).where("place = 1").drop("place").orderBy(*order).limit(limit)
