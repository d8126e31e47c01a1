"""Contextual score of prints: components from quotes, later prices, peers, news and siblings, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
FLAG_SCORE, TRIGGERED_SCORE, CASE_SCORE = 3.0, 7.0, 8.5


def context_cap(dollars: Column, cluster: Column) -> Column:
    """Highest context score of a print of few dollars; null where there is none."""
    strong = cluster >= 3.0
    # Dollars below -> cap with a strong cluster, without one.
    caps = [(10, 2.5, 1.5), (25, 3.0, 2.0), (100, 4.5, 3.5), (250, 6.0, None)]
    found = F.when(dollars.isNull(), F.lit(None).cast("double"))
    for below, with_cluster, without in caps:
        found = found.when(dollars < below, F.when(strong, F.lit(with_cluster)).otherwise(F.lit(without).cast("double")))
    return found


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def capped(most: float, value: Column) -> Column:
    return F.least(F.lit(most), value)


def context_scores(prints: DataFrame, public_sports: Column | None = None) -> DataFrame:
    """Adds context_score (0 to 10), its seven components and context_reasons to prints.

    Needs market_pk, trade_pk, ts_us, count, yes_price, taker_side; local_score, cluster, dollars
    (of the tape score); prev_price (the last earlier print's, else null); later_price; ref,
    spread, open_interest, volume_24h of the quote at the print (null without one); count_p95,
    count_p99, move_p95 of its baseline; hours_to_news, hours_since_news; sibling_median,
    sibling_count; prior, close_us. Prints without a price get a null score."""
    side = F.lower(F.coalesce("taker_side", F.lit("")))
    direction = F.when(side == "yes", 1.0).when(side == "no", -1.0).otherwise(0.0)
    size = F.col("count").cast("double")
    before = F.coalesce("prev_price", "ref", "yes_price")
    p = prints.withColumns(
        {
            "delta": F.abs(F.col("yes_price") - before),
            "impact": direction * (F.col("yes_price") - before),
            "through": direction * (F.coalesce("later_price", "yes_price") - before),
            "of_interest": ratio(size, F.col("open_interest").cast("double")),
            "of_volume": ratio(size, F.col("volume_24h").cast("double")),
        }
    ).withColumn("cents", F.when(size > 0, F.col("delta") * 10_000 / size))
    p = p.withColumns({c: F.round(c, 9) for c in ("delta", "impact", "through", "cents")})  # thresholds must not hang on the last bit
    zero, yes = F.lit(0.0), lambda c: F.coalesce(c, F.lit(False))
    delta, impact, through = F.col("delta"), F.col("impact"), F.col("through")
    heavy = F.col("dollars").isNull() | (F.col("dollars") >= 25) | (F.coalesce("cluster", zero) >= 3)
    rules: list[tuple[str, str, Column, Column]] = [
        ("liquidity", "large_size_vs_open_interest", F.col("of_interest") >= 0.02, capped(1.0, F.col("of_interest") * 20)),
        ("liquidity", "large_size_vs_24h_volume", F.col("of_volume") >= 0.08, capped(0.8, F.col("of_volume") * 4)),
        ("liquidity", "high_impact_per_contract", (F.col("cents") >= 1.5) & heavy, capped(0.8, F.col("cents") / 4)),
        ("liquidity", "moved_through_wide_spread", (F.round("spread", 9) >= 0.08) & (delta >= 0.03), F.lit(0.4)),
        ("followthrough", "price_impact_persisted", (impact >= 0.03) & (through >= 0.03), F.lit(1.2)),
        ("followthrough", "small_trade_before_large_move", (through >= 0.08) & (delta < 0.03), F.lit(1.4)),
        ("followthrough", "impact_reverted", (impact >= 0.05) & (through < 0), F.lit(-0.5)),
        ("peer", "large_size_vs_sector_p99", (size >= F.col("count_p99")) & (F.col("count_p99") > 0), F.lit(1.2)),
        ("peer", "large_size_vs_sector_p95", (size >= F.col("count_p95")) & (F.col("count_p95") > 0) & ~yes((size >= F.col("count_p99")) & (F.col("count_p99") > 0)), F.lit(0.7)),
        ("peer", "large_move_vs_sector_peer", (F.col("move_p95") > 0) & (delta >= F.round("move_p95", 9)) & F.col("count").isNotNull(), F.lit(0.8)),
        ("news", "pre_news_directional_move", F.col("hours_to_news").isNotNull() & (through >= 0.03), F.when(F.col("hours_to_news") <= 6, 2.0).when(F.col("hours_to_news") <= 24, 1.2).otherwise(0.6)),
        ("cross", "coherent_event_move", (F.round("sibling_median", 9) >= 0.03) & (through >= 0.03), F.lit(1.0)),
        ("cross", "isolated_market_move", (F.col("sibling_count") >= 2) & (F.abs(through) >= 0.08) & (F.round("sibling_median", 9) < 0.01), F.lit(0.7)),
    ]
    most = {"liquidity": 2.0, "followthrough": 2.0, "peer": 2.0, "news": 2.0, "cross": 1.2}
    p = p.withColumns({f"hit_{r}": yes(c) for _, r, c, _ in rules})
    parts = {"local": F.round(capped(2.5, F.coalesce("local_score", zero) * 0.25) + 1e-9, 3)}
    for name, top in most.items():
        total = sum((F.when(F.col(f"hit_{r}"), v).otherwise(0.0) for n, r, _, v in rules if n == name), zero)
        parts[name] = F.round(F.greatest(zero, capped(top, total)), 3)
    p = p.withColumns({f"part_{n}": c for n, c in parts.items()})
    so_far = F.round(sum((F.col(f"part_{n}") for n in parts), zero), 6)
    high = F.col("prior").isin("high", "medium_high") & (so_far >= 2.0)
    near = (F.col("close_us") >= F.col("ts_us")) & (F.col("close_us") <= F.col("ts_us") + DAY_US)
    p = p.withColumns({"hit_high_priority_market_type": yes(high), "hit_near_resolution": yes(near)})
    p = p.withColumn("part_priority", F.when(F.col("hit_high_priority_market_type"), 0.5).when(F.col("hit_near_resolution"), 0.4).otherwise(0.0))
    raw = capped(10.0, F.round(so_far + F.col("part_priority"), 6))
    sports = F.lit(False) if public_sports is None else yes(public_sports)
    p = p.withColumn("hit_public_sports_market_discount", sports & (raw > 0))
    eased = raw * F.when(F.col("hit_public_sports_market_discount"), 0.75).otherwise(1.0)
    cap = context_cap(F.col("dollars"), F.coalesce("cluster", zero))
    p = p.withColumn("eased", eased).withColumn("hit_low_notional_context_cap", yes(eased > cap)).withColumn("context_cap", cap)
    held = F.when(F.col("hit_low_notional_context_cap"), F.col("context_cap")).otherwise(F.col("eased"))
    late = F.col("hours_since_news").isNotNull() & F.col("hours_to_news").isNull()
    p = p.withColumn("post_news_multiplier", F.when(late, F.when(F.col("hours_since_news") <= 6, 0.65).otherwise(0.8)))
    p = p.withColumn("hit_post_news_move_discount", late & (held > 0))
    score = F.round(capped(10.0, held * F.coalesce("post_news_multiplier", F.lit(1.0))) + 1e-9, 3)  # a tie goes up whatever its last bit
    names = [r for _, r, _, _ in rules] + ["high_priority_market_type", "near_resolution", "public_sports_market_discount", "low_notional_context_cap", "post_news_move_discount"]
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"hit_{r}"), r) for r in names])))
    priced = F.col("yes_price").isNotNull() & F.col("ts_us").isNotNull()
    out = [F.when(priced, F.col(f"part_{n}")).alias(f"{n}_part") for n in [*parts, "priority"]]
    return p.select(*prints.columns, *out, "post_news_multiplier", F.when(priced, score).alias("context_score"), F.when(priced, reasons).alias("context_reasons"))


def final_score(local: Column, context: Column, discount: Column) -> Column:
    """The better of both scores, 0 to 10; after news the local one counts discounted."""
    eased = F.when((discount > 0) & (discount < 1), local * discount).otherwise(local)
    return F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), context, eased)) + 1e-9, 3)


def trade_flags(scored: DataFrame, version: int, least: float = FLAG_SCORE) -> DataFrame:
    """Flags of prints whose final score reaches ``least``: severity, tier and the key of the case.

    A flag from TRIGGERED_SCORE on promotes its market; from CASE_SCORE on, or with a move
    before news, to a case."""
    score = final_score(F.coalesce("local_score", F.lit(0.0)), F.coalesce("context_score", F.lit(0.0)), F.col("post_news_multiplier"))
    severity = F.when(F.col("score") >= CASE_SCORE, "critical").when(F.col("score") >= TRIGGERED_SCORE, "high").when(F.col("score") >= 5, "medium").otherwise("low")
    reasons = F.array_sort(F.array_union(F.coalesce("reasons", F.array().cast("array<string>")), F.coalesce("context_reasons", F.array().cast("array<string>"))))
    case = (F.col("score") >= CASE_SCORE) | F.array_contains("reasons", "pre_news_directional_move")
    tier = F.when(F.col("score") >= TRIGGERED_SCORE, F.when(case, "case").otherwise("triggered"))
    flags = scored.select("market_pk", "trade_pk", "ts_us", score.alias("score"), reasons.alias("reasons")).where(F.col("score") >= least)
    return flags.select("*", severity.alias("severity"), tier.alias("tier"), F.lit(version).alias("scorer_version"))


def case_windows(flags: DataFrame) -> DataFrame:
    """(case_key, market_pk, trade_pk, trigger_us, start_us, end_us, score): from a day before to six
    hours after each flag of tier case."""
    key = F.concat_ws(":", F.lit("trade_flag"), F.col("scorer_version").cast("string"), F.col("trade_pk").cast("string"))
    return flags.where("tier = 'case'").select(
        key.alias("case_key"), "market_pk", "trade_pk", F.col("ts_us").alias("trigger_us"), (F.col("ts_us") - DAY_US).alias("start_us"), (F.col("ts_us") + 6 * 3_600_000_000).alias("end_us"), "score"
    )


def news_case_windows(correlations: DataFrame, lookback_us: int = DAY_US, least: float = TRIGGERED_SCORE) -> DataFrame:
    """The same for scored links: from the lookback before the news to six hours after it."""
    return correlations.where(F.col("score") >= least).select(
        F.concat_ws(":", F.lit("news_link"), F.col("news_id").cast("string")).alias("case_key"), "market_pk", F.col("news_us").alias("trigger_us"),
        (F.col("news_us") - lookback_us).alias("start_us"), (F.col("news_us") + 6 * 3_600_000_000).alias("end_us"), "score",
    )


def promote(tiers: DataFrame, flags: DataFrame, keep_case: bool = False) -> DataFrame:
    """``tiers`` (market_pk, tier, retention_score) with the promotions of flags folded in: the newest
    promoting flag sets the tier and the retention score never falls. With ``keep_case``, as for
    links, a market that is a case stays one."""
    newest = flags.where("tier IS NOT NULL").groupBy("market_pk").agg(F.max_by("tier", F.struct("ts_us", "trade_pk")).alias("new_tier"), F.floor(F.max("score") * 10).cast("int").alias("new_score"))
    joined = tiers.join(newest, "market_pk", "full")
    new = F.coalesce("new_tier", "tier")
    tier = F.when(F.col("tier") == "case", F.col("tier")).otherwise(new) if keep_case else new
    return joined.select("market_pk", tier.alias("tier"), F.greatest("retention_score", "new_score").alias("retention_score"))


def reason_counts(flags: DataFrame, most: int | None = 500) -> DataFrame:
    """How often each reason stands among the ``most`` best flags (the report's limit), or with None among all."""
    best = flags if most is None else flags.orderBy(F.desc("score"), F.desc("ts_us"), "trade_pk").limit(most)
    return best.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("flags"))


def suspicious(flags: DataFrame, evidence: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of live flags and stored evidence; of a print in both the flag counts."""
    both = flags.withColumn("source", F.lit(0)).unionByName(evidence.withColumn("source", F.lit(1)))
    rest = [c for c in both.columns if c != "trade_pk"]
    one = both.groupBy("trade_pk").agg(F.min_by(F.struct(*rest), "source").alias("r")).select("trade_pk", "r.*")
    return one.orderBy(F.desc("score"), F.desc("ts_us"), "trade_pk").limit(limit)


def sign(value: Column, least: float) -> Column:
    return F.when(value >= least, 1).when(value <= -least, -1).otherwise(0)


def news_trade_scores(met: DataFrame, lookback_us: int = DAY_US) -> DataFrame:
    """The best print before each linked news: (news_id, market_pk, news_us, score, status, trade_pk,
    seconds, evaluated).

    ``met``: a row per link and print before it with news_id, market_pk, news_us, trade_pk, ts_us,
    count, taker_side, relevance, label, confidence, direct (a direct match of texts), local_score,
    flag_score, delta (move from the print before it in the window) and through (move from there to
    five minutes later). Ties go to the earliest print."""
    zero = F.lit(0.0)
    desired = F.when(F.col("label") == "supports_yes", 1).when(F.col("label") == "supports_no", -1).otherwise(0)
    seconds = (F.col("news_us") - F.col("ts_us")) / 1_000_000
    # Minutes before the news up to -> points.
    timing = F.when((seconds <= 0) | (seconds > lookback_us / 1_000_000), 0.0)
    for minutes, points in ((5, 2.5), (60, 2.2), (360, 1.8), (1440, 1.1)):
        timing = timing.when(seconds <= minutes * 60, points)
    timing = timing.otherwise(0.5)
    taker = F.lower(F.coalesce("taker_side", F.lit("")))
    known = met.withColumns(
        {
            "desired": desired, "timing": timing, "seconds": seconds.cast("long"), "way": F.when(taker == "yes", 1).when(taker == "no", -1).otherwise(0),
            "moved": sign(F.round("through", 9), 0.02), "instant": sign(F.round("delta", 9), 0.02), "pull": F.round(desired * F.col("through"), 9),
        }
    ).where("timing > 0")
    toward, side = F.col("desired") != 0, F.col("way") == F.col("desired")
    move, instant = F.col("moved") == F.col("desired"), F.col("instant") == F.col("desired")
    against = (F.col("way") == -F.col("desired")) & (F.col("moved") == -F.col("desired"))
    sure = F.greatest(F.lit(0.35), F.coalesce("confidence", zero))
    weak = ~toward & ~F.coalesce("direct", F.lit(False)) & (F.col("relevance") < 0.65)
    drift = ~toward & ~weak & (F.round(F.abs("through"), 9) >= 0.08)
    parts = [
        F.col("timing"),
        F.least(F.lit(1.0), F.coalesce("relevance", zero)),
        F.when(toward & side & (move | instant), 2.2 * sure).when(toward & (side | move | instant), 1.4 * sure).when(toward & against, -0.8).when(drift, 0.25).otherwise(0.0),
        F.least(F.lit(3.0), 0.35 * F.coalesce("local_score", zero) + 0.45 * F.coalesce("flag_score", zero)),
        F.when(toward & (F.col("pull") >= 0.03), F.least(F.lit(1.5), F.col("pull") * 18)).when(drift, 0.4).otherwise(0.0),
        F.when(F.col("count") >= 100, F.least(F.lit(0.8), F.log1p(F.col("count").cast("double")) / 8)).otherwise(0.0),
    ]
    raw = sum((F.round(c, 3) for c in parts), zero)
    held = F.when(weak, F.least(raw, F.lit(3.999))).otherwise(raw)
    scored = known.select("news_id", "market_pk", "news_us", "trade_pk", "ts_us", F.round(F.greatest(zero, F.least(F.lit(10.0), held)), 3).alias("score"), "seconds")
    best = scored.groupBy("news_id", "market_pk", "news_us").agg(
        F.max_by(F.struct("score", "trade_pk", "seconds"), F.struct("score", -F.col("ts_us"), -F.col("trade_pk"))).alias("b"), F.count("*").alias("evaluated")
    )
    status = F.when(F.col("b.score") >= 7, "strong_pre_news_signal").when(F.col("b.score") >= 4, "pre_news_signal").otherwise("no_pre_news_signal")
    return best.select("news_id", "market_pk", "news_us", "b.score", status.alias("status"), "b.trade_pk", "b.seconds", "evaluated")
