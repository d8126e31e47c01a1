"""Topic labels of markets by name rules and by the titles of labelled markets.

A rule holds for names with one of its starts, and where it has them, words later in name or title,
or an end of the series. Rules are one literal of the plan in their order: a row takes the first that
holds, and words are only looked for behind a start that fits.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.sources.storage import Scratch

# The first rule that holds decides (rule, starts, what has to follow, category, subcategory, label tags).
NAME_RULES = [
    ("crypto.btc_15m", ["KXBTC15M"], None, "crypto_strike", "short_window", "crypto,btc,short_window,public_underlying"),
    ("crypto.btc_hourly", ["KXBTCHM", "KXBTCH"], r"\b", "crypto_strike", "short_window", "crypto,btc,short_window,public_underlying"),
    ("crypto.btc_daily", ["KXBTCD"], None, "crypto_strike", "daily", "crypto,btc,public_underlying"),
    ("crypto.btc_generic", ["KXBTC"], None, "crypto_strike", "*", "crypto,btc,public_underlying"),
    ("crypto.eth_short", ["KXETH15M", "KXETHHM", "KXETHH"], r"\b", "crypto_strike", "short_window", "crypto,eth,short_window,public_underlying"),
    ("crypto.eth_generic", ["KXETH"], None, "crypto_strike", "*", "crypto,eth,public_underlying"),
    ("crypto.sol_generic", ["KXSOL"], None, "crypto_strike", "*", "crypto,sol,public_underlying"),
    ("macro.fomc", ["KXFED", "KXFOMC", "KXRATEDECISION"], None, "macro", "fed_decision", "fomc,scheduled_announcement"),
    ("macro.cpi", ["KXCPI", "KXINFLATION"], None, "macro", "cpi", "cpi,scheduled_announcement"),
    ("macro.jobs", ["KXJOBS", "KXNFP", "KXUNEMP", "KXUNEMPLOYMENT", "KXPAYROLL"], None, "macro", "jobs", "nfp,scheduled_announcement"),
    ("macro.gdp", ["KXGDP"], None, "macro", "gdp", "gdp,scheduled_announcement"),
    ("corporate.earnings", ["KXEARN", "KXEARNINGS"], None, "corporate", "earnings", "earnings,scheduled_announcement"),
    ("corporate.merger", ["KXMERGER", "KXACQUISITION", "KXMA"], "(?:-|$)", "corporate", "merger", "merger,single_actor_leverage"),
    ("corporate.fda", ["KXFDA"], None, "corporate", "fda", "fda,scheduled_announcement"),
    ("judicial.scotus", ["KXSCOTUS", "KXSUPREMECOURT"], None, "judicial", "scotus", "scotus,scheduled_announcement"),
    ("judicial.ruling", ["KXRULING", "KXVERDICT", "KXTRIAL", "KXCONFIRM"], None, "judicial", "ruling", "judicial,scheduled_announcement"),
    ("sports.ufc", ["KXUFC"], None, "sports_outcome", "fight_winner", "ufc,combat_sport,single_actor_leverage"),
    ("sports.mma", ["KXMMA", "KXBELLATOR", "KXPFL"], None, "sports_outcome", "fight_winner", "mma,combat_sport,single_actor_leverage"),
    ("sports.boxing", ["KXBOX"], None, "sports_outcome", "fight_winner", "boxing,combat_sport,single_actor_leverage"),
    ("sports.nba_spread", ["KXNBA"], ".*(?:SPREAD|HANDICAP|LINE)", "sports_derivative", "spread", "nba,spread"),
    ("sports.nba_total", ["KXNBA"], ".*(?:TOTAL|OVERUNDER|OU)", "sports_derivative", "total", "nba,total"),
    ("sports.nba_player_prop", ["KXNBA"], ".*(?:PTS|REB|AST|STL|BLK|3PT)", "sports_prop", "player_points", "nba,player_prop,single_actor_leverage"),
    ("sports.nba_game", ["KXNBA"], None, "sports_outcome", "major_league_game", "nba"),
    ("sports.nfl_spread", ["KXNFL"], ".*(?:SPREAD|HANDICAP|LINE)", "sports_derivative", "spread", "nfl,spread"),
    ("sports.nfl_total", ["KXNFL"], ".*(?:TOTAL|OVERUNDER|OU)", "sports_derivative", "total", "nfl,total"),
    ("sports.nfl_game", ["KXNFL"], None, "sports_outcome", "major_league_game", "nfl"),
    ("sports.mlb_first_event", ["KXMLB"], ".*(?:FIRSTHIT|FIRSTRUN|HOMER|HR)", "sports_prop", "first_event", "mlb,single_actor_leverage"),
    ("sports.mlb_game", ["KXMLB"], None, "sports_outcome", "major_league_game", "mlb"),
    ("sports.nhl_game", ["KXNHL"], None, "sports_outcome", "major_league_game", "nhl"),
    ("sports.tennis", ["KXTENNIS", "KXATP", "KXWTA"], None, "sports_outcome", "tennis_match", "tennis"),
    ("sports.soccer", ["KXSOCCER", "KXEPL", "KXMLS", "KXLALIGA", "KXUCL", "KXUEFA", "KXFIFA"], None, "sports_outcome", "soccer_match", "soccer"),
    ("sports.golf", ["KXGOLF", "KXPGA", "KXMASTERS", "KXUSOPEN", "KXOPEN"], None, "sports_outcome", "*", "golf"),
    ("weather.temp", ["KXHIGHTEMP", "KXLOWTEMP", "KXTEMP"], None, "weather", "temperature", "weather,public_underlying"),
    ("weather.precip", ["KXRAIN", "KXSNOW", "KXPRECIP"], None, "weather", "precipitation", "weather,public_underlying"),
    ("election.primary", ["KXPRIMARY", "KXCAUCUS"], None, "election", "primary", "election,primary"),
    ("election.governor", ["KXGOV", "KXGOVERNOR", "KXGOVRACE"], None, "election", "general", "election"),
    ("election.senate", ["KXSENATE", "KXSEN"], None, "election", "general", "election"),
    ("election.house", ["KXHOUSE"], None, "election", "general", "election"),
    ("election.presidential", ["KXPRES", "KXPOTUS", "KXPRESIDENT"], None, "election", "general", "election,presidential"),
    ("popculture.awards", ["KXOSCAR", "KXEMMY", "KXGRAMMY", "KXTONY", "KXGOLDENGLOBE"], None, "popculture", "awards", "awards"),
    ("popculture.box_office", ["KXBOXOFFICE", "KXMOVIE"], None, "popculture", "ratings", "box_office"),
    ("exotic.cross_category", ["KXMVE", "KXCOMBO", "KXPARLAY"], None, "exotic_combo", "*", "combinatorial"),
]
NEIGHBOURS = 5
LEAST_TOP = 0.05
TITLES_A_TASK = 250
GRAMS = (3, 4, 5)
LABEL = "struct<category string, subcategory string, rule string, confidence string, tags string>"


def rule_label(name: Column, title: Column) -> Column:
    """Label struct of the first rule that holds for a market's name (and title), null where none does."""
    rows = [
        {"start": start, "rest": f"^{start}{rest}" if rest else None, "label": {"category": c, "subcategory": s, "rule": rule, "confidence": "high", "tags": tags}}
        for rule, starts, rest, c, s, tags in NAME_RULES
        for start in starts
    ]
    table = F.from_json(F.lit(json.dumps(rows)), f"array<struct<start string, rest string, label {LABEL}>>")
    upper = F.upper(name)
    text = F.concat(upper, F.lit("|"), F.upper(F.coalesce(title, F.lit(""))))
    fits = lambda r: F.startswith(upper, r["start"]) & (r["rest"].isNull() | F.regexp_like(text, r["rest"]))
    return F.when(upper != "", F.get(F.filter(table, fits), F.lit(0))["label"])


def plain_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]+", " "), " +", " "))


def gram_counts(titles: DataFrame, key: str) -> DataFrame:
    """(key, gram, tf): runs of 3 to 5 characters of a plain title between spaces."""
    padded = titles.select(key, F.concat(F.lit(" "), plain_title(F.col("title")), F.lit(" ")).alias("p"))

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length("p") - (n - 1)), lambda i: F.substring(F.col("p"), i, F.lit(n)))
        return F.when(F.length("p") >= n, found).otherwise(F.array().cast("array<string>"))

    each = F.flatten(F.array(*[runs(n) for n in GRAMS]))
    return padded.select(key, F.explode(each).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


def nearest_labels(markets: DataFrame, seeds: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(market_pk, label, top, share) of markets (market_pk, title) with a title, from labelled titles
    (seed_id, title, category, subcategory, tags).

    Titles are compared by the cosine of their gram counts, weighted by how few seeds have a gram; the
    k nearest seeds vote with their similarity (seeds without a gram in common have no vote), ties of similarity to the smaller seed_id, ties of votes
    to the class with the nearest seed. The winner's share gives the confidence: high from 0.7 on or if
    one seed is all but equal, medium from 0.4 on. Below LEAST_TOP the nearest seed is returned with a
    low confidence. Each distinct title is compared once; without seeds there is no label.

    Titles are dealt by their title_id once, and all that is made of a title stays in its task; the
    grams of the seeds are stored, so that they are sent to the titles where they are few."""
    work = Scratch(markets.sparkSession)
    titled = markets.select("market_pk", "title").where(F.trim("title") != "")
    parts = titled.agg(F.approx_count_distinct("title")).first()[0] // TITLES_A_TASK + 1
    distinct = titled.select("title", F.xxhash64("title").alias("title_id")).repartition(parts, "title_id").distinct()
    seed_grams = gram_counts(seeds, "seed_id")
    n = seeds.agg(F.count("*").alias("n"))
    idf = lambda df: F.ln((F.col("n") + 1) / (df + 1)) + 1.0
    counts = seed_grams.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("gram", "df", idf(F.col("df")).alias("idf"))  # n is one row
    counts = work.settle(counts)
    weighed = work.settle(seed_grams.join(counts, "gram").select("seed_id", "gram", (F.col("tf") * F.col("idf")).alias("w")))
    norms = weighed.groupBy("seed_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s_norm"))
    told = gram_counts(distinct, "title_id").join(counts, "gram", "left").join(F.broadcast(n))
    told = told.select("title_id", "gram", (F.col("tf") * F.coalesce("idf", idf(F.lit(0)))).alias("q"))
    q_norms = told.groupBy("title_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    dots = told.join(weighed, "gram").groupBy("title_id", "seed_id").agg(F.sum(F.col("q") * F.col("w")).alias("dot"))
    sims = dots.join(norms, "seed_id").join(q_norms, "title_id").select("title_id", "seed_id", F.round(F.col("dot") / (F.col("s_norm") * F.col("q_norm")), 9).alias("sim"))
    # titles that share nothing with any seed are nearest to the first one, with similarity 0
    first = seeds.agg(F.min("seed_id").alias("seed_id")).where("seed_id IS NOT NULL")
    none = distinct.select("title_id").join(sims.select("title_id").distinct(), "title_id", "left_anti").join(F.broadcast(first)).select("title_id", "seed_id", F.lit(0.0).alias("sim"))
    place = F.row_number().over(Window.partitionBy("title_id").orderBy(F.desc("sim"), "seed_id"))
    near = sims.unionByName(none).withColumn("place", place).where(F.col("place") <= k).join(seeds.drop("title"), "seed_id")
    votes = near.groupBy("title_id", "category", "subcategory").agg(
        F.sum("sim").alias("weight"), F.min("place").alias("best"), F.max("sim").alias("top"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("tags", ","))))).alias("tags"),
        F.min_by("tags", "place").alias("own_tags"),
    )
    better = F.struct(F.round("weight", 9).alias("w"), (-F.col("best")).alias("b"))
    row = F.struct("category", "subcategory", "weight", F.array_join("tags", ",").alias("tags"))
    nearest = F.struct("category", "subcategory", F.col("own_tags").alias("tags"))
    chosen = votes.groupBy("title_id").agg(F.max_by(row, better).alias("won"), F.min_by(nearest, "best").alias("near"), F.max("top").alias("top"), F.sum("weight").alias("total"))
    cold = F.col("top") < LEAST_TOP
    share = F.col("won.weight") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    level = F.when(cold, "low").when((F.round(share, 9) >= 0.7) | (F.col("top") >= 0.95), "high").when(F.round(share, 9) >= 0.4, "medium").otherwise("low")
    pick = lambda name: F.when(cold, F.col(f"near.{name}")).otherwise(F.col(f"won.{name}"))
    label = F.struct(pick("category").alias("category"), pick("subcategory").alias("subcategory"), F.when(cold, "knn:cold_start").otherwise("knn").alias("rule"), level.alias("confidence"), pick("tags").alias("tags"))
    found = chosen.select("title_id", label.alias("label"), "top", share.alias("share"))
    return titled.withColumn("title_id", F.xxhash64("title")).join(found, "title_id").select("market_pk", "label", "top", "share")
