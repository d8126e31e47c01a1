"""Topic labels of markets: tag and category rules, priors, and the choice between layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first tag text that a market's tags contain decides (text, category, subcategory, label tags).
TAG_RULES = [
    ("fomc", "macro", "fed_decision", "fomc,scheduled_announcement"),
    ("fed rate", "macro", "fed_decision", "fomc,scheduled_announcement"),
    ("cpi", "macro", "cpi", "cpi,scheduled_announcement"),
    ("inflation", "macro", "cpi", "inflation,scheduled_announcement"),
    ("jobs report", "macro", "jobs", "nfp,scheduled_announcement"),
    ("nonfarm", "macro", "jobs", "nfp,scheduled_announcement"),
    ("gdp", "macro", "gdp", "gdp,scheduled_announcement"),
    ("merger", "corporate", "merger", "merger,single_actor_leverage"),
    ("earnings", "corporate", "earnings", "earnings,scheduled_announcement"),
    ("fda", "corporate", "fda", "fda,scheduled_announcement"),
    ("scotus", "judicial", "scotus", "scotus,scheduled_announcement"),
    ("supreme court", "judicial", "scotus", "scotus,scheduled_announcement"),
    ("ruling", "judicial", "ruling", "judicial,scheduled_announcement"),
    ("bitcoin", "crypto_strike", "*", "crypto,public_underlying"),
    ("ethereum", "crypto_strike", "*", "crypto,public_underlying"),
    ("solana", "crypto_strike", "*", "crypto,public_underlying"),
    ("ufc", "sports_outcome", "fight_winner", "combat_sport,single_actor_leverage"),
    ("boxing", "sports_outcome", "fight_winner", "combat_sport,single_actor_leverage"),
    ("mma", "sports_outcome", "fight_winner", "combat_sport,single_actor_leverage"),
    ("nba", "sports_outcome", "major_league_game", "nba"),
    ("nfl", "sports_outcome", "major_league_game", "nfl"),
    ("mlb", "sports_outcome", "major_league_game", "mlb"),
    ("nhl", "sports_outcome", "major_league_game", "nhl"),
    ("tennis", "sports_outcome", "tennis_match", "tennis"),
    ("soccer", "sports_outcome", "soccer_match", "soccer"),
    ("temperature", "weather", "temperature", "weather,public_underlying"),
    ("rain", "weather", "precipitation", "weather,public_underlying"),
    ("snow", "weather", "precipitation", "weather,public_underlying"),
    ("primary", "election", "primary", "election,primary"),
    ("election", "election", "general", "election"),
    ("oscar", "popculture", "awards", "awards"),
    ("emmy", "popculture", "awards", "awards"),
    ("grammy", "popculture", "awards", "awards"),
]
# Exchange category -> category, subcategory.
CATEGORIES = {
    "Economics": ("macro", "*"),
    "Politics": ("election", "*"),
    "Climate and Weather": ("weather", "*"),
    "Weather": ("weather", "*"),
    "Sports": ("sports_outcome", "*"),
    "Crypto": ("crypto_strike", "*"),
    "Companies": ("corporate", "*"),
    "Financials": ("corporate", "*"),
    "World": ("other", "unclassified"),
    "Science and Technology": ("other", "unclassified"),
    "Health": ("other", "unclassified"),
    "Entertainment": ("popculture", "*"),
    "Culture": ("popculture", "*"),
}
# Prior of category/subcategory; "*" is the category's default, other/unclassified the last resort.
PRIOR_OF = {
    "macro/fed_decision": "high", "macro/cpi": "medium_high", "macro/jobs": "medium_high", "macro/gdp": "medium_high", "macro/*": "medium_high",
    "corporate/merger": "high", "corporate/earnings": "medium_high", "corporate/fda": "high", "corporate/*": "medium_high",
    "judicial/scotus": "high", "judicial/ruling": "high", "judicial/*": "high",
    "sports_outcome/fight_winner": "high", "sports_outcome/tennis_match": "medium", "sports_outcome/soccer_match": "medium",
    "sports_outcome/major_league_game": "medium", "sports_outcome/*": "medium",
    "sports_derivative/spread": "medium", "sports_derivative/total": "medium", "sports_derivative/*": "medium",
    "sports_prop/player_points": "medium_high", "sports_prop/first_event": "medium_high", "sports_prop/*": "medium",
    "crypto_strike/short_window": "low", "crypto_strike/daily": "low", "crypto_strike/*": "low",
    "weather/temperature": "very_low", "weather/precipitation": "very_low", "weather/*": "very_low",
    "election/primary": "medium_high", "election/general": "medium", "election/*": "medium",
    "popculture/awards": "medium", "popculture/ratings": "low", "popculture/*": "medium",
    "exotic_combo/*": "medium", "other/unclassified": "medium", "other/*": "medium",
}
CONFIDENCE = ("low", "medium", "high")


def label(category: str, subcategory: str, rule: str, tags: str) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"), F.lit(rule).alias("rule"), F.lit("high").alias("confidence"), F.lit(tags).alias("tags")
    )


def taxonomy_label(tags: Column, exchange_category: Column) -> Column:
    """Struct (category, subcategory, rule, confidence, tags) of the first tag rule that holds, else of
    the exchange's category, else null."""
    text = F.lower(F.concat_ws(" | ", tags))
    rules = reduce(lambda c, r: c.when(F.contains(text, F.lit(r[0])), label(r[1], r[2], f"tag:{r[0]}", r[3])), TAG_RULES, F.when(F.lit(False), label("", "", "", "")))
    return reduce(lambda c, k: c.when(exchange_category == k, label(*CATEGORIES[k], f"category:{k}", "")), CATEGORIES, rules)


def prior_of(category: Column, subcategory: Column) -> Column:
    """Prior of the pair, else of the category, else the last resort."""
    known = F.create_map(*[F.lit(x) for pair in PRIOR_OF.items() for x in pair])
    exact = F.element_at(known, F.concat_ws("/", category, F.coalesce(subcategory, F.lit("*"))))
    return F.coalesce(exact, F.element_at(known, F.concat(category, F.lit("/*"))), F.lit(PRIOR_OF["other/unclassified"]))


def choose_layer(layers: list[Column]) -> Column:
    """The first layer's label whose confidence is not low; else the most confident one, the later
    layer winning a tie; null if no layer has one. ``layers``: label structs in order."""
    sure = F.coalesce(*[F.when(x["confidence"] != "low", x) for x in layers])
    return F.coalesce(sure, *reversed(layers))


def classify(markets: DataFrame, layers: list[Column]) -> DataFrame:
    """``markets`` with category, subcategory, rule, confidence, tags and prior. A low confidence
    never gives a prior above medium; without any label a market is other/unclassified."""
    last = F.struct(
        F.lit("other").alias("category"), F.lit("unclassified").alias("subcategory"), F.lit("all_layers_abstained").alias("rule"), F.lit("low").alias("confidence"), F.lit("").alias("tags")
    )
    chosen = markets.withColumn("label", F.coalesce(choose_layer(layers), last)).select(*markets.columns, "label.*")
    prior = prior_of(F.col("category"), F.col("subcategory"))
    clamped = F.when((F.col("confidence") == "low") & prior.isin("high", "medium_high"), "medium").otherwise(prior)
    return chosen.withColumn("prior", clamped)
