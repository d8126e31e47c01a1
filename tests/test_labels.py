"""Name rules and nearest labelled titles."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tapeglass.operators import classify, labels

SEEDS = [
    (1, "Will core inflation be above three percent in May?", "macro", "cpi", "cpi,scheduled_announcement"),
    (2, "Will consumer prices rise in June?", "macro", "cpi", "cpi"),
    (3, "Will the central bank raise interest rates?", "macro", "fed_decision", "fomc,scheduled_announcement"),
    (4, "Will City win their match on Sunday?", "sports_outcome", "soccer_match", "soccer"),
    (5, "Will Rovers win the match this weekend?", "sports_outcome", "soccer_match", "soccer,league"),
    (6, "Will Bitcoin be above 100k at noon?", "crypto_strike", "short_window", "crypto,btc"),
    (7, "Will it snow in Oslo on Friday?", "weather", "precipitation", "weather"),
    (8, "Will it snow in Oslo on Friday?", "weather", "temperature", "weather,odd"),
]
NAMES = [
    ("KXBTC15M-26APR25-50K", None, "crypto.btc_15m"), ("KXBTCH-26", None, "crypto.btc_hourly"), ("KXBTCHX-26", None, "crypto.btc_generic"), ("KXBTCD-1", None, "crypto.btc_daily"), ("kxethhm-1", None, "crypto.eth_short"),
    ("KXETHX", None, "crypto.eth_generic"), ("KXFOMC-2026MAR", None, "macro.fomc"), ("KXMA-1", None, "corporate.merger"), ("KXMAR-26MAYROOMS-1760000", None, None), ("KXMERGERS", None, None),
    ("KXNBASPREAD-LAL-3.5", None, "sports.nba_spread"), ("KXNBAGAME-1", "Lakers over the total", "sports.nba_total"), ("KXNBA-1", "who wins", "sports.nba_game"), ("KXNBA-1", "blk leader", "sports.nba_player_prop"),
    ("KXMLBHR-1", None, "sports.mlb_first_event"), ("KXUNEMPLOYMENT-1", None, "macro.jobs"), ("KXMVECROSSCATEGORY-1", None, "exotic.cross_category"), ("ABC", "KXBTC", None), ("", "x", None), (None, None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(NAMES)], "i long, name string, title string")
    got = df.select("i", labels.rule_label(F.col("name"), F.col("title"))["rule"].alias("rule")).orderBy("i").collect()
    assert [r.rule for r in got] == [want for _, _, want in NAMES]


def test_every_rule_has_a_prior():
    known = set(classify.PRIOR_OF)
    assert all(f"{c}/{s}" in known or f"{c}/*" in known for _, _, _, c, s, _ in labels.NAME_RULES)


def grams(title):
    import re

    p = f" {re.sub(' +', ' ', re.sub('[^a-z0-9 ]+', ' ', title.lower())).strip()} "
    return Counter(p[i : i + n] for n in labels.GRAMS for i in range(len(p) - n + 1))


def brute(title, seeds, k=5):
    df = Counter(g for s in seeds for g in grams(s[1]))
    idf = lambda g: math.log((len(seeds) + 1) / (df.get(g, 0) + 1)) + 1
    vec = lambda t: {g: c * idf(g) for g, c in grams(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    q = vec(title)
    near = sorted(((-round(sum(q[g] * w for g, w in vec(s[1]).items() if g in q) / (norm(q) * norm(vec(s[1]))), 9), s[0], s) for s in seeds))[:k]
    if -near[0][0] < 0.05:
        return near[0][2][2:4], "low", near[0][2][4]
    votes, tags = defaultdict(float), defaultdict(set)
    for sim, _, s in near:
        votes[s[2:4]] += -sim
        tags[s[2:4]] |= set(s[4].split(",")) if sim < 0 else set()
    best = max(votes, key=lambda c: round(votes[c], 9))
    share = round(votes[best] / sum(votes.values()), 9)
    return best, "high" if share >= 0.7 or -near[0][0] >= 0.95 else "medium" if share >= 0.4 else "low", ",".join(sorted(tags[best]))


TITLES = [
    "Will core inflation be above four percent in July?", "Will Rovers win their match?", "zxqv plurfn glomph beepboop", "Will it snow in Oslo on Friday?", "rates", "a", "Will Bitcoin be above 90k at noon?",
    "Will the bank raise prices and snow win the match above?", "!!", "Will Bitcoin be above 90k at noon?",
]


def test_nearest_equals_brute_force(spark):
    seeds = spark.createDataFrame(SEEDS, "seed_id long, title string, category string, subcategory string, tags string")
    rows = [(i, t) for i, t in enumerate(TITLES)] + [(90, None), (91, "  ")]
    found = {r.market_pk: r.label for r in labels.nearest_labels(spark.createDataFrame(rows, "market_pk long, title string"), seeds).collect()}
    assert set(found) == set(range(len(TITLES)))
    for i, t in enumerate(TITLES):
        want = brute(t, SEEDS)
        assert ((found[i].category, found[i].subcategory), found[i].confidence) == want[:2], (t, found[i], want)
        assert found[i].tags == want[2]
    assert labels.nearest_labels(spark.createDataFrame(rows, "market_pk long, title string"), seeds.where("seed_id > 99")).collect() == []


@pytest.mark.parametrize("tags,name,title,layer", [(["FOMC"], "KXBTC15M-1", "Will the Fed raise rates?", "tag:fomc"), ([], "KXBTC15M-1", "t", "crypto.btc_15m"), ([], "NO-1", "Will core inflation be above three percent in May?", "knn"), ([], "NO-1", None, "all_layers_abstained")])
def test_layers_fall_through(spark, tags, name, title, layer):
    seeds = spark.createDataFrame(SEEDS, "seed_id long, title string, category string, subcategory string, tags string")
    m = spark.createDataFrame([(1, tags, name, title)], "market_pk long, tags array<string>, name string, title string")
    joined = m.join(labels.nearest_labels(m, seeds).select("market_pk", F.col("label").alias("near")), "market_pk", "left")
    layers = [classify.taxonomy_label(F.col("listed"), F.lit(None).cast("string")), labels.rule_label(F.col("name"), F.col("title")), F.col("near")]
    assert classify.classify(joined.withColumnRenamed("tags", "listed"), layers).first().rule == layer


def test_pairs_of_titles_and_seeds_are_not_shuffled(spark):
    """Behind the one exchange that deals titles by their id, a title's grams and seeds are added up in place."""
    seeds = spark.createDataFrame(SEEDS, "seed_id long, title string, category string, subcategory string, tags string")
    rows = [(i, f"will gold be above {i}") for i in range(50)]
    found = labels.nearest_labels(spark.createDataFrame(rows, "market_pk long, title string"), seeds)
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(title_id" in plan
    assert not re.search(r"hashpartitioning\((gram|title_id#\d+L, (gram|seed_id))", plan)
