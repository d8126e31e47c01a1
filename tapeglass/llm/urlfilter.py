"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest.

DataFrame functions only. The trees learn from the URLs that rules decide. Features are cut into
bins half way between exact quantiles of a bounded sample; a level of a tree is one aggregation of gradients by
(node, feature, bin), of which at most nodes * features * bins rows reach the driver; a finished
tree is a CASE expression, so scoring is part of the scan. Sums of gradients are sums of whole
numbers, so a fit does not depend on the order in which rows are added.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeglass.llm.common import cut, drop_cut

ALLOW, BLOCK = "allow", "block"
SAMPLE = 20_000  # distinct labelled URLs that the trees are fitted on, the smallest by hash
TREES = 8
DEPTH = 3
BINS = 32
RATE = 0.5
RIDGE = 1.0
PRIOR = 5.0  # labelled URLs that a suffix without any counts as
FOLDS = 4
UNIT = 1 << 20  # gradients are whole multiples of 1 / UNIT
SUFFIXES = ("last", "domain", "branch", "top")
FEATURES = ("length", "host_length", "path_length", "depth", "digits", "entropy", "params", "labels", "hyphens", *SUFFIXES)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Forest:
    """Cut points of the features, and trees as nested (feature, bin, left, right) or leaf values."""

    prior: float = 0.0  # log odds of block
    cuts: dict[str, list[float]] = field(default_factory=dict)
    trees: list = field(default_factory=list)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query): the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, with A-Z in lower case; the path what follows up to ``?``, ``#`` or the end; the query what
    follows its ``?`` up to ``#``. Null and URLs without ``://`` have none of them."""
    known = F.contains(url, F.lit("://"))
    rest = F.when(known, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path, query


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct, null where none does. Of rules of one length the one with
    the longer host comes first, then the smaller name. The list is one literal of the plan and a row
    is held against each of its rules, so it is meant for some hundred at most."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    listed = json.dumps([{"host": r.host, "path": r.path, "name": r.name, "verdict": r.verdict} for r in ranked])
    table = F.from_json(F.lit(listed), "array<struct<host string, path string, name string, verdict string>>")
    dotted = F.concat(F.lit("."), host)
    fits = lambda r: F.endswith(dotted, F.concat(F.lit("."), r["host"])) & F.startswith(path, r["path"]) & (host != "")
    return F.get(F.filter(table, fits), F.lit(0))


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def entropy(text: Column) -> Column:
    """Bits a character, over letters without case, digits and one class of all others; 0 for no text."""
    low, n = F.lower(text), F.greatest(F.length(text), F.lit(1)).cast("double")
    found = [count_of(low, c) for c in string.ascii_lowercase + string.digits]
    found.append(F.length(F.regexp_replace(low, "[a-z0-9]", "")))
    bits = F.lit(0.0)
    for c in found:
        bits = bits - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0)
    return bits


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (with url, host, path, query) and the lexical features and suffix keys."""
    url = F.coalesce("url", F.lit(""))
    digits = F.length(url) - F.length(F.translate(url, string.digits, ""))
    segment = F.substring_index(F.expr("substring(path, 2)"), "/", 1)
    last = F.substring_index("host", ".", -1)
    params = F.when(F.col("query") == "", 0).otherwise(count_of(F.col("query"), "&") + 1)
    columns = {
        "length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": count_of(F.col("path"), "/"),
        "digits": digits / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(url),
        "params": params,
        "labels": F.when(F.col("host") == "", 0).otherwise(count_of(F.col("host"), ".") + 1),
        "hyphens": count_of(F.col("host"), "-"),
    }
    keys = {"last": last, "domain": F.substring_index("host", ".", -2), "branch": F.concat(last, F.lit("/"), segment), "top": segment}
    return pages.withColumns({n: c.cast("double") for n, c in columns.items()} | {f"k_{n}": c for n, c in keys.items()})


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(kind, key, n, blocked, n0.., b0..): labelled URLs of every suffix, all and by fold."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("key")) for k in SUFFIXES])).alias("x")
    rows = labelled.select(keys, "y", "fold").select("x.*", "y", "fold")
    one = lambda f: F.col("fold") == f
    folds = [F.count_if(one(f)).alias(f"n{f}") for f in range(FOLDS)] + [F.sum(F.when(one(f), F.col("y")).otherwise(0)).alias(f"b{f}") for f in range(FOLDS)]
    return rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.sum("y").alias("blocked"), *folds)


def with_suffixes(rows: DataFrame, counts: DataFrame, share: float, held_fold: bool) -> DataFrame:
    """``rows`` with each suffix's smoothed share of block; with ``held_fold`` without the row's own
    fold, so that no row sees its own label."""
    for kind in SUFFIXES:
        part = counts.where(F.col("kind") == kind).drop("kind").withColumnRenamed("key", f"k_{kind}")
        n, b = F.col("n"), F.col("blocked")
        if held_fold:
            n = n - F.get(F.array(*[f"n{f}" for f in range(FOLDS)]), F.col("fold"))
            b = b - F.get(F.array(*[f"b{f}" for f in range(FOLDS)]), F.col("fold"))
        smooth = (F.coalesce(b, F.lit(0)) + share * PRIOR) / (F.coalesce(n, F.lit(0)) + PRIOR)
        rows = rows.join(part, f"k_{kind}", "left").withColumn(kind, smooth).drop("n", "blocked", *[f"{c}{f}" for c in "nb" for f in range(FOLDS)])
    return rows


def bin_of(feature: str, cuts: list[float]) -> Column:
    """Number of cut points that the feature's value exceeds."""
    return sum((F.when(F.col(feature) > c, 1).otherwise(0) for c in cuts), F.lit(0))


def tree_value(tree, column) -> Column:
    """The tree as a CASE expression; ``column(feature, bin)`` says whether the value lies above."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, at, left, right = tree
    return F.when(column(name, at), tree_value(right, column)).otherwise(tree_value(left, column))


def forest_value(forest: Forest, column) -> Column:
    return sum((tree_value(t, column) for t in forest.trees), F.lit(forest.prior))


def leaf_paths(tree, path: int = 1) -> list[int]:
    if not isinstance(tree, tuple):
        return [path]
    return leaf_paths(tree[2], 2 * path) + leaf_paths(tree[3], 2 * path + 1)


def grown(tree, splits: dict[int, tuple], path: int = 1):
    """``tree`` with its leaves at the paths of ``splits`` replaced."""
    if path in splits:
        return splits[path]
    if not isinstance(tree, tuple):
        return tree
    return (tree[0], tree[1], grown(tree[2], splits, 2 * path), grown(tree[3], splits, 2 * path + 1))


def leaf_of(tree, column, path: int = 1) -> Column:
    """The path of the leaf that a row is in."""
    if not isinstance(tree, tuple):
        return F.lit(path)
    name, at, left, right = tree
    return F.when(column(name, at), leaf_of(right, column, 2 * path + 1)).otherwise(leaf_of(left, column, 2 * path))


def step(g: float, h: float) -> float:
    return -RATE * g / (h + RIDGE)


def best_split(bins: dict[tuple[str, int], tuple[int, int]]) -> tuple | None:
    """(feature, bin, left leaf, right leaf) of the largest gain, ties to the first feature and bin."""
    best, found = 1e-9, None
    for name in FEATURES:
        mine = sorted((b, g / UNIT, h / UNIT) for (f, b), (g, h) in bins.items() if f == name)
        total_g, total_h = sum(x[1] for x in mine), sum(x[2] for x in mine)
        g = h = 0.0
        for b, dg, dh in mine[:-1]:
            g, h = g + dg, h + dh
            gain = g * g / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
            if gain > best + 1e-9:
                best, found = gain, (name, b, step(g, h), step(total_g - g, total_h - h))
    return found


def middles(values: list[float]) -> list[float]:
    """Cut points half way between neighbouring quantiles, so that what no row of the sample has goes
    with the nearer side."""
    known = sorted(set(values))
    return [(a + b) / 2 for a, b in zip(known, known[1:], strict=False)]


def fit_trees(rows: DataFrame, prior: float, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for log loss on ``rows`` (the FEATURES and y, at most some ten thousand rows)."""
    steps = F.array(*[F.lit(i / BINS) for i in range(BINS + 1)])
    found = rows.agg(*[F.percentile(f, steps).alias(f) for f in FEATURES]).first()
    forest = Forest(prior, {f: middles(found[f] or []) for f in FEATURES})
    binned = cut(rows.select("y", *[bin_of(f, forest.cuts[f]).alias(f) for f in FEATURES]), "url-bins")
    above = lambda name, at: F.col(name) > at
    for _ in range(trees):
        chance = 1 / (1 + F.exp(-forest_value(forest, above)))
        g = F.round((chance - F.col("y")) * UNIT).cast("long").alias("g")
        h = F.round(chance * (1 - chance) * UNIT).cast("long").alias("h")
        graded = binned.select(*FEATURES, g, h)
        tree: object = 0.0
        for _level in range(depth):
            cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x")
            sums = graded.select(leaf_of(tree, above).alias("leaf"), "g", "h", cells).groupBy("leaf", "x").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            nodes: dict[int, dict] = {}
            for r in sums.collect():
                nodes.setdefault(r["leaf"], {})[(r["x"]["f"], r["x"]["b"])] = (r["g"], r["h"])
            splits = {p: s for p in leaf_paths(tree) if p in nodes and (s := best_split(nodes[p]))}
            if not splits:
                break
            tree = grown(tree, splits)
        if not isinstance(tree, tuple):
            break
        forest.trees.append(tree)
    drop_cut(binned)
    return forest


def train(labelled: DataFrame, counts: DataFrame, share: float, sample: int = SAMPLE) -> Forest:
    """A forest from at most ``sample`` distinct labelled URLs, those of the smallest hashes."""
    distinct = labelled.groupBy("url").agg(F.first(F.struct(*[c for c in labelled.columns if c != "url"])).alias("r")).select("url", "r.*")
    drawn = distinct.orderBy(F.xxhash64("url"), "url").limit(sample)
    rows = cut(with_suffixes(drawn, counts, share, held_fold=True).select("y", *FEATURES), "url-sample")
    share = min(max(share, 1e-6), 1 - 1e-6)
    forest = fit_trees(rows, math.log(share / (1 - share)))
    drop_cut(rows)
    return forest


def block_scores(rows: DataFrame, forest: Forest) -> Column:
    """The forest's chance of block, from feature values."""
    above = lambda name, at: F.col(name) > F.lit(forest.cuts[name][at])
    return 1 / (1 + F.exp(-forest_value(forest, above)))


def labelled_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with host, path, query, rule, ruled (its verdict), y and fold, and the features."""
    host, path, query = url_parts(F.col("url"))
    parts = pages.select("*", host.alias("host"), path.alias("path"), query.alias("query"))
    fitted = parts.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"))
    ruled = fitted.select("*", F.col("fit.name").alias("rule"), F.col("fit.verdict").alias("ruled")).drop("fit")
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    return lexical(ruled).withColumns({"y": (F.col("ruled") == BLOCK).cast("int"), "fold": fold})


def filter_urls(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    verdict is that of the longest rule that fits; where none fits, block where score, the
    forest's chance of block, is at least 0.5. The forest learns from the URLs that rules decide;
    if these have one verdict only it is everybody's (score 0 or 1), and without any the verdict
    is allow. Null and broken URLs have an empty host and path and the features of what text there
    is. Repeated rows get a result each; ties of rules go by :func:`fitting_rule`; an empty table
    gives no rows; extra columns are not read, whatever their names.
    """
    rows = labelled_urls(pages.select("page_id", "url"), rules)
    labelled = rows.where("y IS NOT NULL").drop("page_id")
    n, blocked = labelled.agg(F.count("*"), F.sum("y")).first()
    if n and 0 < blocked < n:
        counts = cut(suffix_counts(labelled), "url-suffixes")
        forest = train(labelled, counts, blocked / n, sample)
        rows = with_suffixes(rows, counts, blocked / n, held_fold=False)
        score = block_scores(rows, forest)
    else:
        score = F.lit(float(bool(blocked)))
    scored = rows.select("page_id", "host", "path", "rule", "ruled", score.alias("score"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def keep_allowed(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> DataFrame:
    """``pages`` without the rows whose URL :func:`filter_urls` blocks; same columns. Verdicts hang on
    the URL alone, so they are made once for each distinct one."""
    urls = pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct().withColumn("page_id", F.col("url"))
    gone = filter_urls(urls, rules, sample).where(F.col("verdict") == BLOCK).select(F.col("page_id").alias("gone_url"))
    return pages.join(gone, F.coalesce(pages["url"], F.lit("")) == F.col("gone_url"), "left_anti")
