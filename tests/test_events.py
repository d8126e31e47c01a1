"""Article events against brute force over all pairs; components against a plain union-find."""

import random
import re

from tapeglass.operators import events
from tapeglass.operators.graph import component_roots
from tapeglass.operators.news import SAME_WORD, STOPWORDS

HOUR = 3600 * 10**6
START = 1_700_000_000_000_000
SCHEMA = "article_id long, url string, title string, summary string, first_seen_us long"


def words_of(text):
    out = set()
    for w in re.findall("[a-z0-9]+", text.lower()):
        if len(w) > 2 and w not in STOPWORDS:
            form = SAME_WORD.get(w, w)
            if len(form) > 4 and form.endswith("s"):
                form = SAME_WORD.get(form[:-1], form[:-1])
            out |= {w} | ({form} if len(form) > 2 and form not in STOPWORDS else set())
    return out


def alike(a, b):
    s = len(a & b)
    return max(s / len(a | b), 0.75 * s / min(len(a), len(b)), 0.42 if s >= 5 else 0) if s else 0


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def made(seed, count=160):
    rng = random.Random(seed)
    pool = [f"w{i:03d}" for i in range(120)] + ["digital", "assets", "appoints", "names", "rates", "cryptocurrency", "the"]
    rows = []
    for i in range(count):
        title = " ".join(rng.choice(pool[:40]) if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 10])))
        us = None if rng.random() < 0.04 else START + rng.randrange(24 * 9) * HOUR
        rows.append((i, f"http://h{i % 5}.x/{i}", title, None if i % 3 else "", us))
        if rng.random() < 0.2:
            rows.append((1000 + i, f"http://www.c.x/{i}", title, "more", us and us + rng.randrange(60) * HOUR))
    return rows


def linked(rows):
    sets = {r[0]: words_of(f"{r[2] or ''} {r[3] or ''}") for r in rows}
    out = []
    for i, a in enumerate(rows):
        for b in rows[:i]:
            near = a[4] is None or b[4] is None or abs(a[4] - b[4]) <= 24 * HOUR
            if near and alike(sets[a[0]], sets[b[0]]) >= 0.42:
                out.append((a[0], b[0]))
    return sets, out


def test_clusters_equal_all_pairs(spark):
    rows = made(1)
    _, links = linked(rows)
    got = {r.article_id: r.cluster_id for r in events.clustered_articles(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == roots_of([r[0] for r in rows], links)


def test_pairs_equal_all_pairs(spark):
    rows = made(2, 90)
    sets, links = linked(rows)
    day = lambda us: None if us is None else us // (24 * HOUR)
    at = {r[0]: r[4] for r in rows}
    unit = {}
    for r in sorted(rows):
        unit.setdefault((frozenset(sets[r[0]]), day(r[4])), r[0])
    of = {r[0]: unit[(frozenset(sets[r[0]]), day(at[r[0]]))] for r in rows}
    want = {(min(of[a], of[b]), max(of[a], of[b])) for a, b in links if sets[a] != sets[b]}
    found = events.article_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)
    assert all(r.similarity >= 0.42 and abs(r.similarity - alike(sets[r.a], sets[r.b])) < 1e-9 for r in found)


def test_a_large_family_of_near_copies_is_one_event(spark):
    base = " ".join(f"common{i}" for i in range(8))
    rows = [(i, f"http://a/{i}", f"{base} own{i}", None, START + (i % 20) * HOUR) for i in range(400)] + [(999, "http://b/1", "elsewhere entirely", None, START)]
    found = events.clustered_articles(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.cluster_id for r in found} == {0, 999}


def test_known_headlines(spark):
    rows = [
        (1, "https://example.com/a", "Trump appoints pro crypto regulator to lead SEC", "The new SEC chair is viewed as friendly to digital assets.", START),
        (2, "https://wire.example/b", "Trump names pro digital asset advocate as SEC chair", "The nominee is expected to take a friendlier stance toward crypto regulation.", START),
        (3, "https://www.example.com/c", "Yankees starting pitcher scratched from tonight's game", None, START),
    ]
    clustered = events.clustered_articles(spark.createDataFrame(rows, SCHEMA))
    got = {r.cluster_id: r for r in events.article_clusters(clustered).collect()}
    assert set(got) == {1, 3} and got[1].articles == 2 and got[1].sources == 2 and got[1].domains == "example.com wire.example" and got[3].domains == "example.com"
    assert got[1].representative_id == 2 and len(got[1].fingerprint) == 64
    tokens = next(r.tokens for r in clustered.collect() if r.article_id == 2)
    assert {"crypto", "digital", "appoint", "friendly"} <= set(tokens) and "the" not in tokens


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "u", "a of", None, START)], SCHEMA)
    assert {r.article_id: r.cluster_id for r in events.clustered_articles(df).collect()} == {1: 1, 2: 2}
    assert events.article_clusters(events.clustered_articles(df)).count() == 2
    assert events.clustered_articles(df.where("article_id > 9")).collect() == []


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(300, 0, -1)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    mixed = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)] + [(5000, 5000), (None, 7)]
    links = chain + star + mixed
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots_of({n for link in real for n in link}, real)
