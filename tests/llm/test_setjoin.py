import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeglass.llm import setjoin
from tapeglass.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        for j, c in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(words, draw, edits):
    out = list(words)
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.randrange(3)
        if kind == 0:
            out[at] = f"n{draw.randrange(10**6)}"
        elif kind == 1 and len(out) > 1:
            out.pop(at)
        else:
            out.insert(at, f"i{draw.randrange(10**6)}")
    return out


def fixture():
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(3000)}"
    rows = [(0, ""), (1, None), (2, "  \n"), (3, "a"), (4, "A"), (5, "a b"), (6, "É x"), (7, "é x")]
    passage = [word() for _ in range(60)]
    for size in (3, 6, 8, 12, 20, 45, 70, 100, 160, 300, 900):
        for _ in range(3):
            base = [word() for _ in range(size)]
            rows.append((len(rows), " ".join(base)))
            for copy in range(6):
                rows.append((len(rows), " ".join(edited(base, draw, draw.randrange(1 + size // 18)))))
            rows.append((len(rows), " ".join(base).upper()))
    for _ in range(30):  # unrelated documents that share a passage
        rows.append((len(rows), " ".join([*(word() for _ in range(80)), *passage, *(word() for _ in range(40))])))
    base = [word() for _ in range(200)]
    for _ in range(60):  # one large group of near copies
        rows.append((len(rows), " ".join(edited(base, draw, draw.randrange(5)))))
    return rows


def test_components_equal_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join_documents(docs).collect()}
    want = brute(rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.floats(0, 0.15))
def test_pigeonhole_never_misses_a_link(size, seed, rate):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    keep = rng.random(len(a)) > rate
    b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**63, int(rate * size)).astype(np.uint64)]))
    common = len(np.intersect1d(a, b))
    if not len(b) or 4 * common < 3 * (len(a) + len(b) - common):
        return
    hot = setjoin.entries_of(a, setjoin.NO_COSTS)[0][: size // 3]
    keys = np.sort((hot & np.uint64(0xFFFFFFFF00000000)) | setjoin.short(hot).astype(np.uint64))
    for costs in (setjoin.NO_COSTS, setjoin.Costs(keys, np.full(len(keys), 9))):  # with hot signatures, deletion neighbourhoods are used
        large, small = (a, b) if len(a) >= len(b) else (b, a)
        sig, kind, _ = setjoin.entries_of(large, costs)
        other, other_kind, _ = setjoin.entries_of(small, costs)
        asked, exact, near = (set(sig[(kind & k) > 0]) for k in (setjoin.PROBE, setjoin.WIDE, setjoin.NEAR))
        full, deleted = (set(other[(other_kind & k) > 0]) for k in (setjoin.INDEX, setjoin.DELETED))
        assert asked & full or exact & deleted or near & full


def test_blocks_and_spanning_links():
    rng = np.random.default_rng(2)
    linked = rng.random((60, 60)) < 0.02
    linked = linked | linked.T
    np.fill_diagonal(linked, False)

    def parts(edges):
        label = list(range(60))
        for _ in range(60):
            for i, j in edges:
                label[i] = label[j] = min(label[i], label[j])
        return label

    few = setjoin.spanning_links(linked)
    assert parts(few) == parts(list(zip(*np.nonzero(linked), strict=True))) and len(few) < 60
    codes, owner = rng.integers(0, 9000, 3000), rng.integers(0, 40, 3000)
    pairs = np.unique(np.stack([codes, owner]), axis=1)
    sets = [set(pairs[0][pairs[1] == k]) for k in range(40)]
    got = setjoin.overlaps(pairs[0], pairs[1], 40, wide=1000)
    assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(40) for j in range(40))


def test_one_of_each_group_stays(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(5, words, "x"), (3, words + " end", "y"), (9, "other text", "z"), (9, "other text", "z"), (None, words, None), (7, "", ""), (7, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    left = sorted((str(r.doc_id), r.text) for r in setjoin.keep_one_per_group(docs).collect())
    assert left == [("3", words + " end"), ("7", ""), ("7", ""), ("9", "other text")]
    assert setjoin.keep_one_per_group(docs.limit(0)).count() == 0
    assert setjoin.join_documents(docs.limit(0)).count() == 0
    again = {(r.doc_id, r.component_id) for r in setjoin.join_documents(docs).collect()}
    assert again == {(5, 3), (3, 3), (9, 9), (None, 3), (7, 7)}


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
