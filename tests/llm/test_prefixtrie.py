"""Prefix trie against brute force over all prefixes, with blocks and partitions of every size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tapeglass.llm import prefixtrie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, p in whole.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(WORDS.findall(p[-1][1])) if p else 0) + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), up, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs=300):
    rng = random.Random(seed)
    pool = [("user", f"w{i} " * (i % 4)) for i in range(3)]
    rows = []
    for c in range(convs):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            role, text = rng.choice(pool) if rng.random() < 0.9 else ("system", f"only {c} {t}")
            rows.append((c, t, role, text))
    return rows


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_equals_brute_force(spark, block):
    rows = made(block)
    assert sorted(map(tuple, prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA), block).collect()), key=str) == brute(rows)


def test_one_hot_conversation_and_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 2000, 20) for t in range(6)]
    rows += [(7, t, "user", f"turn {t}") for t in range(3000)] + [(27, 0, "user", "x" * 100_000)]
    assert sorted(map(tuple, prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 16).collect()), key=str) == brute(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(0, None, "user", "a"), (0, 0, None, None), (0, 0, None, None), (0, 1, "user", ""), (1, 5, "user", None), (1, 5, "bot", None), (None, 0, "user", "z")]
    rows += [(-40, 0, "user", "a"), (-21, 1, "user", "b"), (3, 2, "user", "c d e")]
    more = [(*r, b"n", 9) for r in rows]
    turns = spark.createDataFrame(more, SCHEMA + ", path binary, depth int")
    assert [r.n_convs for r in prefixtrie.prefix_trie(turns).collect() if r.depth == 0] == [5]
    kept = [r for r in rows if r[0] is None or r[0] >= 0]
    assert sorted(map(tuple, prefixtrie.prefix_trie(spark.createDataFrame(kept, SCHEMA)).collect()), key=str) == brute(kept)
    assert prefixtrie.prefix_trie(turns.where("conv_id IS NULL")).collect() == []


def test_turnless_conversation_is_a_member_of_the_root(spark):
    own = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(own, 0, "user", "gone"), (40, 0, "user", "a b")]
    got = sorted(map(tuple, prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
    assert [r for r in got if r[1] == 0][0][7] == hashlib.sha256(str(own).encode()).hexdigest()


def test_sql_equals_brute_force():
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = made(3)
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(prefixtrie.TRIE_SQL).fetchall(), key=str) == brute(rows)
