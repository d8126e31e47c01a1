"""Spelling variants against brute force over all pairs, and against the SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb

from tapeglass.llm import variants

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    found, forms = {w: [x for x in words if near(w, x)] for w in words}, {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            forms[w] = best
    out = []
    for w, k in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, k, len(found[w]), words[forms[w]] if w in forms else None))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted(map(tuple, variants.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def test_equals_brute_force_on_dense_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abÀ") for _ in range(rng.randint(6, 9))) for _ in range(250)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 + 40 * (k < 5) for k in range(250)], k=60))) for i in range(120)]
    want = brute(rows)
    assert got(spark, rows) == want
    assert sum(r[4] for r in want) > 100 and any(r[1] for r in want)


def test_long_words_and_runs_of_one_letter(spark):
    rng = random.Random(8)
    rows = []
    for size in (31, 32, 33, 34, 63, 64, 65, 66, 97, 300):
        base = "".join(rng.choice("abc") for _ in range(size))
        forms = [base] + [base[:i] + "x" + base[i:] for i in (0, size // 2, size)] + [base[:i] + base[i + 1 :] for i in (0, size // 2, size - 1)]
        forms += [base[:i] + "z" + base[i + 1 :] for i in (0, 1, 31 % size, 32 % size, size // 2, size - 1)]
        rows += [(i, f"{w} {w}") for i, w in enumerate(forms)]
    rows += [(i, ("a" * k + " ") * 2) for i, k in enumerate(range(7, 40))]
    assert got(spark, rows) == brute(rows)


def test_chains_of_forms(spark):
    rows = [(i, " ".join([w] * k)) for i, (w, k) in enumerate([("abcdefgh", 2500), ("abcdefgi", 240), ("abcdefji", 22), ("abcdekji", 2)])]
    want = brute(rows)
    assert got(spark, rows) == want
    assert len({r[2] for r in want}) == 1


def test_nulls_empty_ties_repeats_and_clashing_columns(spark):
    rows = [(None, "Straßenbahn STRASSENBAHN straßenbahn"), (1, None), (2, ""), (3, "zebraaaa zebraaab zebraaac " * 3), (3, "zebraaaa zebraaab zebraaac " * 3), (4, "÷÷÷÷÷÷÷× 日本語テキスト ÷÷÷÷÷÷÷×")]
    assert got(spark, rows) == brute(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    assert sorted(map(tuple, variants.group_variants(docs).collect()), key=str) == brute(rows)
    assert variants.group_variants(docs.where("doc_id > 99")).collect() == []


def test_sql_equals_brute_force():
    rng = random.Random(2)
    words = ["".join(rng.choice("abÉé") for _ in range(rng.randint(6, 9))) for _ in range(120)]
    rows = [(i if i else None, " ".join(rng.choices(words, k=40))) for i in range(40)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({variants.VARIANTS_SQL})").fetchall()
    assert sorted(found, key=str) == brute(rows)
