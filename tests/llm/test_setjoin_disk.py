"""Shuffles of the set join are freed before the next large one is written."""

from tapeglass.llm import setjoin


def test_shuffles_are_freed_between_steps(spark, monkeypatch):
    steps, cut, free = [], setjoin.cut, setjoin.free_shuffles
    monkeypatch.setattr(setjoin, "cut", lambda df, name, *a: steps.append(name) or cut(df, name, *a))
    monkeypatch.setattr(setjoin, "free_shuffles", lambda s: steps.append("free") or free(s))
    same = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, same), (2, same + " more"), (3, "other words only here"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setjoin.join_documents(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    for before, after in (("join-described", "join-groups"), ("join-groups", "join-pairs"), ("join-sets", "join-links"), ("join-links", "join-roots")):
        assert "free" in steps[steps.index(before) : steps.index(after)]
