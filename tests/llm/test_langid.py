import zlib

import numpy as np

from tapeglass.llm import langid


def test_blocked_marginals_equal_plain_ones():
    rng = np.random.default_rng(1)
    crf = langid.Crf(list("abc"), {}, np.zeros((1, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3))
    sizes = [1, 5, 400, 2, 130]
    e = rng.standard_normal((sum(sizes), 3)) * 2
    begins = np.zeros(len(e), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    begins[starts] = True
    got = langid.marginals_of(e, begins, crf)
    for at, n in zip(starts, sizes, strict=True):
        want, _ = langid.chain_marginals(e[None, at : at + n], crf.transitions, crf.start)
        assert np.allclose(got[at : at + n], want[0])


def test_held_out_accuracy_and_rows(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "123 ***", "en"), (None, "the cat", None)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(odd)
    got = langid.identify_languages(rows).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == rows.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[-1].lang_pred == by_id[-2].lang_pred == "und"
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_code_switched_words_and_no_labels(spark):
    en = "the house of the king was in that town and it is for the people".split()
    de = "das haus von dem könig war in der stadt und es ist für die leute".split()
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(w, 60)) for w in (en, de) for _ in range(30)]
    crf = langid.fit(texts, ["en"] * 30 + ["de"] * 30)
    words = langid.label_words("the people of that town was it und das haus ist für die leute", crf)
    assert [k for _, k in words][:5] == ["en"] * 5 and [k for _, k in words][-5:] == ["de"] * 5
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify_languages(docs).first().lang_pred == "und"
    assert langid.identify_languages(docs.limit(0)).count() == 0
