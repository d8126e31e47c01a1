"""Language of documents by a linear-chain conditional random field over words.

Every word gets emission scores from affix, character n-gram and lexicon features;
transitions between languages are learned too, from chains that splice segments of
different documents, so that code-switched text is labelled word by word. Forward-backward
gives each word's marginals, and a document's language is the one with the highest mean
marginal. Words outside a segment's evidence (digits, marks) are not in the chain.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeglass.llm.common import arrow_map

LETTERS = regex.compile(r"\p{L}+")
FEATURES = 1 << 16
SEGMENT = 25  # words of one document in a row when training chains are spliced
CHAIN = 100  # words of a training chain
BLOCK = 128  # steps of the blocked forward-backward
LONGEST_WORD = 24  # longer words are no feature of their own
LEXICON_DOCS = 4  # documents of the sample that a lexicon word must stand in
LEXICON_SHARE = 0.6
CACHED_WORDS = 600_000  # words whose emissions a task keeps before it starts anew


MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(LONGEST_WORD + 2)], dtype=np.uint64)


def bucket(h: np.ndarray, family: int) -> np.ndarray:
    h = (h + np.uint64(family)) * MIX[0]
    return ((h ^ (h >> np.uint64(29))) * MIX[1] >> np.uint64(48)).astype(np.int64)


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) pairs of lower-case words, hashed into FEATURES buckets: bigrams
    and trigrams with the word's ends marked (so affixes of 1 and 2 too), affixes of 3, the
    word itself up to LONGEST_WORD characters, and the lexicon that it is in."""
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(code))  # characters up to the word's end mark
    at, found = [], []

    def grams(where: np.ndarray, n: int, family: int) -> None:
        h = sum(code[where + j] * MIX[j] for j in range(n))
        at.append(owner[where])
        found.append(bucket(h, family))

    grams(np.flatnonzero(left >= 2), 2, 1)
    grams(np.flatnonzero(left >= 3), 3, 2)
    long = sizes >= 5
    grams(starts[long], 4, 3)
    grams(ends[long] - 4, 4, 4)
    short = np.flatnonzero(sizes <= LONGEST_WORD + 2)
    place = np.arange(len(code)) - np.repeat(starts, sizes)
    whole = np.add.reduceat(code * POWERS[np.minimum(place, LONGEST_WORD + 1)], starts)
    at.append(short)
    found.append(bucket(whole[short], 5))
    known = [(i, FEATURES + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    at.append(np.array([k[0] for k in known], dtype=np.int64))
    found.append(np.array([k[1] for k in known], dtype=np.int64))
    return np.concatenate(at), np.concatenate(found)


def build_lexicon(tokens: list[list[str]], labels: list[int], count: int) -> dict[str, int]:
    """Word -> the one language that most of the sample documents with the word are in."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for words, label in zip(tokens, labels, strict=True):
        for w in set(words):
            seen[w][label] += 1
    totals = Counter(labels)
    out = {}
    for w, by in seen.items():
        if sum(by.values()) >= LEXICON_DOCS:
            rate = np.array([by[k] / max(totals[k], 1) for k in range(count)])
            if rate.max() >= LEXICON_SHARE * rate.sum():
                out[w] = int(rate.argmax())
    return out


@dataclass
class Crf:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # (features + languages, languages), averaged per word over its features
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, languages): the summed weights over the root of the number of features."""
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)))
        at, found = word_features(words, self.lexicon)
        sums = [np.bincount(at, self.weights[found, k], len(words)) for k in range(len(self.languages))]
        return np.stack(sums, axis=1) / np.sqrt(np.bincount(at, minlength=len(words)))[:, None]


def chain_marginals(emissions: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, steps, labels) and summed transition counts of equal-long chains."""
    n, steps, labels = emissions.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    t = np.exp(trans)
    alpha = np.empty_like(e)
    a = np.exp(start) * e[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, steps):
        a = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    beta = np.ones((n, labels))
    out, pairs = np.empty_like(e), np.zeros((labels, labels))
    for i in range(steps - 1, -1, -1):
        m = alpha[:, i] * beta
        out[:, i] = m / m.sum(1, keepdims=True)
        if i:
            b = e[:, i] * beta
            joint = alpha[:, i - 1][:, :, None] * t[None] * b[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            beta = b @ t.T
            beta /= beta.sum(1, keepdims=True)
    return out, pairs


def fit(texts: list[str], langs: list[str], rounds: int = 40, seed: int = 7) -> Crf:
    """Maximum likelihood with a small ridge, by Adam over all chains at once."""
    languages = sorted(set(langs))
    labels = [languages.index(x) for x in langs]
    tokens = [LETTERS.findall(t.lower()) for t in texts]
    lexicon = build_lexicon(tokens, labels, len(languages))
    rng = np.random.default_rng(seed)
    segments = [(w[i : i + SEGMENT], k) for w, k in zip(tokens, labels, strict=True) for i in range(0, len(w), SEGMENT)]
    order = rng.permutation(len(segments))
    words = [w for i in order for w in segments[i][0]]
    gold = np.array([segments[i][1] for i in order for _ in segments[i][0]], dtype=np.int64)
    chains = max(1, len(words) // CHAIN)
    steps = min(CHAIN, len(words))
    words, gold = words[: chains * steps], gold[: chains * steps].reshape(chains, steps)
    count = len(languages)
    crf = Crf(languages, lexicon, np.zeros((FEATURES + count, count)), np.zeros((count, count)), np.zeros(count))
    if not words:
        return crf
    index: dict[str, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    owner, found = word_features(list(index), lexicon)
    scale = 1 / np.sqrt(np.bincount(owner))[:, None]
    own = np.eye(count)[gold]
    seen = np.zeros((count, count))
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    params = [crf.weights, crf.transitions, crf.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = chains * steps
    for r in range(1, rounds + 1):
        scores = np.stack([np.bincount(owner, crf.weights[found, k], len(index)) for k in range(count)], axis=1) * scale
        marginals, pairs = chain_marginals(scores[at].reshape(chains, steps, count), crf.transitions, crf.start)
        off = (marginals - own).reshape(-1, count)
        by_word = np.stack([np.bincount(at, off[:, k], len(index)) for k in range(count)], axis=1) * scale
        spread = by_word[owner]
        grads = [
            np.stack([np.bincount(found, spread[:, k], FEATURES + count) for k in range(count)], axis=1) / total + 1e-6 * crf.weights,
            (pairs - seen) / total + 1e-6 * crf.transitions,
            (marginals[:, 0] - own[:, 0]).mean(0),
        ]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return crf


def marginals_of(emissions: np.ndarray, begins: np.ndarray, crf: Crf) -> np.ndarray:
    """Marginals of many chains laid end to end; ``begins`` flags each chain's first word.

    Forward-backward by blocks: the blocks' products of transition matrices run side by
    side, their boundary messages in a row, then the messages inside all blocks. At a
    chain's first word the matrix has equal rows, which cuts it off from what is before."""
    n, labels = emissions.shape
    blocks = -(-n // BLOCK)
    e = np.ones((blocks * BLOCK, labels))
    e[:n] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    flag = np.ones(blocks * BLOCK, dtype=bool)
    flag[:n] = begins
    e, flag = e.reshape(blocks, BLOCK, labels), flag.reshape(blocks, BLOCK, 1, 1)
    steady, fresh = np.exp(crf.transitions)[None], np.tile(np.exp(crf.start), (labels, 1))[None]

    def matrices(i: int) -> np.ndarray:
        return np.where(flag[:, i], fresh, steady) * e[:, i, None, :]

    product = np.tile(np.eye(labels), (blocks, 1, 1))
    for i in range(BLOCK):
        product = product @ matrices(i)
        product /= product.sum((1, 2), keepdims=True)
    into, back = np.empty((blocks, labels)), np.empty((blocks, labels))
    a = np.ones(labels) / labels
    for c in range(blocks):
        into[c] = a
        a = a @ product[c]
        a /= a.sum()
    b = np.ones(labels) / labels
    for c in range(blocks - 1, -1, -1):
        back[c] = b
        b = product[c] @ b
        b /= b.sum()
    alpha = np.empty_like(e)
    for i in range(BLOCK):
        into = (into[:, None, :] @ matrices(i))[:, 0]
        into /= into.sum(1, keepdims=True)
        alpha[:, i] = into
    out = np.empty_like(e)
    for i in range(BLOCK - 1, -1, -1):
        m = alpha[:, i] * back
        out[:, i] = m / m.sum(1, keepdims=True)
        back = (matrices(i) @ back[:, :, None])[:, :, 0]
        back /= back.sum(1, keepdims=True)
    return out.reshape(-1, labels)[:n]


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, per_language: int, max_chars: int) -> tuple[list[str], list[str]]:
    """About ``per_language`` labelled texts of each language, none longer than ``max_chars`` and twice
    as many in all at most, drawn by a hash of doc_id and text among the rows that are not held out."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    place = F.xxhash64("doc_id", "text", F.lit("train"))
    drawn = usable.where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "text", "lang", place.alias("place"))
    rows = drawn.orderBy("place").limit(2 * per_language * max(1, len(counts))).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def labeller(model: Crf):
    """A function from texts to (language, score) lists; a task keeps one for all its batches."""
    cache: dict[str, bytes] = {}
    labels = len(model.languages)

    def label(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        tokens = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        counts = np.array([len(words) for words in tokens])
        if len(cache) > CACHED_WORDS:
            cache.clear()
        new = list(set().union(*tokens).difference(cache))
        cache.update(zip(new, map(bytes, model.emissions(new).astype("<f8")), strict=True))
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        full = np.flatnonzero(counts)
        if len(full) and labels:
            packed = b"".join(b"".join(map(cache.__getitem__, words)) for words in tokens)
            e = np.frombuffer(packed, dtype="<f8").reshape(-1, labels)
            starts = (np.cumsum(counts) - counts)[full]
            begins = np.zeros(len(e), dtype=bool)
            begins[starts] = True
            mean = np.add.reduceat(marginals_of(e, begins, model), starts, axis=0) / counts[full][:, None]
            for i, best, s in zip(full, mean.argmax(1), mean.max(1), strict=True):
                pred[i], score[i] = model.languages[best], min(1.0, s)
        return pred, score

    return label


def predict(docs: DataFrame, crf: Crf) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # fixed size: the hashed features and a sample's lexicon

    def make():
        label = labeller(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            pred, score = label(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred), pa.array(score)], names=["doc_id", "lang_pred", "score"])

        return work

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double", rows=256)


def keep_identified(docs: DataFrame, crf: Crf, least_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text has a language (not "und") with at least ``least_score``.

    All columns pass through unchanged; null text and text without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    at = docs.columns.index("text")

    def make():
        label = labeller(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            pred, score = label(batch.column(at).to_pylist())
            return batch.filter(pa.array([p != "und" and s >= least_score for p, s in zip(pred, score, strict=True)], pa.bool_()))

        return work

    return arrow_map(docs, make, docs.schema, rows=256)


def train(docs: DataFrame, per_language: int = 250, max_chars: int = 8000) -> Crf:
    return fit(*sample(docs, per_language, max_chars))


def identify_languages(docs: DataFrame, per_language: int = 250, max_chars: int = 8000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    The model is fitted on a bounded sample: about ``per_language`` texts of at most
    ``max_chars`` characters for each language, never from the held-out quarter. Text that
    is null or has no letter: "und" with score 0. With no labelled row at all every text is
    "und". A null doc_id is not held out. Repeated rows each give a row; lang, source and
    doc_id are no inputs of a prediction; other columns are not read.
    """
    crf = train(docs, per_language, max_chars)
    found = predict(docs, crf)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def label_words(text: str, crf: Crf) -> list[tuple[str, str]]:
    """Words of one text with their languages, for code-switched text."""
    words = LETTERS.findall(text)
    if not words:
        return []
    e = crf.emissions([w.lower() for w in words])
    begins = np.zeros(len(words), dtype=bool)
    begins[0] = True
    return [(w, crf.languages[k]) for w, k in zip(words, marginals_of(e, begins, crf).argmax(1), strict=True)]
