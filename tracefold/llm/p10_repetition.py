"""Problem 10: repetition inside a single document, judged by weak supervision.

One pass over the texts measures repetition in ways that differ: shingles of words, bytes a
compressor saves, whole sentences told again, growth of the vocabulary, the commonest phrase,
and new words in the second half. Rules turn the measures into votes (repetitive, clean, or
none, where a measure says little); expectation-maximisation over the counts of vote patterns
of the whole corpus estimates how far each rule can be trusted, and gives every pattern the
posterior probability of a repetitive text, which alone decides. There are at most 3**6
patterns, so only these counts reach the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.runtime import materialize

WORD = re.compile(r"[^\W\d_]+")
#: Words and ends of sentences.
TOKEN = re.compile(r"[^\W\d_]+|[.!?;](?=\s)|\n")
#: Words of a shingle.
N = 5
#: Each rule: what it votes repetitive beyond, and what it votes clean beyond. In between it abstains.
RULES = {
    "shingles": (0.3, 0.2),  # share of words in shingles met before
    "compression": (-0.36, -0.4),  # compressed size over size, negative
    "sentences": (0.2, 0.05),  # share of words in sentences met before
    "vocabulary": (-0.35, -0.6),  # different words over those expected of such a length, negative
    "phrase": (0.1, 0.05),  # share of words in the commonest phrase of three words
    "novelty": (-0.35, -0.6),  # share of words of the second half that the first one does not have, negative
}
#: Words of a text below which only shingles and sentences are worth a vote.
SHORT = 40
#: Words of a batch of texts that are measured together.
BATCH_WORDS = 1_000_000
PRIOR = 0.05


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ids of the pairs (a, b): exact, no hashing of contents."""
    width = int(b.max()) + 1 if len(b) else 1
    return pd.factorize(a.astype(np.int64) * width + b)[0]


def _covered(gram: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which words lie in a shingle of ``n`` words that occurred before."""
    again = pd.Series(gram).duplicated(keep="first").to_numpy()
    step = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step)[:total] > 0


def _share(gram: np.ndarray, doc: np.ndarray, docs: int, n: int) -> np.ndarray:
    """Share of words in repeated shingles of ``n`` words, of each text; a text of fewer than ``n`` + 1 words has none."""
    total, m = len(doc), len(gram)
    if not m:
        return np.zeros(docs)
    inside = doc[:m] == doc[n - 1 :]
    key = np.where(inside, _pairs(gram, doc[:m]), -1 - np.arange(m))
    words = np.maximum(np.bincount(doc, minlength=docs), 1)
    return np.bincount(doc, weights=_covered(key, n, total), minlength=docs) / words


def _longer(a: np.ndarray, n: int, b: np.ndarray) -> np.ndarray:
    """Ids of shingles made of those in ``a`` (n words) and the ones in ``b`` right behind."""
    m = max(0, len(b) - n)
    return _pairs(a[:m], b[n:]) if m else np.zeros(0, np.int64)


def _told_again(word: np.ndarray, doc: np.ndarray, sentence: np.ndarray, docs: int) -> np.ndarray:
    """Share of the words of each text that stand in sentences of two words and more seen before. Sentences are compared by a 64-bit hash: this is one vote, no result."""
    if not len(word):
        return np.zeros(docs)
    start = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    size = np.diff(np.r_[start, len(word)])
    place = np.arange(len(word)) - np.repeat(start, size)
    x = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), 0xD6E8FEB86659FD93, np.uint64))
        key = np.add.reduceat(x * power[place], start)
    again = pd.DataFrame({"d": doc[start], "k": key, "n": size}).duplicated().to_numpy() & (size > 1)
    return np.bincount(doc[start], weights=size * again, minlength=docs) / np.maximum(np.bincount(doc, minlength=docs), 1)


def measure(texts: list[str | None]) -> pd.DataFrame:
    """n_words, share (repeated words by shingles of five) and the pattern of the votes of RULES: 1 repetitive, 0 clean, 2 none. Null and empty texts: no words, no votes."""
    split = [TOKEN.findall((t or "").lower()) for t in texts]
    docs = len(split)
    every = np.array([w for s in split for w in s], dtype=object)
    code, kinds = pd.factorize(every) if len(every) else (np.zeros(0, np.int64), every)
    is_word = np.array([k[0].isalpha() for k in kinds], dtype=bool)[code] if len(every) else np.zeros(0, bool)
    owner = np.repeat(np.arange(docs), [len(s) for s in split])
    sentence = (np.cumsum(~is_word) + owner)[is_word]  # a text begins a new one as well
    word, doc = code[is_word], owner[is_word]
    n = np.bincount(doc, minlength=docs)
    two = _longer(word, 1, word)
    three = _longer(two, 2, word)
    share = _share(_longer(three, 3, two), doc, docs, N)
    least = np.maximum(n, 1)
    got = np.full((len(RULES), docs), np.nan)
    got[0], got[2] = share, _told_again(word, doc, sentence, docs)
    words, end = every[is_word], np.cumsum(n)
    for i in np.flatnonzero(n >= SHORT):
        plain = " ".join(words[end[i] - n[i] : end[i]].tolist()).encode()
        got[1, i] = -len(zlib.compress(plain, 6)) / len(plain)
    if len(word):
        fresh = ~pd.Series(_pairs(word, doc)).duplicated().to_numpy()
        place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
        late = place >= (n // 2)[doc]
        both = ~pd.Series(_pairs(_pairs(word, doc), late.astype(np.int64))).duplicated().to_numpy()
        kinds, behind, new = (np.bincount(doc[x], minlength=docs) for x in (fresh, both & late, fresh & late))
        got[3], got[5] = -kinds / (6.0 * least**0.6), -new / np.maximum(behind, 1)
        top = np.zeros(docs)
        if len(three):
            inside = doc[:-2] == doc[2:]
            key = _pairs(three, doc[:-2])[inside]
            np.maximum.at(top, doc[:-2][inside], np.bincount(key)[key] if len(key) else 0)
        got[4] = np.where(top > 2, 3 * top / least, 0.0)
    got[[3, 4, 5]] = np.where(n >= SHORT, got[[3, 4, 5]], np.nan)
    got = np.where(n >= N, got, np.nan)
    bounds = np.array(list(RULES.values()))
    votes = np.where(np.isnan(got), 2, np.where(got > bounds[:, :1], 1, np.where(got < bounds[:, 1:], 0, 2)))
    return pd.DataFrame({"n_words": n, "share": share, "pattern": (votes.astype(np.int64).T * 3 ** np.arange(len(RULES))).sum(axis=1)})


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_words, share, pattern of every row, in one pass over whole texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, start = 0, 0
            t, cuts = b.column(1).to_pylist(), []
            for i, x in enumerate(t):
                size += len(x or "") // 6
                if size > BATCH_WORDS:
                    cuts.append(i + 1)
                    size = 0
            for end in [*cuts, len(t)]:
                if end > start:
                    m = measure(t[start:end])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), *(pa.array(m[c].to_numpy()) for c in m)], [key, *m.columns])
                start = end

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_words bigint, share double, pattern bigint")


def fit(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Posterior of a repetitive text for each vote pattern, by expectation-maximisation over pattern counts.

    A rule's vote counts by how often it is right in either class, smoothed by one half; to
    begin with in nine cases of ten. That a rule abstains tells nothing.
    """
    patterns = np.array(sorted(counts), dtype=np.int64)
    if not len(patterns):
        return {}
    weight = np.array([counts[int(p)] for p in patterns], dtype=float)
    vote = (patterns[:, None] // 3 ** np.arange(len(RULES))) % 3
    say = np.tile(np.array([[[0.9, 0.1, 1.0], [0.1, 0.9, 1.0]]]), (len(RULES), 1, 1))  # rule, class, outcome
    prior, post = PRIOR, np.zeros(len(patterns))
    for _ in range(rounds):
        ll = np.stack([np.log(say[np.arange(len(RULES))[None, :], c, vote]).sum(axis=1) for c in (0, 1)])
        odds = ll[1] - ll[0] + math.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        prior = float(np.clip((weight * post).sum() / weight.sum(), 1e-6, 0.5))
        for c, p in ((0, 1 - post), (1, post)):
            for o in range(2):
                say[:, c, o] = ((weight * p)[:, None] * (vote == o)).sum(axis=0) + 0.5
        say[:, :, :2] /= say[:, :, :2].sum(axis=2, keepdims=True)
    return {int(p): float(x) for p, x in zip(patterns, post)}


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, repeated_share, posterior of every row. A null or empty text has the share 0."""
    f = materialize(features(docs, key, text))
    counts = {r["pattern"]: r["n"] for r in f.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    post = fit(counts)
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(post.items()) or [(0, 0.0)], "pattern bigint, posterior double")
    return f.join(F.broadcast(known), "pattern", "left").select(key, F.col("share").alias("repeated_share"), F.coalesce("posterior", F.lit(0.0)).alias("posterior"))


def repetitive(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` of the texts that the posterior holds for repetitive."""
    return quality(docs, key, text).where("posterior > 0.5").select(key)
