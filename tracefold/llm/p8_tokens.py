"""Problem 8: the corpus as token ids of a public byte-level BPE.

In each Arrow batch the new word pieces are merged together: a pair occurrence index
maps every pair to its positions over all pieces, the ranks present are applied in
ascending order, and only the lists of the neighbouring pairs are updated. Pieces seen
before come from a bounded table.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCAB = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published word pattern of this vocabulary.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces remembered by a worker; the table is emptied when it is full.
REMEMBERED = 400_000


class PairIndexBPE:
    """Byte-pair merging of many pieces at once by a pair occurrence index."""

    def __init__(self, path: str = VOCAB):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(WORD_PATTERN)
        by_id = {r: t for t, r in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.bytes_of = by_id
        self.pairs: dict[tuple[int, int], int] = {}
        #: Ids of pieces at the start of a text, and of pieces after a blank.
        self.first: dict[str, tuple[int, ...]] = {}
        self.rest: dict[str, tuple[int, ...]] = {}

    def _rank(self, a: int, b: int) -> int:
        """Id of the token made of tokens a and b, -1 if there is none."""
        r = self.pairs.get((a, b))
        if r is None:
            r = self.pairs[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word. One symbol array holds all words, -1 between them."""
        sym: list[int] = [-1]
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend(map(self.single.__getitem__, w))
            sym.append(-1)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        at: dict[int, list[int]] = defaultdict(list)  # rank of a pair -> positions of its left symbol
        rank = self._rank
        for i in range(1, n - 1):
            if sym[i] >= 0 and sym[i + 1] >= 0 and (r := rank(sym[i], sym[i + 1])) >= 0:
                at[r].append(i)
        active = list(at)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            where = at.pop(r, None)
            if where is None:
                continue
            where.sort()
            for i in where:
                a = sym[i]
                j = nxt[i]
                if a < 0 or j >= n or sym[j] < 0 or rank(a, sym[j]) != r:
                    continue
                k = nxt[j]
                sym[i], sym[j] = r, -2
                nxt[i], prv[k] = k, i
                h = prv[i]
                if sym[h] >= 0 and (s := rank(sym[h], r)) >= 0:
                    if s not in at:
                        heapq.heappush(active, s)
                    at[s].append(h)
                if sym[k] >= 0 and (s := rank(r, sym[k])) >= 0:
                    if s not in at:
                        heapq.heappush(active, s)
                    at[s].append(i)
        out = []
        for i in starts:
            ids = []
            while sym[i] >= 0:
                ids.append(sym[i])
                i = nxt[i]
            out.append(tuple(ids))
        return out

    def _learn(self, first: set[str], rest: set[str]) -> None:
        if len(self.pairs) > 4 * REMEMBERED:
            self.pairs.clear()
        cut = [(self.first, p, self.words.findall(p)) for p in first] + [(self.rest, p, self.words.findall(" " + p)) for p in rest]
        words = list({w for _, _, ws in cut for w in ws})
        ids = dict(zip(words, self.merge([w.encode() for w in words])))
        for known, p, ws in cut:
            known[p] = ids[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, ws)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offsets of each.

        A text is cut at each blank between two non-blank characters: no word of the
        pattern crosses such a place, nor looks beyond it.
        """
        split = [CUT.split(t) if t else [""] for t in texts]
        for _ in range(2):
            first = {s[0] for s in split}.difference(self.first)
            rest = set(chain.from_iterable(split)).difference(self.rest)
            if len(self.first) + len(self.rest) + len(first) + len(rest) <= REMEMBERED or not (self.first or self.rest):
                break
            self.first.clear()
            self.rest.clear()
        if first or rest:
            self._learn(first, rest)
        head, tail = self.first, self.rest.__getitem__
        flat: list[int] = []
        offsets = np.zeros(len(split) + 1, np.int64)
        for i, s in enumerate(split):
            it = iter(s)
            flat += head[next(it)]
            flat.extend(chain.from_iterable(map(tail, it)))
            offsets[i + 1] = len(flat)
        return np.array(flat, np.int32), offsets


_models: dict[str, PairIndexBPE] = {}


def model(path: str = VOCAB) -> PairIndexBPE:
    """The tokenizer of this Python worker, read once."""
    if path not in _models:
        _models[path] = PairIndexBPE(path)
    return _models[path]


def _batches(table: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` text bytes (a longer text is a slice of its own)."""
    lengths = np.asarray(table.column(1).to_pandas().str.len().fillna(0), dtype=np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield table.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield table.slice(start)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """``key`` and ids of every row. An empty text and a null text both have the empty list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocab)
        for whole in batches:
            for b in _batches(whole):
                flat, offsets = bpe.encode(b.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def lengths(docs: DataFrame, keys: list[str], text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """``keys`` and n_tokens of every row; 0 for empty and null texts. The text leaves the plan here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocab)
        for whole in batches:
            _, offsets = bpe.encode(whole.column(whole.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*whole.columns[:-1], pa.array(np.diff(offsets), pa.int64())], [*keys, "n_tokens"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, F.col(text).cast("string")).mapInArrow(run, f"{fields}, n_tokens bigint")
