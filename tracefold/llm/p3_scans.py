"""Problem 3: text of scanned pages repaired into continuous paragraphs.

The lines of a record are labelled as header, page number, body or break by a hidden Markov
model over layout features, fitted by expectation-maximisation on the lines of all records.
Words of body lines that the unscanned part of the corpus does not know are compared with
known words over the usual confusions of character recognition; words cut at a line end are
joined if the corpus knows the whole. Word counts, candidates and decisions are joins on
words; only the parameters of the model reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.runtime import materialize, salted_join

HEADER, PAGE, BODY, BREAK = range(4)
#: Outer lines of a page that may be headers or page numbers.
EDGE = 2
#: Documents that have a line, digits aside, at the edge of a page for it to count as known there.
KNOWN_EDGE = 3
#: Share of all places of such a line, in all documents, that are at an edge: running text stands anywhere.
ONLY_EDGE = 0.9
#: A known word takes the place of another if it is this many times as frequent, and seen at least MIN_SEEN times.
TIMES, MIN_SEEN = 20, 3
ROUNDS = 4
#: Letters of a word beyond which no misreading is looked for: each place of a word makes candidates, and none is a known word of such a length.
MOST_LETTERS = 100
MARKS = "-­‐‑¬"
NUMBER_LINE = re.compile(r"(?i)^[\[(–—-]*\s*(?:(?:page|seite|página|pagina|pág\.?|p\.|s\.)\s*)?(?:\d{1,9}|[ivxl]{1,9}|(?=.*[\dl|])[\dlo|!i]{1,4})(?:\s*(?:/|of|von|de|sur)\s*[\dlo|!]{1,4})?\s*[\])–—-]*$")
# What is misread for what. Left what stands in the text, right what may be meant.
CONFUSED = [
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("q", "g"), ("g", "q"), ("!", "i"), ("!", "l"), ("5", "s"), ("$", "s"), ("0", "o"), ("0", "l"), ("1", "l"), ("1", "i"),
    ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("i", "r"), ("r", "i"), ("(", "c"), ("|", "l"), ("|", "i"), ("8", "b"), ("6", "b"), ("9", "g"), ("@", "a"), ("u", "n"), ("n", "u"), ("u", "v"), ("v", "u"), ("n", "h"), ("h", "n"), ("s", "5"), ("4", "a"), ("3", "e"), ("2", "z"), ("7", "t"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("m", "in"), ("in", "m"), ("m", "ni"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("tl", "h"), ("lc", "k"), ("iii", "m"), ("ci", "a"), ("cj", "g"), ("fi", "h"),
]


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def _pages(text: str, lines: list[str], spans: list[dict] | None) -> list[tuple[int, int]]:
    """Line ranges of the pages: by the page spans, or all lines as one page."""
    if not spans:
        return [(0, len(lines))]
    starts = np.cumsum([0] + [len(x) + 1 for x in lines])[:-1]
    cut = sorted({int(np.searchsorted(starts, s["span_start"])) for s in spans if s and s["span_start"] is not None} | {0})
    return [(a, b) for a, b in zip(cut, [*cut[1:], len(lines)]) if b > a]


def mask(line: str) -> str:
    return re.sub(r"\d+", "0", " ".join(line.split())).lower()


def edges(text: str, spans: list[dict] | None) -> list[tuple[int, str]]:
    """(index, masked line) of the outer lines of each page, pure numbers aside."""
    lines, out = split_lines(text), {}
    for a, b in _pages(text, lines, spans):
        full = [i for i in range(a, b) if lines[i].strip()]
        for i in full[:EDGE] + full[-EDGE:]:
            if not NUMBER_LINE.match(lines[i].strip()):
                out[i] = mask(lines[i])
    return sorted(out.items())


def _alike(a: str, b: str) -> bool:
    """Same line but for a few misread characters."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 3 or len(a) < 6:
        return False
    n = min(len(a), len(b))
    same = sum(x == y for x, y in zip(a, b))
    back = sum(x == y for x, y in zip(a[::-1], b[::-1]))
    return max(same, back, next((i for i in range(n) if a[i] != b[i]), n) + next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)) >= 0.85 * max(len(a), len(b))


#: Sizes of the features: place, shape, end, room, capitals, repetition.
SIZES = (2, 4, 3, 3, 3, 3)


def observe(text: str, spans: list[dict] | None, known: set[int]) -> np.ndarray:
    """Layout features of every line. ``known``: lines that many documents have at the edge of a page."""
    lines = split_lines(text)
    out = np.zeros((len(lines), len(SIZES)), np.int8)
    edge = dict(edges(text, spans))
    pages = _pages(text, lines, spans)
    page_of = {i: p for p, (a, b) in enumerate(pages) for i in range(a, b)}
    lengths = sorted(len(x.rstrip()) for x in lines if x.strip())
    width = lengths[int(len(lengths) * 0.95)] if lengths else 0
    strip = {i: re.sub(r"\b(?:p\.? ?|page |seite )?0\b|[^\w ]", "", m).strip() for i, m in edge.items()}
    for p, (a, b) in enumerate(pages):
        full = [i for i in range(a, b) if lines[i].strip()]
        outer = set(full[:EDGE] + full[-EDGE:])
        for k, i in enumerate(full):
            s, o = lines[i].strip(), out[i]
            o[0] = i in outer
            above = lines[full[k - 1]].rstrip() if k else ""
            if NUMBER_LINE.match(s):
                o[1] = 3 if above.endswith(":") and i == full[k - 1] + 1 else 2
            o[2] = 0 if s[-1] in ".;:?!" else 2 if s[-1] in MARKS + "," else 1
            below = lines[i + 1] if i + 1 < b else ""
            if not below.strip():
                o[3] = 2 if o[2] == 0 else 0 if len(lines[i].rstrip()) >= 0.75 * width else 1
            else:
                o[3] = 1 if len(lines[i].rstrip()) + 1 + len(below.split()[0]) <= width - 1 or below.startswith("  ") else 0
            words = [w for w in re.findall(r"[^\W\d_]+", s) if len(w) > 3]
            caps = sum(w[0].isupper() for w in words)
            o[4] = 0 if s[0].islower() else 1 if words and caps >= 0.6 * len(words) else 2
            if i in edge and o[2]:
                here = strip[i]
                again = any(page_of[j] != p and _alike(here, strip[j]) for j in edge if j != i) and len(here) > 2
                o[5] = 2 if again else 1 if i in known else 0
        for i in range(a, b):
            if not lines[i].strip():
                out[i][1] = 1
    return out


def start_parameters() -> dict[str, np.ndarray]:
    """What the model believes before it has seen a line."""
    e = [
        # header, page number, body, break
        np.array([[0.03, 0.97], [0.03, 0.97], [0.8, 0.2], [0.97, 0.03]]),
        np.array([[0.98, 1e-9, 1e-9, 0.02], [1e-9, 1e-9, 0.99, 0.01], [0.97, 0.001, 0.002, 0.027], [0.001, 0.997, 0.001, 0.001]]),
        np.array([[0.05, 0.9, 0.05], [0.2, 0.7, 0.1], [0.4, 0.45, 0.15], [0.97, 0.02, 0.01]]),
        np.array([[0.08, 0.62, 0.3], [0.02, 0.68, 0.3], [0.77, 0.05, 0.18], [0.97, 0.02, 0.01]]),
        np.array([[0.04, 0.76, 0.2], [0.34, 0.33, 0.33], [0.5, 0.08, 0.42], [0.97, 0.02, 0.01]]),
        np.array([[0.12, 0.38, 0.5], [0.9, 0.05, 0.05], [0.93, 0.05, 0.02], [0.97, 0.02, 0.01]]),
    ]
    trans = np.array([[0.02, 0.08, 0.8, 0.1], [0.1, 0.02, 0.83, 0.05], [0.02, 0.02, 0.81, 0.15], [0.02, 0.02, 0.93, 0.03]])
    return {"start": np.array([0.25, 0.15, 0.58, 0.02]), "trans": trans, **{f"e{i}": m for i, m in enumerate(e)}}


def _emissions(obs: np.ndarray, par: dict[str, np.ndarray]) -> np.ndarray:
    ll = np.zeros((len(obs), 4))
    for i in range(len(SIZES)):
        ll += np.log(par[f"e{i}"][:, obs[:, i]].T + 1e-12)
    return ll


def viterbi(obs: np.ndarray, par: dict[str, np.ndarray]) -> np.ndarray:
    ll, lt = _emissions(obs, par), np.log(par["trans"] + 1e-12)
    best, back = np.log(par["start"] + 1e-12) + ll[0], np.zeros(ll.shape, np.int8)
    for t in range(1, len(ll)):
        m = best[:, None] + lt
        back[t] = m.argmax(axis=0)
        best = m.max(axis=0) + ll[t]
    path = np.zeros(len(ll), np.int8)
    path[-1] = best.argmax()
    for t in range(len(ll) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def expected(obs: np.ndarray, par: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Expected counts of one record, by the forward-backward algorithm with scaling."""
    b = np.exp(_emissions(obs, par) - _emissions(obs, par).max(axis=1, keepdims=True))
    n, trans = len(b), par["trans"]
    alpha, beta, scale = np.zeros((n, 4)), np.ones((n, 4)), np.zeros(n)
    for t in range(n):
        a = par["start"] * b[0] if t == 0 else (alpha[t - 1] @ trans) * b[t]
        scale[t] = a.sum() or 1e-300
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = trans @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)
    out = {"start": gamma[0], "trans": np.zeros((4, 4))}
    if n > 1:
        xi = alpha[:-1, :, None] * trans[None] * (b[1:] * beta[1:])[:, None, :]
        out["trans"] = (xi / np.maximum(xi.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
    for i, size in enumerate(SIZES):
        out[f"e{i}"] = np.stack([gamma[obs[:, i] == v].sum(axis=0) for v in range(size)], axis=1)
    return out


def fit(observed: DataFrame, rounds: int = ROUNDS, weight: float = 0.5) -> dict[str, np.ndarray]:
    """Parameters fitted on the lines of all records. The starting values keep the share ``weight``, whatever the size.

    ``observed``: obs (array of codes). Each round sends one row of counts a batch, summed before it reaches the driver.
    """
    par, first = start_parameters(), start_parameters()
    names = list(par)
    sizes = [par[k].size for k in names]
    for _ in range(rounds):
        now = par

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(sizes))
            for batch in batches:
                for codes in batch.column(0).to_pylist():
                    if codes:
                        c = expected(decode(np.array(codes)), now)
                        total += np.concatenate([c[k].ravel() for k in names])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["i", "x"])

        sums = observed.select("obs").mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(sum(sizes))
        for r in sums:
            flat[r["i"]] = r["x"]
        par, at = {}, 0
        for k, size in zip(names, sizes):
            m = flat[at : at + size].reshape(first[k].shape) + 1e-6 * first[k]
            par[k] = weight * first[k] + (1 - weight) * m / m.sum(axis=-1, keepdims=True)
            at += size
    return par


def encode(obs: np.ndarray) -> list[int]:
    code = np.zeros(len(obs), np.int64)
    for i, size in enumerate(SIZES):
        code = code * size + obs[:, i]
    return code.tolist()


def decode(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), len(SIZES)), np.int8)
    for i in range(len(SIZES) - 1, -1, -1):
        out[:, i] = codes % SIZES[i]
        codes = codes // SIZES[i]
    return out


# ---------------------------------------------------------------- words

_EDGE_LEFT, _EDGE_RIGHT = "\"'“”„«([{¿¡‘’*-–—", "\"'“”»)]}.,;:?!‘’*-–—­‐‑¬"


def word_of(token: str) -> str:
    """The lower-case word of a token without the punctuation around it; '' if it can't be a word."""
    w = token.lstrip(_EDGE_LEFT).rstrip(_EDGE_RIGHT)
    if "(" not in w:
        w = w.rstrip(")")
    letters = sum(c.isalpha() for c in w)
    if letters < 2 and not re.fullmatch(r"[0-9!|($][^\W\d_]|[^\W\d_][0-9!|($]", w) or letters < 0.6 * len(w) and len(w) > 2 or "@" in w or "/" in w or re.search(r"\d\d", w) or len(w) > MOST_LETTERS:
        return ""
    return w.lower()


def candidates(word: str) -> set[str]:
    """Words that ``word`` may be a misreading of: one confusion undone, an accent taken off or the same confusion undone throughout."""
    out = set()
    for wrong, right in CONFUSED:
        at = word.find(wrong)
        if at >= 0:
            out.add(word.replace(wrong, right))
        while at >= 0:
            out.add(word[:at] + right + word[at + len(wrong) :])
            at = word.find(wrong, at + 1)
    for i, c in enumerate(word):
        if ord(c) > 127:
            plain = unicodedata.normalize("NFD", c)[0]
            if plain != c:
                out.add(word[:i] + plain + word[i + 1 :])
    out.discard(word)
    return {w for w in out if w.replace("-", "").replace("'", "").replace("’", "").isalpha()}


def cuts(lines: list[str], state: np.ndarray) -> list[tuple[int, int, str, str, int]]:
    """(line, next body line, joined word, hyphenated word, length of the first part) of body lines that end within a word."""
    out = []
    body = [i for i in range(len(lines)) if state[i] == BODY and lines[i].strip()]
    for i, j in zip(body, body[1:]):
        a, b = lines[i].rstrip(), lines[j].split()
        if len(a) > 1 and a[-1] in MARKS and a[-2].isalpha() and b and b[0][0].isalpha():
            head = re.search(r"[^\s(\[\"“'¿¡]*$", a[:-1])[0].lower()
            tail = re.match(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", b[0])[0]
            out.append((i, j, head + tail.lower(), head + "-" + tail.lower() if tail[0].islower() else head + "-" + tail, len(head)))
    return out


def scanned(parsed_records: DataFrame, documents: DataFrame) -> DataFrame:
    """record_id, text, page_spans of the records of scanned files. Null texts are left out."""
    d = documents.where(F.col("sniffed_type").isin("pdf_scanned", "png")).select(F.col("doc_id").alias("document_id"))
    return parsed_records.where("text is not null and record_id is not null").join(d, "document_id", "left_semi").select("record_id", "document_id", "text", "page_spans")


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, seen: counts of the lower-case words in the texts of all documents that were not scanned."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:[-'’]\p{L}+)*"), F.lit(0))
    return documents.where(~F.coalesce(F.col("sniffed_type").isin("pdf_scanned", "png"), F.lit(False)) & F.col("text").isNotNull()).select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("seen"))


def labelled(records: DataFrame) -> DataFrame:
    """record_id, text, state (one number a line) by the fitted model."""

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, d, t, sp in zip(*(b.column(k).to_pylist() for k in range(4))):
                e = dict(edges(t, sp))
                rows += [(r, d, i, mask(x), i in e) for i, x in enumerate(split_lines(t)) if x.strip()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()))], ["record_id", "document_id", "line", "mask", "edge"])

    line = materialize(records.select("record_id", "document_id", "text", "page_spans").mapInArrow(masks, "record_id bigint, document_id bigint, line int, mask string, edge boolean"))
    per = line.groupBy("mask", "document_id").agg(F.max("edge").alias("edge"), F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("e"))
    often = per.groupBy("mask").agg(F.count_if("edge").alias("docs"), F.sum("n").alias("n"), F.sum("e").alias("e")).where((F.col("docs") >= KNOWN_EDGE) & (F.col("e") >= ONLY_EDGE * F.col("n"))).select("mask")
    known = salted_join(line.where("edge"), often, ["mask"], "left_semi").groupBy("record_id").agg(F.collect_set("line").alias("known"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, t, s, k = (b.column(i).to_pylist() for i in range(4))
            obs = [encode(observe(x, y, set(z or ()))) for x, y, z in zip(t, s, k)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(obs, pa.list_(pa.int32()))], ["record_id", "text", "obs"])

    seen = materialize(records.join(known, "record_id", "left").select("record_id", "text", "page_spans", "known").mapInArrow(look, "record_id bigint, text string, obs array<int>"))
    par = fit(seen)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state = [viterbi(decode(np.array(o)), par).tolist() if o else [] for o in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(state, pa.list_(pa.int8()))], ["record_id", "text", "state"])

    return seen.mapInArrow(label, "record_id bigint, text string, state array<tinyint>")


def _tokens(lines: DataFrame) -> DataFrame:
    """record_id, line_no, word, next_no, head of every different word in a body line. A word cut at a line end is whole, on the line it begins, with the line it goes on in and the length of its first part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, t, s in zip(*(b.column(k).to_pylist() for k in range(3))):
                ls = split_lines(t)
                begun = {i: (j, joined, n) for i, j, joined, _, n in cuts(ls, np.array(s))}
                goes_on = {j for j, _, _ in begun.values()}
                for i, line in enumerate(ls):
                    if s[i] == BODY:
                        words = line.split()[1 if i in goes_on else 0 :]
                        if i in begun:
                            j, joined, n = begun[i]
                            words = words[:-1]
                            rows.append((r, i + 1, joined, j + 1, n))
                        rows += [(r, i + 1, w, None, None) for w in sorted({word_of(x) for x in words}) if w]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["record_id", "line_no", "word", "next_no", "head"])

    return lines.select("record_id", "text", "state").mapInArrow(run, "record_id bigint, line_no int, word string, next_no int, head int")


def _cut_rows(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, t, s in zip(*(b.column(k).to_pylist() for k in range(3))):
                ls = split_lines(t)
                rows += [(r, i + 1, j + 1, x, y.lower(), bool(y != y.lower()), ls[i].rstrip()[-1] != "-") for i, j, x, y, _ in cuts(ls, np.array(s))]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["record_id", "line_no", "next_no", "joined", "compound", "capital", "soft"])

    return lines.select("record_id", "text", "state").mapInArrow(run, "record_id bigint, line_no int, next_no int, joined string, compound string, capital boolean, soft boolean")


def corrections(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, right: misread words and the most frequent known word each may stand for (ties: the first by code point)."""
    words = tokens.select("word").distinct().join(vocab, "word", "left").select("word", F.coalesce("seen", F.lit(0)).alias("seen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, c) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in candidates(w)]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()))], ["wrong", "n", "word"])

    tried = words.mapInArrow(run, "wrong string, n bigint, word string").join(vocab, "word").where((F.col("seen") >= MIN_SEEN) & (F.col("seen") >= TIMES * F.col("n")))
    best = F.min_by("word", F.struct(-F.col("seen"), "word")).alias("right")
    return tried.groupBy(F.col("wrong").alias("word")).agg(best)


def _damage(records: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = materialize(labelled(records))
    vocab = materialize(vocabulary(documents))
    tokens = materialize(_tokens(lines))
    wrong = salted_join(tokens, materialize(corrections(tokens, vocab)), ["word"])
    c = _cut_rows(lines)
    c = c.join(vocab.select(F.col("word").alias("joined"), F.col("seen").alias("j")), "joined", "left")
    c = c.join(vocab.select(F.col("word").alias("compound"), F.col("seen").alias("k")), "compound", "left").fillna(0, ["j", "k"])
    whole = (F.col("j") > F.col("k")) | ((F.col("j") == F.col("k")) & ~F.col("capital")) | (F.col("soft") & (F.col("k") == 0))
    return lines, wrong, c.withColumn("whole", whole)


def damaged(parsed_records: DataFrame, documents: DataFrame) -> DataFrame:
    """record_id, line_no, kind of damaged lines: header, page_number, hyphen, misread. An empty text has one empty line and no damage."""
    lines, wrong, c = _damage(scanned(parsed_records, documents), documents)
    flat = lines.select("record_id", F.posexplode("state").alias("i", "s")).where(F.col("s").isin(HEADER, PAGE)).select("record_id", (F.col("i") + 1).alias("line_no"), F.when(F.col("s") == HEADER, "header").otherwise("page_number").alias("kind"))
    hyphen = c.where("whole").select("record_id", "line_no", F.lit("hyphen").alias("kind"))
    # of a cut word the part that differs from the right word is on the first or on the next line
    later = F.col("head").isNotNull() & (F.substring("word", F.lit(1), F.col("head")) == F.substring("right", F.lit(1), F.col("head")))
    misread = wrong.select("record_id", F.when(later, F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("kind"))
    return flat.unionByName(hyphen).unionByName(misread).distinct()


def repaired(parsed_records: DataFrame, documents: DataFrame) -> DataFrame:
    """record_id, text: paragraphs of running text, one a line, without headers and page numbers, cut words joined, misread words set right."""
    lines, wrong, c = _damage(scanned(parsed_records, documents), documents)
    fixes = wrong.groupBy("record_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("fix"))
    joins = c.where("whole").groupBy("record_id").agg(F.collect_set("line_no").alias("joins"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s, fix, cut in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                out.append(paragraphs(t, s, dict(fix or ()), set(cut or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["record_id", "text"])

    return lines.join(fixes, "record_id", "left").join(joins, "record_id", "left").select("record_id", "text", "state", "fix", "joins").mapInArrow(run, "record_id bigint, text string")


def _like(model: str, word: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word[:1].upper() + word[1:] if model[:1].isupper() else word


def paragraphs(text: str, state: list[int], fix: dict[str, str], cut: set[int]) -> str:
    """Body lines reassembled: a blank line or an indented line begins a paragraph."""
    done: list[str] = []
    now = ""
    glue = True
    for i, line in enumerate(split_lines(text)):
        if state[i] == BREAK or not line.strip():
            if now and not cut & {i}:
                done.append(now)
                now = ""
            continue
        if state[i] != BODY:
            continue
        if line.startswith("  ") and now and glue:
            done.append(now)
            now = ""
        body = " ".join(line.split())
        if i + 1 in cut:
            body = body[:-1]
        now = now + ("" if not now or not glue else " ") + body
        glue = i + 1 not in cut
    if now:
        done.append(now)
    if fix:
        done = [" ".join(_fixed(tok, fix) for tok in p.split(" ")) for p in done]
    return "\n".join(done)


def _fixed(token: str, fix: dict[str, str]) -> str:
    w = word_of(token)
    if w and w in fix:
        at = token.lower().find(w)
        if at >= 0:
            return token[:at] + _like(token[at : at + len(w)], fix[w]) + token[at + len(w) :]
    return token
