"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores and offending offsets."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.llm.common import SLICE_ROWS, as_texts, map_slices, tidy

#: Documents of each label that the field and the calibration are fitted on at most; those of least hash.
MOST_TOXIC, MOST_CLEAN = 2000, 3000
#: A score from which a document is predicted toxic.
THRESHOLD = 0.7
#: A word of a toxic document is labelled toxic if a stem of it occurs in LEAST_DOCS toxic documents, and in so many that all being
#: toxic has a probability of CHANCE at most, and in at most a share CLEAN_SHARE as many clean ones, for equal numbers of both. Copies count once.
LEAST_DOCS, CHANCE, CLEAN_SHARE = 3, 1e-4, 0.05
STEMS = (3, 4, 5, 6, 7)
#: Chains without a toxic word that the field is fitted on for one that has any; and words of a chain at most.
CLEAN_FOR_TOXIC, CHAIN = 3, 128
#: Chains with toxic words that the field is fitted on at most.
MOST_CHAINS = 6000
BUCKETS = 1 << 18
EPOCHS, RATE, DECAY = 30, 1.0, 0.01
#: Words whose weight a worker keeps.
KEPT_WORDS = 300_000

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word: itself, its last letters, its length, and its first letters (in bytes)."""
    data, crc = word.encode("utf-8", "surrogatepass"), zlib.crc32
    found = [crc(data), crc(data[-3:], 1), len(data) if len(data) < 12 else 12]
    found += [crc(data[:k], 2) for k in STEMS if len(data) >= k]
    return [x % BUCKETS for x in found]


class Emissions(dict):
    """Scores of words for the toxic tag, filled as words come; NaN for what ends a sentence."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, token: str) -> float:
        w = self.weights
        score = float("nan") if token[0] in ".!?\n" else sum([w[i] for i in features(token)])
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[token] = score
        return score


def chain_starts(inside: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which tokens begin a chain. inside: which are words. sizes: tokens of each text. A chain ends with its sentence, its text, or after CHAIN words."""
    n = len(inside)
    breaks = np.zeros(n, bool)
    ends = np.cumsum(sizes)
    breaks[ends[ends < n]] = True
    if n:
        breaks[0] = True
    breaks[1:] |= ~inside[:-1]
    first = np.maximum.accumulate(np.where(breaks, np.arange(n), 0))
    return inside & ((np.arange(n) - first) % CHAIN == 0)


def marginals(emissions: np.ndarray, starts: np.ndarray, trans: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """By forward-backward over many chains at once: P(toxic) of each word; and, to learn, expected transitions, summed.

    emissions: score of the toxic tag of each word, that of the clean tag being 0. trans: 3 x 2, rows from clean, from toxic, from the start.
    """
    n = len(emissions)
    expected = np.zeros((3, 2))
    out = np.empty(n)
    if not n:
        return out, expected
    lengths = np.diff(np.append(starts, n))
    gain = np.exp(np.clip(emissions, -30, 30))
    m = np.exp(trans - trans.max())
    # Chains of like length go together, so that little is padded.
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(np.ceil(np.log2(lengths[order])), prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        for at in range(a, b, 8192):
            some = order[at : min(b, at + 8192)]
            size, first = lengths[some], starts[some]
            steps = int(size.max())
            where = (first + np.arange(steps)[:, None]).clip(max=n - 1)
            g = gain[where]
            # Forward and backward odds of toxic against clean; the last words of a chain have no effect after them.
            fwd = np.empty((steps, len(some)))
            fwd[0] = m[2, 1] / m[2, 0] * g[0]
            for t in range(1, steps):
                r = fwd[t - 1]
                fwd[t] = (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0]) * g[t]
            back = np.empty((steps, len(some)))
            back[-1] = 1.0
            last = size - 1
            for t in range(steps - 2, -1, -1):
                r = g[t + 1] * back[t + 1]
                back[t] = np.where(t < last, (m[1, 0] + m[1, 1] * r) / (m[0, 0] + m[0, 1] * r), 1.0)
            odds = fwd * back
            p = odds / (1 + odds)
            inside = np.arange(steps)[:, None] < size
            out[where[inside]] = p[inside]
            if learn:
                expected[2] += [(1 - p[0]).sum(), p[0].sum()]
                if steps > 1:
                    on, r, s = inside[1:], fwd[:-1], g[1:] * back[1:]
                    each = np.stack([np.broadcast_to(m[0, 0], r.shape), m[0, 1] * s, r * m[1, 0], r * m[1, 1] * s])
                    each = each / each.sum(axis=0) * on
                    expected[:2] += each.sum(axis=(1, 2)).reshape(2, 2)
    return out, expected


@dataclass
class Field:
    """The fitted field and the calibration of document scores."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((3, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0, 0.0]))

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.weights, self.trans, self.calibration

    def emissions(self) -> Emissions:
        return Emissions(self.weights)

    def tags(self, texts: list[str], known: Emissions) -> list[tuple[np.ndarray, np.ndarray]]:
        """P(toxic) of the words of each text, and where they lie among its tokens."""
        tokens = [_TOKEN.findall(x.lower()) for x in texts]
        sizes = np.array([len(x) for x in tokens], np.int64)
        scores = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.float64, int(sizes.sum()))
        inside = ~np.isnan(scores)
        begins = chain_starts(inside, sizes)
        words = np.flatnonzero(inside)
        p = marginals(scores[words], np.searchsorted(words, np.flatnonzero(begins)), self.trans)[0]
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(words, np.concatenate(([0], ends)))
        return [(p[a:b], words[a:b] - (end - size)) for a, b, end, size in zip(cuts[:-1], cuts[1:], ends, sizes, strict=True)]

    def score(self, p: np.ndarray) -> float:
        """A document's score from the marginals of its words, by the calibration."""
        return float(1 / (1 + np.exp(-np.clip(self.calibration @ evidence(p), -30, 30))))


def evidence(p: np.ndarray) -> np.ndarray:
    """What the calibration sees of a document: a bias, its largest marginal, the log of their sum, and that for its length."""
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    return np.array([1.0, p.max(), np.log1p(p.sum()), np.log1p(100 * p.mean())])


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _words(tokens: list[str]) -> list[str]:
    return [w for w in tokens if w[0] not in ".!?\n"]


def _stems(word: str) -> list[int]:
    """A word and its beginnings, as numbers."""
    return [zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in [word, *(word[:k] for k in STEMS if len(word) > k)] if len(s) >= STEMS[0]]


def _document_stems(text: str) -> np.ndarray:
    return np.array(sorted({s for w in set(_words(_tokens(text))) for s in _stems(w)}), np.int64)


def _copies(texts: list[str]) -> list[int]:
    """A number for each text, the same for texts that share one of their least hashes of three words: copies, and near ones mostly."""
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[int, int] = {}
    for i, text in enumerate(texts):
        words = _words(_tokens(text))
        runs = {zlib.crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 2))}
        for h in sorted(runs)[:4]:
            root[find(i)] = find(first.setdefault(h, i))
    return [find(i) for i in range(len(texts))]


def toxic_stems(texts: list[str], labels: list[int]) -> set[int]:
    """Stems that toxic documents have and clean ones don't, more often than chance explains. Words are held for one document at a time."""
    firsts: dict[tuple[int, int], int] = {}
    for i, key in enumerate(zip(_copies(texts), labels, strict=True)):
        firsts.setdefault(key, i)
    kept = sorted(firsts.values())
    toxic = [i for i in kept if labels[i]]
    ratio = len(toxic) / max(1, len(kept) - len(toxic))
    least = max(LEAST_DOCS, math.ceil(math.log(CHANCE) / math.log(len(toxic) / len(kept)))) if 0 < len(toxic) < len(kept) else LEAST_DOCS
    found, n = np.unique(np.concatenate([np.empty(0, np.int64), *(_document_stems(texts[i]) for i in toxic)]), return_counts=True)
    found, n = found[n >= least], n[n >= least]
    clean = np.zeros(len(found), np.int64)
    for i in kept:
        if not labels[i]:
            clean += np.isin(found, _document_stems(texts[i]), assume_unique=True)
    return set(found[clean * ratio <= CLEAN_SHARE * n].tolist())


def fit(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> Field:
    """A field from documents and their labels. weights: of a clean and a toxic document in the calibration."""
    model = Field()
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = (y.mean() if len(y) else 0.1) * 0.98 + 0.01
        model.calibration = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])
        return model
    stems = toxic_stems(texts, labels)
    toxic: list[list[str]] = []
    clean: list[tuple[int, int, int]] = []  # a document, and a chain's words in it
    marks: dict[str, int] = {}
    rng = np.random.default_rng(7)
    for d, (text, label) in enumerate(zip(texts, labels, strict=True)):
        own = _tokens(text)
        inside = np.array([w[0] not in ".!?\n" for w in own], bool)
        begins = np.flatnonzero(chain_starts(inside, np.array([len(own)])))
        words = np.flatnonzero(inside)
        cuts = np.append(np.searchsorted(words, begins), len(words))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if label == 0:
                clean.append((d, a, b))
                continue
            part = [own[i] for i in words[a:b]]
            for w in part:
                if w not in marks:
                    marks[w] = int(any(s in stems for s in _stems(w)))
            if any(marks[w] for w in part):
                toxic.append(part)
    toxic = [toxic[i] for i in rng.permutation(len(toxic))[:MOST_CHAINS]]
    picked: dict[int, list[tuple[int, int]]] = {}
    for i in rng.permutation(len(clean))[: max(2000, CLEAN_FOR_TOXIC * len(toxic))].tolist():
        picked.setdefault(clean[i][0], []).append(clean[i][1:])
    some = [words[a:b] for d, spans in picked.items() for words in [_words(_tokens(texts[d]))] for a, b in spans]
    each_word = [w for part in [*toxic, *some] for w in part]
    gold = [marks[w] for part in toxic for w in part] + [0] * sum(map(len, some))
    at = np.cumsum([0, *map(len, [*toxic, *some])])[:-1]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(each_word))}
    each = np.array([vocabulary[w] for w in each_word])
    spread = [features(w) for w in vocabulary]
    owner = np.repeat(np.arange(len(spread)), [len(x) for x in spread])
    bucket = np.array([i for x in spread for i in x])
    used, bucket = np.unique(bucket, return_inverse=True)
    tags = np.array(gold)
    real = np.zeros((3, 2))
    inner = np.ones(len(tags), bool)
    inner[at] = False
    np.add.at(real, (tags[np.flatnonzero(inner) - 1], tags[inner]), 1)
    np.add.at(real, (np.full(len(at), 2), tags[at]), 1)
    w, trans = np.zeros(len(used)), np.zeros((3, 2))
    square_w, square_t = np.full(len(used), 1e-6), np.full((3, 2), 1e-6)
    for _ in range(EPOCHS):
        scores = np.bincount(owner, w[bucket], len(spread))[each]
        p, expected = marginals(scores, at, trans, learn=True)
        slope = np.bincount(bucket, np.bincount(each, tags - p, len(spread))[owner], len(used)) - DECAY * w
        turn = real - expected - DECAY * trans
        square_w += slope**2
        square_t += turn**2
        w += RATE * slope / np.sqrt(square_w)
        trans += RATE * turn / np.sqrt(square_t)
    model.weights[used] = w
    model.trans = trans
    # Logistic regression of the label on what the marginals gather, by Newton's method.
    known = model.emissions()
    x = np.array([evidence(p) for i in range(0, len(texts), 64) for p, _ in model.tags(texts[i : i + 64], known)])
    r = np.where(y == 1, weights[1], weights[0])
    beta = np.zeros(4)
    keep = np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (r * q * (1 - q))[:, None]) + keep, x.T @ (r * (y - q)) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    model.calibration = beta
    return model


def held_out(id_col: Column) -> Column:
    """Whether a document is left out of learning: a third of them, by crc32 of the id as text."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field fitted on labelled documents that aren't held out.

    The sample is bounded: the MOST_TOXIC and MOST_CLEAN labelled documents of least hash; the calibration weighs them by how many
    of each label there are. Null ids and labels are left out; a null text counts as empty.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    picked = [own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    # At most MOST_TOXIC + MOST_CLEAN ids, so the broadcast is bounded.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id")
    rows = sorted((r["doc_id"], r["text"] or "", r["toxic"]) for r in rows.collect())
    sampled = Counter(r[2] for r in rows)
    weights = tuple(counts.get(y, 0) / sampled[y] if sampled[y] else 1.0 for y in (0, 1))
    return fit([r[1] for r in rows], [r[2] for r in rows], weights)


def toxicity_scores(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs, from its whole text; with spans also the offending offsets.

    score: 0 to 1, higher where label 1 is likelier; predicted: 1 if it is THRESHOLD or more. spans: array of (start, end) in code points
    of the text, of words that are toxic with a probability of 0.5 or more. A null text counts as empty, which has the score of no evidence;
    repeated rows each come back, rows with a null id too. Other columns aren't read; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())  # BUCKETS weights and little more, however many documents
    columns = [("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())]
    schema = "doc_id long, score double, predicted int"
    if spans:
        columns.append(("spans", pa.list_(pa.list_(pa.int64()))))
        schema += ", spans array<array<long>>"

    worker: list = []

    def of(batch: pa.RecordBatch) -> dict[str, list]:
        texts = as_texts(batch.column(1))
        if not worker:
            worker.extend([own := Field(*sent.value), own.emissions()])
        own, known = worker
        tags = own.tags(texts, known)
        scores = [own.score(p) for p, _ in tags]
        out = {"doc_id": batch.column(0), "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}
        if spans:
            out["spans"] = [_offsets(x, p, places) for x, (p, places) in zip(texts, tags, strict=True)]
        return out

    return map_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), schema, of, columns)


def _offsets(text: str, p: np.ndarray, places: np.ndarray) -> list[list[int]]:
    toxic = {int(x) for x in places[p >= 0.5]}
    if not toxic:
        return []
    # Lower-casing can lengthen a text; its letters are found again one by one.
    lower = text.lower()
    back: Callable[[int], int] = lambda i: i
    if len(lower) != len(text):
        index = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        back = lambda i: int(index[i]) if i < len(index) else len(text)
    return [[back(m.start()), back(m.end() - 1) + 1] for i, m in enumerate(_TOKEN.finditer(lower)) if i in toxic]


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns; rows with a null text or id are scored as others.

    The scoring is a filter over the rows in place: nothing is shuffled.
    """
    model = trained(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())
    columns = docs.columns
    at = columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        known = own.emissions()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                tags = own.tags(as_texts(part.column(at)), known)
                yield part.filter(pa.array([own.score(p) < THRESHOLD for p, _ in tags], pa.bool_()))
        known.clear()
        tidy()

    return docs.mapInArrow(keep, docs.schema)
