"""Byte-level BPE: merges replayed in rank order over all words at once, from an inverted index of token pairs."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.llm.common import SLICE_ROWS, as_texts, tidy

#: Words whose ids a worker keeps, and bytes of texts that it replays at once.
KEPT_WORDS, REPLAYED_BYTES = 150_000, 4_000_000


class Vocabulary:
    """Ranks of a byte-level BPE, and the replay of its merges."""

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str) -> None:
        self.ids = dict(zip(tokens, ids, strict=True))
        self.bytes = dict(zip(ids, tokens, strict=True))
        self.split = regex.compile(pattern).findall
        lefts, rights, made = [], [], []
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    made.append(rank)
        self.width = max(ids, default=0) + 2
        keys = np.array(lefts, np.int64) * self.width + np.array(rights, np.int64)
        order = np.argsort(keys)
        self.pairs, self.made = np.append(keys[order], 1 << 62), np.append(np.array(made, np.int64)[order], -1)
        self.single = np.array([self.ids.get(bytes([x]), -1) for x in range(256)], np.int64)
        if len(ids) and (self.single < 0).any():
            raise ValueError("the vocabulary lacks a byte")

    @staticmethod
    def read(path: str) -> tuple[list[bytes], list[int]]:
        """The tokens and ranks of a file of base64 tokens with their ranks, one to a line."""
        with open(path, "rb") as lines:
            pairs = [x.split() for x in lines if x.strip()]
        return [base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges to; -1 where it merges to none."""
        keys = left * self.width + right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.made[at], -1)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. A word that is a token is that token; merges make the others.

        All words are laid out one after another. From each rank that a pair merges to, an index leads to the positions
        of such pairs; ranks are taken in order (a heap holds those in use, as a merge can make a pair of a lesser rank), and of each
        word its first such pair is merged, whose neighbours alone get new ranks. What is left of the rank comes after any lesser one.
        """
        whole = [self.ids.get(w) for w in words]
        todo = [i for i, x in enumerate(whole) if x is None]
        out: list[list[int]] = [[] if x is None else [x] for x in whole]
        data = np.frombuffer(b"".join(words[i] for i in todo), np.uint8)
        n = len(data)
        if not n:
            return out
        lengths = np.fromiter((len(words[i]) for i in todo), np.int64, len(todo))
        owner = np.repeat(np.arange(len(todo)), lengths)
        token = self.single[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(lengths) - 1
        first = last - lengths + 1
        after[last[lengths > 0]], before[first[lengths > 0]] = n, -1
        inner = np.flatnonzero(after < n)
        rank = np.full(n + 1, -1, np.int64)
        rank[inner] = self.ranks(token[inner], token[after[inner]])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[rank[places] >= 0]
            if not len(places):
                return
            if len(places) > 1:
                places = places[np.argsort(rank[places], kind="stable")]
            kinds = rank[places]
            cuts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for r, a, b in zip(kinds[begins].tolist(), begins, [*begins[1:], len(places)], strict=True):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(places[a:b])

        enter(inner)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            places = places[alive[places] & (rank[places] == r)]
            if len(places) > 1:
                word = owner[places]
                lead = np.concatenate(([True], word[1:] != word[:-1]))
                if not lead.all():
                    index[r].append(places[~lead])
                    heapq.heappush(heap, r)
                    places = places[lead]
            if not len(places):
                continue
            right = after[places]
            token[places] = r
            alive[right] = False
            rank[right] = -1
            far = after[right]
            after[places] = far
            follows = far < n
            before[far[follows]] = places[follows]
            rank[places] = -1
            rank[places[follows]] = self.ranks(token[places[follows]], token[far[follows]])
            near = before[places]
            left, here = near[near >= 0], places[near >= 0]
            rank[left] = self.ranks(token[left], token[here])
            enter(np.concatenate((left, places)))
        left = np.flatnonzero(alive)
        ids = token[left].tolist()
        cuts = np.searchsorted(owner[left], np.arange(len(todo) + 1)).tolist()
        for k, i in enumerate(todo):
            out[i] = ids[cuts[k] : cuts[k + 1]]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[x] for x in ids])


class Encoder:
    """Encodes texts with a vocabulary; keeps a bounded number of words' ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids: list[list[int]] = []

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; all its words that are new are encoded together first."""
        if len(self.ids) > KEPT_WORDS:
            self.clear()
        known = len(self.ids)
        numbers = [array("I", map(self.number.__getitem__, self.vocabulary.split(x))) for x in texts]
        words = list(self.number)[known:]
        self.ids += self.vocabulary.encode_words([w.encode("utf-8", "replace") for w in words])
        ids = self.ids
        for each in numbers:
            yield [x for i in each for x in ids[i]]


def _portions(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts of about REPLAYED_BYTES together, at least one at a time."""
    some: list[str] = []
    size = 0
    for x in texts:
        some.append(x)
        size += len(x)
        if size >= REPLAYED_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def encoded(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs; with ids also the ids themselves.

    Each match of the pattern in the whole text is encoded separately, without special tokens; the ids are then decoded.
    ids_sha256 is of decimal ids joined by commas, decoded_sha256 of the decoded bytes, both in lower-case hex. A null text counts as empty, which has
    no tokens and decodes to nothing; texts are taken whole, however long. Repeated rows each come back, as do rows with a null id; other columns aren't read; an empty table
    gives no rows. vocabulary_path names a file that the driver reads; executors get its contents, whose size doesn't depend on docs.
    """
    # A worker process builds its vocabulary once, and keeps it at the end of what it was sent.
    sent = docs.sparkSession.sparkContext.broadcast([*Vocabulary.read(vocabulary_path), pattern])
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * ids]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if len(sent.value) == 3:
                sent.value.append(Vocabulary(*sent.value))
            encoder = encoder or Encoder(sent.value[3])
            keys, at = batch.column(0), 0
            # Texts become objects a portion at a time.
            slices = (batch.column(1).slice(i, SLICE_ROWS) for i in range(0, batch.num_rows, SLICE_ROWS))
            for some in _portions(x for part in slices for x in as_texts(part)):
                rows = []
                for got in encoder.encode(some):
                    decoded = hashlib.sha256(encoder.vocabulary.decode(got)).hexdigest()
                    rows.append((len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest(), decoded, *[got] * ids))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(some)), *columns], names=names)
                at += len(some)
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decoded(tokens: DataFrame, vocabulary_path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """tokens with the text that its ids stand for; ids outside the vocabulary give nothing, a null a null, bytes that are no UTF-8 U+FFFD."""
    sent = tokens.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    worker: list[dict[int, bytes]] = []

    @F.udf("string", useArrow=True)
    def text(ids):  # noqa: ANN001, ANN202
        if not worker:
            worker.append(dict(zip(sent.value[1], sent.value[0], strict=True)))
        return None if ids is None else b"".join([worker[0].get(x, b"") for x in ids]).decode("utf-8", "replace")

    return tokens.withColumn(to, text(F.col(ids_col)))
