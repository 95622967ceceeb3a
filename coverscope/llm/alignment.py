"""Cross-tokenizer alignment: byte-owner arrays of two tokenizations give overlaps and cuts; id pairs are counted over all documents."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.llm.common import SLICE_ROWS, as_texts
from coverscope.runtime import settle

#: Chunks whose alignment a worker keeps, bytes of texts that it takes at once, and id pairs that it counts before it passes them on.
KEPT_CHUNKS, TAKEN_BYTES, COUNTED_PAIRS = 400_000, 4_000_000, 2_000_000
#: Counts of id pairs that are sent to all workers at most: those of the most common pairs. The others are joined.
SENT_PAIRS = 1 << 22
#: A group with more links than this is taken by its distinct ids.
WIDE_GROUP = 4096

_MARK = "▁"
#: Where a space stands between two signs that are no white space. Neither tokenizer has a token across such a place.
_CHUNKS = re.compile(r"(?<=\S)(?= \S)")
_EMPTY = np.empty(0, np.int64)


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(others)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library, from its JSON."""

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        form, alphabet = json.loads(spec), byte_alphabet()
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(tokens.values(), default=-1) + 1)
        for token, i in tokens.items():
            self.bytes[i] = bytes(alphabet[x] for x in token) if all(x in alphabet for x in token) else token.encode()
        words = form["pre_tokenizer"] or {}
        self.chunks = form["normalizer"] is None and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and all(x["special"] for x in form["added_tokens"])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A model of the sentencepiece library, which puts a space before a text."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.chunks = not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([x[1:] for x in texts], num_threads=1)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after another, and how many each list has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for own in lists for x in own), np.int64, int(sizes.sum())), sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... , sizes[i] of them, for each i one after another."""
    total = int(sizes.sum())
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total) if total else _EMPTY


class Aligned:
    """The alignment of tokens A and B of the same bytes, all texts one after another.

    owner_a and owner_b have the token of each byte. Where both change is a cut, and between cuts is a group; where either changes begins an
    overlap of one token of A with one of B. A group links all its A tokens with all its B tokens: where one side has a single token these are its overlaps.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> None:
        owner_a, owner_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
        new_a, new_b = np.ones(len(owner_a), bool), np.ones(len(owner_b), bool)
        new_a[1:] = owner_a[1:] != owner_a[:-1]
        new_b[1:] = owner_b[1:] != owner_b[:-1]
        of_byte = np.cumsum(new_a & new_b) - 1
        self.cuts = np.flatnonzero(new_a & new_b)
        both = np.flatnonzero(new_a | new_b)
        self.over_a, self.over_b, over_group = owner_a[both], owner_b[both], of_byte[both]
        self.group_a, self.group_b = of_byte[new_a], of_byte[new_b]
        self.n_a, self.n_b = np.bincount(self.group_a, minlength=len(self.cuts)), np.bincount(self.group_b, minlength=len(self.cuts))
        self.first_a, self.first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        self.plain = np.minimum(self.n_a, self.n_b) == 1
        self.over_plain = self.plain[over_group]
        self.over_group = over_group
        self.a, self.b = a, b

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id of A * width + id of B, links) by group; a pair may come several times."""
        keep = self.over_plain
        groups, keys = [self.over_group[keep]], [self.a[self.over_a[keep]] * width + self.b[self.over_b[keep]]]
        times = [np.ones(len(keys[0]), np.int64)]
        product = self.n_a * self.n_b
        some = np.flatnonzero(~self.plain & (product <= WIDE_GROUP))
        left = spread(self.first_a[some], self.n_a[some])
        group = self.group_a[left]
        right = spread(self.first_b[group], self.n_b[group])
        left = np.repeat(left, self.n_b[group])
        groups.append(self.group_a[left])
        keys.append(self.a[left] * width + self.b[right])
        times.append(np.ones(len(left), np.int64))
        for g in np.flatnonzero(~self.plain & (product > WIDE_GROUP)).tolist():
            a, n = np.unique(self.a[self.first_a[g] : self.first_a[g] + self.n_a[g]], return_counts=True)
            b, m = np.unique(self.b[self.first_b[g] : self.first_b[g] + self.n_b[g]], return_counts=True)
            keys.append((a[:, None] * width + b).ravel())
            times.append((n[:, None] * m).ravel())
            groups.append(np.full(len(keys[-1]), g))
        out = [np.concatenate(x) for x in (groups, keys, times)]
        order = np.argsort(out[0], kind="stable")
        return out[0][order], out[1][order], out[2][order]


class Store:
    """An array that grows."""

    def __init__(self) -> None:
        self.room, self.n = np.empty(1 << 16, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate((self.room[: self.n], np.empty(max(len(self.room), len(values)), np.int64)))
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class Aligner:
    """Aligns texts by their chunks, and keeps the alignment of a bounded number of these."""

    def __init__(self, spec: str, model: bytes) -> None:
        self.a, self.b = ByteLevel(spec), Pieces(model)
        self.size_a, self.size_b = (np.fromiter(map(len, x.bytes), np.int64, len(x.bytes)) for x in (self.a, self.b))
        self.width = len(self.b.bytes)
        wide = len(self.a.bytes)
        # How a token is written within its group and at the end of its side of it.
        self.written = [f"{i}{end}" for n, ends in ((wide, ",|"), (self.width, ",;")) for end in ends for i in range(n)]
        self.at = (0, wide, 2 * wide, 2 * wide + self.width)
        self.split = _CHUNKS.split if self.a.chunks and self.b.chunks else lambda x: [x]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.written_of: list[str] = []
        #: Of each chunk: whether both tokenizations give its bytes, tokens, groups, links, and where its pairs begin.
        self.ok, self.n_a, self.n_b, self.n_groups, self.n_links, self.first, self.pairs, self.keys, self.times = (Store() for _ in range(9))

    def learn(self, chunks: list[str]) -> None:
        """The alignment of new chunks, all by one pair of owner arrays."""
        ids_a, ids_b = self.a.encode(chunks), self.b.encode(chunks)
        bytes_a, bytes_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        ok = [b"".join(map(bytes_a, a)) == (data := x.encode()) and b"".join(map(bytes_b, b)) == data for x, a, b in zip(chunks, ids_a, ids_b, strict=True)]
        for i, fits in enumerate(ok):
            if not fits:
                ids_a[i], ids_b[i] = [], []
        (a, n_a), (b, n_b) = flat(ids_a), flat(ids_b)
        got = Aligned(a, b, self.size_a[a], self.size_b[b])
        chunk_of = np.repeat(np.arange(len(chunks)), n_a)[got.first_a]
        n_groups = np.bincount(chunk_of, minlength=len(chunks))
        group, keys, times = got.links(self.width)
        own = np.bincount(chunk_of[group], minlength=len(chunks))
        self.first.add(self.keys.n + np.cumsum(own) - own)
        for store, values in ((self.ok, np.array(ok, np.int64)), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.pairs, own), (self.keys, keys), (self.times, times)):
            store.add(values)
        self.n_links.add(np.bincount(chunk_of, weights=got.n_a * got.n_b, minlength=len(chunks)).astype(np.int64))
        self.written_of += self.write(got, n_groups)

    def write(self, got: Aligned, n_groups: np.ndarray) -> list[str]:
        """The groups of each chunk as a1,a2|b1;a3|b2,b3."""
        last_a, last_b = np.zeros(len(got.a), bool), np.zeros(len(got.b), bool)
        last_a[got.first_a + got.n_a - 1], last_b[got.first_b + got.n_b - 1] = True, True
        codes = np.empty(len(got.a) + len(got.b), np.int64)
        codes[np.arange(len(got.a)) + got.first_b[got.group_a]] = got.a + np.where(last_a, self.at[1], self.at[0])
        codes[np.arange(len(got.b)) + (got.first_a + got.n_a)[got.group_b]] = got.b + np.where(last_b, self.at[3], self.at[2])
        pieces = list(map(self.written.__getitem__, codes.tolist()))
        ends = np.concatenate(([0], np.cumsum(got.n_a + got.n_b)))[np.concatenate(([0], np.cumsum(n_groups)))].tolist()
        return ["".join(pieces[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def align(self, texts: list[str]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """((n_a, n_b, n_groups, n_links), written groups, distinct pairs ascending, links of each) of each text; nothing where it has no tokens."""
        if len(self.written_of) > KEPT_CHUNKS:
            self.clear()
        known = len(self.written_of)
        parts = [np.fromiter(map(self.number.__getitem__, self.split(f" {x}")), np.int64) if x else _EMPTY for x in texts]
        if len(self.number) > known:
            self.learn(list(self.number)[known:])
        ok, stores, first, pairs, keys, times = self.ok.values, [x.values for x in (self.n_a, self.n_b, self.n_groups, self.n_links)], self.first.values, self.pairs.values, self.keys.values, self.times.values
        for own in parts:
            if not len(own) or not ok[own].all():
                yield (0, 0, 0, 0), "", _EMPTY, _EMPTY
                continue
            where = spread(first[own], pairs[own])
            found = keys[where]
            order = np.argsort(found)
            found = found[order]
            starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
            yield tuple(int(x[own].sum()) for x in stores), "".join(map(self.written_of.__getitem__, own.tolist()))[:-1], found[starts], np.add.reduceat(times[where][order], starts)


def packed(keys: np.ndarray, links: np.ndarray) -> bytes:
    """Ascending keys as differences and their links, byte by byte, compressed; empty for none."""
    if not len(keys):
        return b""
    return zstandard.compress(np.stack((np.diff(keys, prepend=0), links)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return _EMPTY, _EMPTY
    both = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of some TAKEN_BYTES together, at least one at a time, with their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            begin, size, some = 0, 0, []
            for text in as_texts(part.column(column)):
                some.append(text)
                size += len(text)
                if size >= TAKEN_BYTES:
                    yield part.slice(begin, len(some)), some
                    begin, size, some = begin + len(some), 0, []
            if some:
                yield part.slice(begin, len(some)), some


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of every row of docs, with groups also the groups themselves (written as a1,a2|b1;a3|b2,b3).

    pairs has the document's linked id pairs (id of A * pieces of B + id of B) and how many links each has; `unpacked` opens it.
    """
    # Both files are of a fixed size, whatever docs has; a worker builds its aligner once and keeps it, with its chunks, at the end of what it was sent.
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        sent = docs.sparkSession.sparkContext.broadcast([a.read(), b.read()])
    schema = "doc_id long, " + "".join(f"{x} long, " for x in NUMBERS) + "groups_sha256 string, pairs binary" + ", groups string" * groups
    types = [*[pa.int64()] * 4, pa.string(), pa.binary(), *[pa.string()] * groups]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _portions(batches, 1):
            if len(sent.value) == 2:
                sent.value.append(Aligner(*sent.value))
            aligner = sent.value[2]
            rows = [(*n, hashlib.sha256(written.encode()).hexdigest() if written else "", packed(*pairs), *[written] * groups) for n, written, *pairs in aligner.align(texts)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(key, n): in how many of the rows each linked pair is. Each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(some: list[np.ndarray], keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, times = np.unique(np.concatenate(some), return_counts=True)
            keys, back = np.unique(np.concatenate((keys, found)), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate((n, times)), minlength=len(keys)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)], pa.int64()) for x in (keys, n)], names=["key", "n"])

        some, size, keys, n = [], 0, _EMPTY, _EMPTY
        for batch in batches:
            for data in batch.column(0):
                some.append(unpacked(data.as_py())[0])
                size += len(some[-1])
                if size >= COUNTED_PAIRS:
                    keys, n = whole(some, keys, n)
                    some, size = [], 0
                    if len(keys) >= COUNTED_PAIRS:
                        yield from out()
                        keys, n = _EMPTY, _EMPTY
        if some:
            keys, n = whole(some, keys, n)
        yield from out()

    return rows.select("pairs").where("length(pairs) > 0").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def marked_counts(rows: DataFrame, width: int) -> DataFrame:
    """(key, n, best): the counts of all pairs, and whether a pair's is the highest of its A id."""
    counts = settle(pair_counts(rows)).withColumn("a", F.expr(f"key div {width}"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    return counts.join(F.broadcast(most), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    A tokenizes a space and the text by the file of the tokenizers library at a_path, B the text by the model of the sentencepiece library at b_path,
    which adds that space; strings of special tokens are plain text. Byte offsets where tokens of both end cut the tokens into groups, and a group links each of its A
    tokens with each of its B tokens. The count of an id pair is the number of rows of docs that have it linked. n_best counts links whose pair has the highest count of its A id
    (several may), count_sum adds up the counts of all links.

    Texts that are null or empty, or whose joined tokens aren't the space and the text (one with U+2581, say), have no tokens: zeros, and '' for groups_sha256.
    Texts are whole, however long. Repeated rows each come back and each count; a null doc_id stays; other columns aren't read; an empty table gives no rows.

    Counts of the SENT_PAIRS most common pairs at most are sent to the workers. Links of rarer pairs, none of which has many rows, are joined with their counts.
    """
    spark = docs.sparkSession
    rows = settle(alignments(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    with open(b_path, "rb") as model:
        width = len(Pieces(model.read()).bytes)
    counts = settle(marked_counts(rows, width))
    # By powers of two, from the most common on, as many as may be sent.
    sizes = {r["p"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, room = 64, SENT_PAIRS
    for p in range(63, -1, -1):
        room -= sizes.get(p, 0)
        if room < 0:
            break
        least = p
    common = counts.where(F.floor(F.log2("n")) >= least).toArrow().sort_by("key")
    sent = spark.sparkContext.broadcast([common[c].to_numpy().copy() for c in ("key", "n", "best")])
    # At the end keys that aren't sent find themselves.
    joined = any(p < least for p in sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            out, rest = [], []
            for data in batch.column("pairs"):
                own, links = unpacked(data.as_py())
                at = np.searchsorted(keys, own)
                at[at == len(keys)] = 0
                known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                out.append((int(links[known & best[at]].sum()), int((links * n[at])[known].sum())) if len(keys) else (0, 0))
                if joined:
                    rest.append([{"key": k, "links": x} for k, x in zip(own[~known].tolist(), links[~known].tolist(), strict=True)])
            columns = [*(batch.column(c) for c in ("row", "doc_id", *NUMBERS, "groups_sha256")), *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1))]
            names = ["row", "doc_id", *NUMBERS, "groups_sha256", "n_best", "count_sum"]
            if joined:
                columns.append(pa.array(rest, pa.list_(pa.struct([("key", pa.int64()), ("links", pa.int64())]))))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "row long, doc_id long, " + "".join(f"{x} long, " for x in NUMBERS) + "groups_sha256 string, n_best long, count_sum long" + ", rest array<struct<key: long, links: long>>" * joined
    found = rows.mapInArrow(run, schema)
    if joined:
        found = settle(found)
        links = found.select("row", F.inline("rest"))
        more = links.join(counts.where(F.floor(F.log2("n")) < least), "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best_"), F.sum(F.col("links") * F.col("n")).alias("sum_"))
        found = found.drop("rest").join(more, "row", "left")
        found = found.withColumn("n_best", F.col("n_best") + F.coalesce("best_", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("sum_", F.lit(0)))
    return found.select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")
