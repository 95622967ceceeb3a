"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.llm.common import partitions

SHINGLE, SEED = 5, 42
#: Bins (a power of two) and the low-order bits kept of each bin's least hash.
BINS, LOW_BITS = 512, 2
#: Bins that the densification looks at before it looks at all.
FIRST = 32
_LAST = 2**63 - 1
#: Bytes of texts that a range of documents is meant to hold.
RANGE_BYTES = 128_000_000
_BIN = (np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def bits_of(values: np.ndarray) -> np.ndarray:
    """The low-order bits that each bin keeps of its value, hashed once more with the bin.

    So two bins that hold the same two values, as an empty one has another's, are equal by chance each on its own.
    """
    x = (values ^ (values >> np.uint64(32))) * _BIN
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - LOW_BITS)).astype(np.uint8)


def _orders() -> np.ndarray:
    """For each bin an order of all bins, by a hash of the pair: where an empty bin looks for a value."""
    x = np.arange(BINS * BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(30)
    return np.argsort(x.reshape(BINS, BINS), axis=1).astype(np.int32)


class Fingerprinter:
    """Makes and compares fingerprints; builds its table of bin orders on first use."""

    def __init__(self) -> None:
        self.orders: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"orders": None}

    def hashes(self, text: str) -> np.ndarray:
        """The distinct hashes of five-word shingles of the lower-cased text; of the whole sequence where it is shorter."""
        words = text.lower().encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) <= SHINGLE:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - SHINGLE])).tolist()
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))

    def low_bits(self, text: str) -> np.ndarray | None:
        """The low-order bits of the bins; None of a text without words."""
        h = self.hashes(text)
        if not len(h):
            return None
        h = np.sort(h)
        bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.concatenate(([True], bins[1:] != bins[:-1]))  # hashes are sorted, and so a bin's first is its least
        full = np.zeros(BINS, bool)
        value = np.zeros(BINS, np.uint64)
        full[bins[first]] = True
        value[bins[first]] = h[first]
        if self.orders is None:
            self.orders = _orders()
        empty = np.flatnonzero(~full)
        for a, b in ((0, FIRST), (FIRST, BINS)):
            if not len(empty):
                break
            there = full[self.orders[empty, a:b]]
            found = there.argmax(axis=1)
            ok = there[np.arange(len(empty)), found]
            value[empty[ok]] = value[self.orders[empty[ok], a + found[ok]]]
            empty = empty[~ok]
        return bits_of(value)

    @staticmethod
    def packed(low: np.ndarray | None) -> str:
        """Hex of the packed low-order bits; the empty string for a text without words."""
        if low is None:
            return ""
        bits = np.unpackbits(low[:, None], axis=1, bitorder="little")[:, :LOW_BITS]
        return np.packbits(bits.reshape(-1)).tobytes().hex()

    @staticmethod
    def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
        """The Jaccard similarity that equal low-order bits suggest, without the share that are equal by chance."""
        if a is None or b is None:
            return 1.0 if a is b else 0.0
        chance = 0.5**LOW_BITS
        return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def starts_of(marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, hashes) where ranges begin, from percentiles of the keys; one that is m of them has m ranges, by hash."""
    keys, hashes = [], []
    for key, m in sorted(Counter(marks).items()):
        keys += [key] * m
        hashes += [(i << 64) // m - (1 << 63) for i in range(m)]
    return np.array(keys, np.int64), np.array(hashes, np.int64)


def parts_of(k: np.ndarray, h: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The range of each (key, hash): how many begin at it or before."""
    part, end = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
    inside = end > part
    for a, b in set(zip(part[inside].tolist(), end[inside].tolist(), strict=True)):
        own = inside & (part == a)
        own_hash = h[own]
        part[own] = a + np.searchsorted(hashes[a:b], own_hash, "right")
        inside &= ~own
    return part


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    The edited text of a document has its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document, in ascending doc_id; after the last comes the first. Rows with a null doc_id come last; rows with the same
    doc_id follow each other in an order that depends on their texts alone. A null text counts as empty; a text without words
    has the fingerprint "", whose likeness is 1 to another such and 0 to others. An only row is followed by itself. Other
    columns aren't read; an empty table gives no rows.

    A text is taken whole, however long it is; a task holds two at a time.

    Rows are dealt out in ranges of doc_id, and of the text's hash where many rows have one doc_id or none; the ranges' number follows the bytes of all
    texts. The row that begins a range also goes to the range before, to be the next of its last row. The driver gets one number for each range.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows of one doc_id, or of none, follow each other by hash.
    source = source.select("k", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "doc_id", "text")
    size = source.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = max(2, partitions(spark), (size["bytes"] or 0) // RANGE_BYTES)
    marks = source.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("p")).first()["p"] or []
    keys, hashes = starts_of(marks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = parts_of(batch.column(0).to_numpy(), batch.column(1).to_numpy(), keys, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), batch.column(1)], names=["part", "k", "h"])

    placed = source.select("k", "h").mapInArrow(place, "part int, k long, h long")
    first = sorted(tuple(r) for r in placed.groupBy("part").agg(F.min(F.struct("k", "h")).alias("x")).select("part", "x.k", "x.h").collect())
    #: By the key that begins a range, the range before it; before the first comes the last.
    ahead_of = {(k, h): (first[i - 1][0], 1 if i else 2) for i, (_, k, h) in enumerate(first)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            if not batch.num_rows:
                continue
            k, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part = parts_of(k, h, keys, hashes)
            texts = [pack(x or b"") for x in batch.column(3).cast(pa.binary()).to_pylist()]
            rows = [(p, 0, *x) for p, x in zip(part.tolist(), zip(k.tolist(), h.tolist(), batch.column(2).to_pylist(), texts, strict=True), strict=True)]
            rows += [(*ahead_of[a, b], a, b, None, z) for a, b, z in zip(k.tolist(), h.tolist(), texts, strict=True) if (a, b) in ahead_of]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "ahead", "k", "h", "doc_id", "z"])

    dealt = source.mapInArrow(deal, "part int, ahead int, k long, h long, doc_id long, z binary")
    ordered = dealt.repartitionById(len(keys) + 1, "part").sortWithinPartitions("part", "ahead", "k", "h").select("ahead", "doc_id", "z")
    maker = Fingerprinter()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last = None  # the row that waits for its next one
        out: list[tuple] = []
        for batch in batches:
            for ahead, key, z in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                if ahead and last is None:
                    continue
                text = unpack(z.as_py()).decode("utf-8", "surrogatepass")
                low = maker.low_bits(text)
                if last is not None:
                    own_key, own, own_low = last
                    q = len(own) // 4
                    edited = own[: len(own) - q] + text[:q]
                    edited_low = maker.low_bits(edited)
                    out.append((own_key, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), maker.packed(own_low), maker.packed(edited_low), maker.likeness(own_low, edited_low), maker.likeness(own_low, low)))
                last = None if ahead else (key, text, low)
                if len(out) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return ordered.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
