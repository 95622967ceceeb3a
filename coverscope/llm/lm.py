"""Language-model scoring: bit predictors of hashed contexts, mixed online in the logistic domain by gated weights."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope.llm.common import partitions, tidy
from coverscope.runtime import settle

#: Predictors of hashed contexts: the last 4 bytes, the word so far, and that with the word before. For their tables the powers of two of slots at least
#: and at most, and the training bytes for which tables are of the least; slots are twice as many for 4 times as many bytes. A further predictor's
#: contexts are the last two bytes, which the code has as well; its table has a place for each.
LEAST_SLOTS, MOST_SLOTS, LEAST_BYTES = (20, 21, 21), (23, 23, 23), 1 << 27
#: Nodes of a code at most, as a power of two.
NODES = 9
#: Letters of a word after which its last 6 bytes stand for the word before.
WORD_BEFORE = 3
#: Rate of the steps by which mixing weights are fitted.
RATE = 0.12
#: Weight sets: 4 levels of what the last two predictors have seen, and 3 states of the repeat predictor. Inputs: a bias, the predictors, the repeat predictor.
GATES, INPUTS = 48, 6
#: Bytes of a block of documents that are handled together, and of a piece of it.
BLOCK_BYTES, PIECE_BYTES = 8_000_000, 250_000
#: Bits of a step by which weights are fitted, and how many sums there are of one: adding to the same one again and again waits each time for the last.
FIT_BITS, LANES = 1 << 14, 4
#: Bytes that have codes of their own after pairs of such bytes.
COMMON = 40
#: Bits after which a document first refines what the mix makes of each input; each later stretch is twice as long.
FIRST_BITS = 2048
#: How firmly these factors are held at 1 at first, in bits' worth of curvature.
HELD = 60.0
#: Bytes of texts that a task's tables are of.
COUNTED_BYTES = 96_000_000
#: Weight at first of single tokens' probabilities beside the mixed ones, units that it counts for, and units after which it first changes.
SINGLE, PRIOR_UNITS, FIRST_UNITS = 0.3, 16, 32
PART = 1 << 16
END = 10
_EXACT = 256.0


def table_bits(train_bytes: int) -> tuple[int, ...]:
    """Slots of each table, as powers of two, by the bytes of the training documents: with the square root of them."""
    more = max(0, (max(train_bytes, 1) // LEAST_BYTES).bit_length() // 2)
    return tuple(min(b, a + more) for a, b in zip(LEAST_SLOTS, MOST_SLOTS, strict=True))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, with A-Z in lower case; the end isn't among them."""
    return text.lower().split()


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; -1 of a null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5, F.lit(-1)).cast("int")


#: Bytes as 128 kinds, to count triples of them: those of texts in lower case as they are, others share the numbers of bytes that texts don't have. It
#: has an effect on how long codes are, not on what they can say.
_FREE = np.array([i for i in range(128) if i < 10 or 11 <= i < 32 or 65 <= i < 91])
FOLDED = np.array([i if i < 128 else _FREE[i % len(_FREE)] for i in range(256)])


class Code:
    """A binary code of a byte after the two before it, by Huffman's method over counts of triples, so that few decisions make a byte.

    Pairs of COMMON bytes have a code of their own, and others one by the byte before. A pair's code has the COMMON bytes and an escape, after which
    comes the code of the other bytes. After a blank or END, as words begin there, the code is by that byte alone.
    """

    def __init__(self, counts: np.ndarray) -> None:
        """counts: how often each byte follows each two, 128 x 128 x 256; those before are FOLDED."""
        by_byte = counts.sum(axis=(0, 1))
        common = [i for i in np.argsort(-by_byte, kind="stable").tolist() if i not in (32, END)][:COMMON]
        self.context = np.tile(np.arange(256, dtype=np.int32), (256, 1))  # by the second byte before and the byte before
        sums = [counts[:, FOLDED[b]].sum(axis=0) for b in range(256)]
        known = [32, *common]
        for a in known:
            for b in common:
                self.context[a, b] = len(sums)
                sums.append(counts[FOLDED[a], FOLDED[b]])
        self.length = np.zeros((len(sums), 256), np.int32)
        self.offset = np.zeros((len(sums), 256), np.int32)
        steps: list[int] = []
        usual = [*known, END]
        rare = np.ones(256, bool)
        rare[usual] = False
        general = self._paths(by_byte[rare] + 1.0, 0)
        for c, weight in enumerate(sums):
            own = np.append(weight[usual], weight[rare].sum()) + 0.02
            paths = self._paths(own, 256)
            for symbol, path in zip(usual, paths, strict=False):
                self.offset[c, symbol], self.length[c, symbol] = len(steps), len(path)
                steps += path
            for symbol, rest in zip(np.flatnonzero(rare).tolist(), general, strict=True):
                path = paths[-1] + rest
                self.offset[c, symbol], self.length[c, symbol] = len(steps), len(path)
                steps += path
        self.offset, self.length = self.offset.reshape(-1), self.length.reshape(-1)
        self.steps = np.array(steps, np.uint16)  # twice a node's number, and its bit

    @staticmethod
    def _paths(weights: np.ndarray, first: int) -> list[list[int]]:
        """For each symbol its decisions; a node's number is `first` and more."""
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        parent, side = [0] * (2 * n - 1), [0] * (2 * n - 1)
        for made in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i], parent[j], side[j] = made, made, 1
            heapq.heappush(heap, (a + b, made))
        out = []
        for at in range(n):
            path = []
            while at != 2 * n - 2:
                path.append(2 * (first + 2 * n - 2 - parent[at]) + side[at])
                at = parent[at]
            out.append(path[::-1])
        return out

    def contexts(self) -> int:
        """A power of two that contexts are fewer than."""
        return 1 << int(self.context.max()).bit_length()

    def pair_table(self, counts: np.ndarray) -> np.ndarray:
        """The table of the predictor whose contexts are the code's own, from how often each byte came in each context: of the bytes whose paths have a node."""
        lengths, offsets = self.length, self.offset
        out = np.zeros(2 * self.contexts() << NODES)
        key = np.flatnonzero(counts[: len(lengths)])
        n = lengths[key]
        at = np.repeat(offsets[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = np.repeat((key >> 8) << (NODES + 1), n) | self.steps[at]
        out += np.bincount(place, np.repeat(counts[key], n), len(out))
        return levels(out[0::2], out[1::2])

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.length, self.offset, self.steps

    @classmethod
    def of(cls, parts: tuple[np.ndarray, ...]) -> Code:
        own = cls.__new__(cls)
        own.context, own.length, own.offset, own.steps = parts
        return own


_BASE, _INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
#: A 64-bit number for each byte, of which hashes of words are sums.
_LETTER = np.random.default_rng(42).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_KEEP = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(9)], np.uint64)
_ENDS = np.uint64(int.from_bytes(bytes([END] * 8), "little"))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of _BASE and of its inverse, as they wrap in 64 bits."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 19)
        for i, x in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, x, np.uint64))))
    return _powers


def prefix_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse): (sums[b] - sums[a]) * inverse[a] is the hash of the bytes a:b, wherever they stand."""
    n = len(x)
    power, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.take(_LETTER, x) * power[:n], out=sums[1:])
    return sums, inverse


def mixed_bits(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Hashes of contexts of predictor k as slots of 2**bits: the first bits of (m ^ (m >> 29)), which for up to 29 are those of m."""
    m = h + np.uint64(k)
    m *= np.uint64(0xFF51AFD7ED558CCD)
    if bits > 29:
        m ^= m >> np.uint64(29)
    m >>= np.uint64(64 - bits)
    return m.astype(np.int32)


def node_hash(node: np.ndarray) -> np.ndarray:
    """32 bits of a node's number, of which the highest change a slot."""
    return (node + np.uint32(1)) * np.uint32(0x9E3779B1)


def owners(length: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The number of each, as often as its length says; step: sums of the lengths."""
    if not length.all():
        return np.repeat(np.arange(len(length)), length)
    first = np.zeros(int(step[-1]), np.int8)
    first[step[:-1]] = 1
    return np.cumsum(first, dtype=np.intp)


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Indices that sort keys of 64 bits, equal ones in order: by their first 44 bits, or fewer of a million and more, with the index behind them, if that tells different ones apart."""
    if len(keys) < 1 << 24:
        low = np.uint64((1 << max(20, len(keys).bit_length())) - 1)
        joined = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
        order = (joined & low).astype(np.intp)
        if not (((joined[1:] ^ joined[:-1]) <= low) & (keys[order[1:]] != keys[order[:-1]])).any():
            return order
    return np.argsort(keys, kind="stable")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of 64 bits, ascending, and of each key which of them it is."""
    order = stable_order(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    at = np.empty(len(keys), np.intp)
    at[order] = np.cumsum(new, dtype=np.intp) - 1
    return ordered[new], at


class Piece:
    """Some documents as bits, with the slots that each predictor has for them.

    A document is its tokens: words with a blank between, then END. Contexts never reach into another document.
    """

    def __init__(self, parts: list[tuple[bytes, int]], code: Code, bits: tuple[int, ...]) -> None:
        data = b"".join([d for d, _ in parts])
        x = np.frombuffer(data, np.uint8)
        n = len(x)
        sizes = np.array([len(d) for d, _ in parts], np.int32)
        skips = np.array([k for _, k in parts], np.int32)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        every = np.arange(n, dtype=np.int32)
        place = every - np.repeat(starts, sizes)
        # The 8 bytes before each, the last one in the highest bits; END before a document.
        eight = np.ndarray((n,), "<u8", b"\0" * 8 + data, strides=(1,)).copy()
        near = np.flatnonzero(place < 8)
        keep = _KEEP[place[near]]
        eight[near] = (eight[near] & keep) | (_ENDS & ~keep)
        one, two = (eight >> np.uint64(56)).astype(np.int32), ((eight >> np.uint64(48)) & np.uint64(255)).astype(np.int32)
        # Words: where they begin; hashes of what of them lies before each byte.
        sums, inverse = prefix_sums(x)
        begin = (place == 0) | (one == 32)
        begins = np.flatnonzero(begin).astype(np.int32)
        lengths = np.diff(np.append(begins, np.int32(n)))
        # np.take of a number for each is quicker than np.repeat of what it has.
        word = np.cumsum(begin, dtype=np.intp)
        word -= 1
        letters = every - np.take(begins, word, mode="clip")
        prefix = sums[:n] - np.take(sums[begins], word, mode="clip")
        prefix *= np.take(inverse[begins], word, mode="clip")
        whole = (sums[begins + lengths - 1] - sums[begins]) * inverse[begins]
        first = place[begins] == 0
        last = np.concatenate((np.zeros(1, np.uint64), whole[:-1]))
        last[first] = 0
        joint = np.where(letters <= WORD_BEFORE, prefix ^ np.take(last * np.uint64(0x9E3779B97F4A7C15), word, mode="clip"), (eight >> np.uint64(16)) + np.uint64(1))
        # Bits.
        where = np.take(code.context.reshape(-1), (two << 8) | one, mode="clip") << 8
        key = where + x
        length = np.take(code.length, key, mode="clip")
        if skips.any():
            length[place < np.repeat(skips, sizes)] = 0
        step = np.cumsum(length, dtype=np.int32)
        total = int(step[-1])
        owner = owners(length, step)
        # A byte's steps follow each other; from its last one to the first of the next byte that has any it's a jump.
        some = slice(None) if length.all() else length > 0
        offset, many = np.take(code.offset, key[some], mode="clip"), length[some]
        flat = np.ones(total, np.int32)
        flat[(step - length)[some]] = np.append(offset[:1], offset[1:] - offset[:-1] - many[:-1] + 1)
        taken = np.take(code.steps, np.cumsum(flat, dtype=np.intp), mode="clip")
        node = taken >> 1
        self.bit = (taken & 1).astype(np.int8)
        pair = np.take(where << (NODES - 8), owner, mode="clip")
        pair |= node
        self.slots = [pair]
        salt = node_hash(node.astype(np.uint32))
        salts = {size: (salt >> np.uint32(32 - size)).view(np.int32) for size in set(bits)}
        for k, (context, size) in enumerate(zip((eight >> np.uint64(32), prefix, joint), bits, strict=True)):
            # A context tells the bytes before that the code depends on, and so a node's number tells the node.
            h = np.take(mixed_bits(context, k, size), owner, mode="clip")
            h ^= salts[size]
            self.slots.append(h)
        self.keys = key[length > 0] if skips.any() else key
        self.part_bits = np.add.reduceat(length, starts)
        counted = begins[place[begins] >= np.repeat(skips, sizes)[begins]] if skips.any() else begins
        self.unit_bits = (step - length)[counted]
        self._rest = code, x, where, begins, lengths, last, first, length, step, taken

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The repeat predictor: the word that came after the same two words the last time in this document, while its letters are right.

        The bits of which it says something; 1 or -1 for the bit it says; and its state: 1 in the first letters, 2 after them.
        """
        code, x, context, begins, lengths, last, first, length, step, taken = self._rest
        two = np.concatenate((np.zeros(1, np.uint64), last[:-1]))
        two[first] = 0
        doc_of = (np.cumsum(first) - 1).astype(np.uint64)
        keys = (last * np.uint64(3) ^ two * np.uint64(0xC2B2AE3D27D4EB4F)) + doc_of * np.uint64(0x165667B19E3779F9)
        order = stable_order(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        source = np.full(len(begins), -1)
        source[order[1:][same]] = order[:-1][same]
        source[last == 0] = -1
        # Of words that have such a word before them, and only as many letters as that has.
        words = np.flatnonzero(source >= 0)
        size = np.minimum(lengths[words], lengths[source[words]]).astype(np.intp)
        to = np.cumsum(size)
        each = np.repeat(np.arange(len(words)), size)
        letters = np.arange(len(each)) - (to - size)[each]
        at = begins[words][each] + letters
        guess = x[begins[source[words]][each] + letters]
        wrong = np.concatenate((np.zeros(1, np.int64), np.cumsum(guess != x[at])))
        live = wrong[:-1] == wrong[to - size][each]
        at, guess, letters = at[live], guess[live], letters[live]
        other = context[at] + guess
        count = np.minimum(length[at], code.length[other])
        ends = np.cumsum(count)
        inside = np.arange(int(ends[-1]) if len(ends) else 0)
        inside -= np.repeat(ends - count, count)
        mine = np.repeat((step - length)[at], count) + inside
        flat = np.repeat(code.offset[other], count) + inside
        other, own = np.take(code.steps, flat), np.take(taken, mine)
        agrees = (other >> 1) == (own >> 1)
        return mine[agrees], 2.0 * (other[agrees] & 1).astype(np.float32) - 1.0, 1 + (np.repeat(letters, count)[agrees] >= 2)


def spread(texts: list[list[bytes]]) -> list[bytes]:
    return [b" ".join(x) + b"\n" for x in texts]


def stretches(doc: bytes) -> list[tuple[bytes, int]]:
    """A document in stretches of about PIECE_BYTES, each with the two words before it, whose bytes (the second value) don't count again."""
    out, at, lead = [], 0, 0
    while len(doc) - at > 2 * PIECE_BYTES:
        cut = doc.find(b" ", at + PIECE_BYTES) + 1
        if not cut:
            break
        out.append((doc[lead:cut], at - lead))
        at = cut
        lead = max(doc.rfind(b" ", 0, max(0, doc.rfind(b" ", 0, cut - 1))) + 1, cut - 1000)
    return [*out, (doc[lead:], at - lead)]


def pieces(docs: list[bytes]) -> Iterator[list[tuple[bytes, int]]]:
    """Stretches of about PIECE_BYTES together, at least one at a time."""
    some, size = [], 0
    for doc in docs:
        for part in stretches(doc):
            some.append(part)
            size += len(part[0])
            if size >= PIECE_BYTES:
                yield some
                some, size = [], 0
    if some:
        yield some


def keep_freed() -> None:
    """Lets this process keep some 60 MB that are freed, as the C library does once it has seen so large an array go; else all arrays of a piece are asked for and handed back anew."""
    np.empty(30_000_000, np.uint8)


def _sums(at: np.ndarray, x: np.ndarray | None) -> np.ndarray:
    """Sums of x by gate (or how many there are), from those by lane and gate."""
    return np.bincount(at, x, LANES * GATES).reshape(LANES, GATES).sum(axis=0)


def levels(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """What a slot says, in 16 bits: the logit of its bit, in 1/256, and in the last two bits how much it has seen."""
    n = zeros + ones
    logit = np.log((ones + 0.25) / (zeros + 0.25)).clip(-7.9, 7.9)  # counts of 64 bits
    seen = (n > 0).astype(np.int64) + (n > 2) + (n > 15)
    return ((logit * _EXACT).round().astype(np.int64) * 4 + seen).astype(np.int16)


class Mixer:
    """Predictors' tables, and weights that combine them."""

    def __init__(self, code: Code, bits: tuple[int, ...], tables: list[np.ndarray], weights: np.ndarray | None = None) -> None:
        self.code, self.bits, self.tables = code, bits, tables
        self.weights = np.tile(np.array([0.0, 0.2, 0.4, 0.35, 0.35, 1.0], np.float32), (GATES, 1)) if weights is None else weights
        steps = np.arange(-2048, 2049) / 128.0
        self.costs = np.log1p(np.exp(-steps)).astype(np.float32)
        self.right = (1 / (1 + np.exp(-steps))).astype(np.float32)

    def inputs(self, piece: Piece) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """What the tables say of each bit; where the repeat predictor speaks, and what it says; and the weight set.

        The last two bits of a table's value, how much it has seen, are left in what it says, as they are less than its noise.
        """
        values = [np.take(table, slots, mode="clip") for table, slots in zip(self.tables, piece.slots, strict=True)]
        where, says, state = piece.repeats()
        gate = values[-1] & 3
        gate <<= 2
        gate |= values[-2] & 3
        gate[where] |= (state * 16).astype(np.int16)
        return values, (where, says), gate.astype(np.intp)

    def weighted(self, piece: Piece) -> np.ndarray:
        """What each input adds to the score of what each bit is (INPUTS x bits): weights by gate times what is said. Its sum is the mix."""
        return self.for_ones(piece) * self.signs(piece)

    @staticmethod
    def signs(piece: Piece) -> np.ndarray:
        """1 for a one and -1 for a zero."""
        return (2 * piece.bit - 1).astype(np.float32)

    def for_ones(self, piece: Piece) -> np.ndarray:
        """What each input adds to the score of a one (INPUTS x bits)."""
        values, (where, says), gate = self.inputs(piece)
        columns = np.ascontiguousarray(self.weights.T)
        columns[1:-1] *= np.float32(0.25 / _EXACT)
        out = np.empty((INPUTS, len(gate)), np.float32)
        np.take(columns[0], gate, out=out[0], mode="clip")
        for k, value in enumerate(values, 1):
            np.take(columns[k], gate, out=out[k], mode="clip")
            out[k] *= value
        out[-1] = 0
        out[-1, where] = says * columns[-1][gate[where]]
        return out

    def fit(self, docs: list[bytes]) -> int:
        """Online gradient steps of the log likelihood over docs; the number of bits."""
        return sum(self.fit_piece(Piece(some, self.code, self.bits)) for some in pieces(docs))

    def fit_piece(self, piece: Piece) -> int:
        """The same of a piece, by steps of FIT_BITS."""
        columns = np.ascontiguousarray(self.weights.T)
        values, (where, says), gate = self.inputs(piece)
        repeat = np.zeros(len(gate), np.float32)
        repeat[where] = says
        lane = np.arange(FIT_BITS) % LANES * GATES
        for a in range(0, len(gate), FIT_BITS):
            g = gate[a : a + FIT_BITS]
            xs = [value[a : a + FIT_BITS] * np.float32(0.25 / _EXACT) for value in values] + [repeat[a : a + FIT_BITS]]
            score = np.take(columns[0], g, mode="clip")
            for x, column in zip(xs, columns[1:], strict=True):
                said = np.take(column, g, mode="clip")
                said *= x
                score += said
            miss = piece.bit[a : a + FIT_BITS] - 1 / (1 + np.exp(-score.clip(-15, 15)))
            g = g + lane[: len(g)]
            step = RATE / (_sums(g, None) + 64.0)
            columns[0] += step * _sums(g, miss)
            for x, column in zip(xs, columns[1:], strict=True):
                column += step * _sums(g, miss * x)
        self.weights = np.ascontiguousarray(columns.T)
        return len(gate)

    def units(self, docs: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word with what ends it, one document's after another's; of an empty document that of its end.

        They don't depend on which documents are scored together. A document (or stretch of a long one) keeps learning as it is scored: after
        each run of its bits, each twice as long as the one before, it refines the factors by which it takes each input's weighted say, by a damped
        Newton step of their log likelihood.
        """
        out = []
        costs, right = self.costs, self.right
        for some in pieces(docs):
            piece = Piece(some, self.code, self.bits)
            said, signs = self.for_ones(piece), self.signs(piece)
            cost = np.empty(said.shape[1], np.float32)
            end = 0
            for size in piece.part_bits.tolist():
                at, end, run = end, end + size, FIRST_BITS
                factors, curve = np.ones(INPUTS, np.float32), np.eye(INPUTS, dtype=np.float32) * np.float32(HELD)
                while at < end:
                    to = min(end, at + run)
                    x, sign = said[:, at:to], signs[at:to]
                    index = (factors * np.float32(128)) @ x
                    index *= sign
                    index += np.float32(2048.5)
                    index = index.astype(np.intp)
                    np.take(costs, index, out=cost[at:to], mode="clip")
                    if to < end:
                        r = np.take(right, index, mode="clip")
                        wrong = 1 - r
                        r *= wrong
                        wrong *= sign
                        curve += (x * r) @ x.T
                        factors = (factors + np.linalg.solve(curve, x @ wrong)).clip(0, 4)
                    at, run = to, run * 2
            out.append(-np.add.reduceat(cost, piece.unit_bits, dtype=np.float64) / np.log(10))
        return np.concatenate(out) if out else np.empty(0)


def together(mixed: np.ndarray, single: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the probability of each document, from those of its units by the mixed model and by single tokens.

    Each unit's is a weighted mean of both; the weight of single tokens begins at SINGLE and follows, after each run of units (twice as
    long each time), how often they were the likelier. single's unknown token stands for all that training hasn't, whose
    spellings the mixed model tells apart; so the mean is at most the probability of the token.
    """
    starts = np.cumsum(sizes) - sizes
    out, right, units = np.zeros(len(sizes)), np.full(len(sizes), SINGLE * PRIOR_UNITS), np.full(len(sizes), float(PRIOR_UNITS))
    a, run = 0, FIRST_UNITS
    while len(rest := np.flatnonzero(sizes > a)):
        take = np.minimum(sizes[rest] - a, run)
        cuts = np.cumsum(take) - take
        where = np.repeat(starts[rest] + a - cuts, take) + np.arange(int(take.sum()))
        share = np.repeat(right[rest] / units[rest], take)
        m, s = np.log10(1 - share) + mixed[where], np.log10(share) + single[where]
        gap = np.abs(m - s)
        best = np.maximum(m, s) + np.log10(1 + 10.0 ** -np.minimum(gap, 30))
        out[rest] += np.add.reduceat(best, cuts)
        right[rest] += np.add.reduceat(10.0 ** (s - best), cuts)
        units[rest] += take
        a, run = a + run, run * 2
    return out


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows whose texts have about BLOCK_BYTES together."""
    some: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        at = 0
        for i, x in enumerate(lengths):
            size += x
            if size >= BLOCK_BYTES:
                yield [*some, batch.slice(at, i + 1 - at)]
                some, size, at = [], 0, i + 1
        if at < batch.num_rows:
            some.append(batch.slice(at))
    if some:
        yield some


def _rows(block: list[pa.RecordBatch], column: int) -> list:
    return list(chain.from_iterable(b.column(column).to_pylist() for b in block))


def lines_of(block: list[pa.RecordBatch], column: int) -> list[bytes]:
    """The texts as Piece takes them: words with a blank between, then END."""
    return [b" ".join(tokens(x.as_buffer().to_pybytes())) + b"\n" if x.is_valid else b"\n" for b in block for x in b.column(column)]


#: Of a block of documents: whether each is held out and its size, and their texts as lines_of has them, packed.
BLOCKS = "block long, ids array<long>, folds array<int>, sizes array<int>, data binary"


def tasks(spark: SparkSession, size: int, each: int) -> int:
    """Tasks for so many bytes, of some `each`; two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, size // each)


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs in blocks of some BLOCK_BYTES (BLOCKS), written once, so that all later steps have the same ones."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(F.col(id_col)).alias("fold"), F.col(text_col).cast("string").alias("text"))
    # As many tasks as the texts need, so that blocks aren't smaller for the table's having many parts.
    source = source.coalesce(tasks(docs.sparkSession, source.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 4 * BLOCK_BYTES))

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        number = TaskContext.get().partitionId() << 32
        for block in _blocks(batches, 2):
            lines = lines_of(block, 2)
            columns = [pa.array([number]), pa.array([_rows(block, 0)], pa.list_(pa.int64())), pa.array([_rows(block, 1)], pa.list_(pa.int32())), pa.array([list(map(len, lines))], pa.list_(pa.int32())), pa.array([pack(b"".join(lines))], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "folds", "sizes", "data"])
            number += 1
        tidy()

    return settle(source.mapInArrow(payload, BLOCKS))


class Block:
    """A block's documents."""

    def __init__(self, row: dict) -> None:
        self.ids, self.folds = row["ids"].as_py(), np.array([-1 if f is None else f for f in row["folds"].as_py()], np.int64)
        self.sizes = row["sizes"].values.to_numpy().astype(np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(row["data"].as_py())

    def lines(self, which: np.ndarray | None = None) -> list[bytes]:
        ends = np.cumsum(self.sizes)
        return [self.data[b - n : b] for i, (b, n) in enumerate(zip(ends.tolist(), self.sizes.tolist(), strict=True)) if which is None or which[i]]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and how many words each document has."""
        x = np.frombuffer(self.data, np.uint8)
        ends = np.cumsum(self.sizes)
        stop = (x == 32) | (x == END)
        begins = np.flatnonzero(np.concatenate(([True], stop[:-1])) & (x != END))
        words = []
        for a in range(0, len(begins), 1 << 17):
            some = begins[a : a + (1 << 17)]
            to = begins[a + (1 << 17)] if a + (1 << 17) < len(begins) else len(x)
            part = x[some[0] : to]
            sums, inverse = prefix_sums(part)
            at = some - some[0]
            after = np.flatnonzero(stop[some[0] : to])
            after = after[np.searchsorted(after, at)]
            h = (sums[after] - sums[at]) * inverse[at]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            words.append(h ^ (h >> np.uint64(29)))
        each = np.diff(np.concatenate(([0], np.searchsorted(begins, ends))))
        return np.concatenate([np.empty(0, np.uint64), *words]), each


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            yield row["block"].as_py(), Block(row)


def word_counts(blocks: DataFrame) -> DataFrame:
    """(block, seen, known, n): for each block the training counts of its distinct words by ascending hash, packed; of an empty block there is no row.

    known: how many of the distinct training words are first met here; n: training words of the block. A word goes as its 64-bit hash: a row for each block
    that has it, however often.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for number, block in each_block(batches):
            hashes, each = block.words()
            keys, at = distinct(hashes)
            train = np.bincount(at[np.repeat(block.folds != 1, each)], minlength=len(keys))
            for a in range(0, len(keys), 50_000):
                n = min(50_000, len(keys) - a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(keys[a : a + n].view(np.int64)), pa.array(train[a : a + n])], names=["block", "key", "n"])
        tidy()

    rows = blocks.mapInArrow(words, "block long, key long, n long")
    # A word's rows are at most as many as there are blocks, and are spilled where they don't fit.
    rows = rows.selectExpr("block", "key", "n", "sum(n) over (partition by key) as seen", "row_number() over (partition by key order by block) as first")
    own = rows.groupBy("block").agg(F.collect_list("key").alias("keys"), F.collect_list("seen").alias("seen"), F.sum(((F.col("first") == 1) & (F.col("seen") > 0)).cast("long")).alias("known"), F.sum("n").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            each = [y.values.to_numpy()[np.argsort(x.values.to_numpy().view(np.uint64))] for x, y in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compress(x.tobytes()) for x in each], pa.binary()), batch.column(3), batch.column(4)], names=["block", "seen", "known", "n"])

    return own.mapInArrow(pack, "block long, seen binary, known long, n long")


def triples(docs: Sequence[bytes]) -> np.ndarray:
    """Each byte with the two before it (FOLDED ones), as a number; END stands before a document."""
    x = np.frombuffer(b"\n\n" + b"\n\n".join(docs), np.uint8)
    f = FOLDED.astype(np.int32)[x]
    # Of the two ENDs before a document only its own end is of a text.
    number = (f[:-2] << 15) | (f[1:-1] << 8) | x[2:]
    starts = np.cumsum([0, *(len(d) + 2 for d in docs[:-1])])
    keep = np.ones(len(number), bool)
    for back in (1, 2):
        keep[starts[1:] - back] = False
    return number[keep]


def triple_counts(docs: Sequence[bytes]) -> np.ndarray:
    """How often each byte follows each two (FOLDED ones)."""
    return np.bincount(triples(docs), minlength=1 << 22)


def _triple_counts(blocks: DataFrame) -> np.ndarray:
    """The same of all training documents."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 22, np.int64)
        for _, block in each_block(batches):
            for some in batched(block.lines(block.folds != 1), 16):
                np.add.at(total, triples(some), np.int64(1))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])
        del total
        tidy()

    out = np.zeros(1 << 22)
    # Some tens of thousands of kinds of triples, four million at the very most.
    for row in blocks.mapInArrow(tally, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[row["k"]] = row["n"]
    return out.reshape(128, 128, 256)


COUNTS = "part int, task int, counts binary"
#: Part of rows that have sums of fitted weights.
FITTED = -1


def half(block: int, n: int) -> np.ndarray:
    """Which half of the training documents each document of a block is of, if it is one: 0 or 1."""
    at = np.arange(n, dtype=np.uint64) + np.uint64(block) * np.uint64(0x9E3779B97F4A7C15)
    at = (at ^ (at >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((at >> np.uint64(33)) & np.uint64(1)).astype(np.int64)


def _bins(code: Code, bits: tuple[int, ...]) -> tuple[list[int], list[tuple[int, int]]]:
    """Counts that are held: of bytes in the code's contexts, and two for each slot of each table; and their parts, of 2 * PART each."""
    sizes = [code.contexts() << 8, *[2 << b for b in bits]]
    return sizes, [(k, a) for k, n in enumerate(sizes) for a in range(0, n, 2 * PART)]


def counted(blocks: DataFrame, code: tuple, bits: tuple[int, ...], which: int, tables: Broadcast | None = None) -> DataFrame:
    """(part, task, counts): sums of the tables' slots over one half of the training documents, in parts of PART slots.

    Sums have 64 bits; those of a task, whose bits are far fewer, 32 until they are added up. With tables, code and tables of the other half, weights are
    fitted as by `fitted` while the bits are at hand; these sums are rows of part FITTED, one for each task.
    """
    sizes, parts = _bins(Code.of(code), bits)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        own = Code.of(code)
        totals: list[np.ndarray] = []
        fit = Fit(*tables.value, bits) if tables else None
        for number, block in each_block(batches):
            lines = block.lines((block.folds != 1) & (half(number, len(block.sizes)) == which))
            if lines and not totals:
                totals = [np.zeros(n, np.int32) for n in sizes]
            made = (Piece(some, own, bits) for some in pieces(lines))
            for piece in fit.over(made) if fit else made:
                np.add.at(totals[0], piece.keys, np.int32(1))
                for total, slots in zip(totals[1:], piece.slots[1:], strict=True):
                    slots *= 2
                    slots += piece.bit
                    np.add.at(total, slots, np.int32(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        if fit and fit.seen:
            yield pa.RecordBatch.from_arrays([pa.array([FITTED], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.append(fit.sums, fit.seen).tobytes()], pa.binary())], names=["part", "task", "counts"])
        for i in range(0, len(parts) if totals else 0, 16):
            some_parts = [(j, totals[k][a : a + 2 * PART]) for j, (k, a) in list(enumerate(parts))[i : i + 16]]
            some_parts = [(j, x) for j, x in some_parts if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in some_parts], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(some_parts), pa.int32()), pa.array([pack(x.tobytes()) for _, x in some_parts], pa.binary())], names=["part", "task", "counts"])
        del totals
        tidy()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part, task, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part == FITTED:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([data.as_py()], pa.binary())], names=["part", "task", "counts"])
                    continue
                x = np.frombuffer(unpack(data.as_buffer().to_pybytes()), np.int32)
                if part in totals:
                    totals[part] += x
                else:
                    totals[part] = x.astype(np.int64)
        for part, x in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([pack(x.tobytes())], pa.binary())], names=["part", "task", "counts"])

    # Tasks are few beside the bytes (COUNTED_BYTES each), and a part's rows are added up one by one.
    return blocks.mapInArrow(tally, COUNTS).repartition(partitions(blocks.sparkSession), "part").mapInArrow(summed, COUNTS)


def tables_of(counts: DataFrame, code: Code, bits: tuple[int, ...]) -> list[np.ndarray]:
    """The predictors' tables from (part, counts), a part's rows added up; of a size that table_bits bounds."""
    sizes, parts = _bins(code, bits)

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part, each in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = sum(np.frombuffer(unpack(c.as_buffer().to_pybytes()), np.int64) for c in each)
                x = levels(x[0::2], x[1::2]) if parts[part][0] else x
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(x.tobytes())], pa.binary())], names=["part", "said"])

    tables = [np.tile(levels(np.zeros(1), np.zeros(1)), n // 2) for n in sizes]
    pairs = np.zeros(sizes[0], np.int64)
    for row in counts.groupBy("part").agg(F.collect_list("counts").alias("each")).mapInArrow(said, "part int, said binary").toLocalIterator():
        k, a = parts[row["part"]]
        data = zstandard.ZstdDecompressor().decompress(bytes(row["said"]))
        if k:
            tables[k][a // 2 : a // 2 + PART] = np.frombuffer(data, np.int16)
        else:
            pairs[a : a + 2 * PART] = np.frombuffer(data, np.int64)
    tables[0] = code.pair_table(pairs)
    return tables


class Fit:
    """Weights times bits, and bits: sums over blocks, each of which fits mixing weights from the first ones on."""

    def __init__(self, code: tuple, tables: list[np.ndarray], bits: tuple[int, ...]) -> None:
        self.mixer = Mixer(Code.of(code), bits, tables)
        self.first = self.mixer.weights
        self.sums, self.seen = np.zeros(GATES * INPUTS), 0.0

    def over(self, made: Iterable[Piece]) -> Iterator[Piece]:
        """The pieces of a block, each fitted on before it is passed on."""
        self.mixer.weights, n = self.first, 0.0
        for piece in made:
            n += self.mixer.fit_piece(piece)
            yield piece
        self.sums += self.mixer.weights.reshape(-1).astype(np.float64) * n
        self.seen += n


def fitted(blocks: DataFrame, code: tuple, bits: tuple[int, ...], tables: list[np.ndarray], which: int) -> tuple[np.ndarray, float]:
    """(weights times bits, bits): sums over blocks, each of which fits mixing weights on all its training documents of one half; tables are those of the other half."""
    sent = blocks.sparkSession.sparkContext.broadcast((code, tables))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        keep_freed()
        for number, block in each_block(batches):
            lines = block.lines((block.folds != 1) & (half(number, len(block.sizes)) == which))
            if not lines:
                continue
            own = own or Fit(*sent.value, bits)
            for _ in own.over(Piece(some, own.mixer.code, bits) for some in pieces(lines)):
                pass
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own.sums), dtype=np.int32)), pa.array(own.sums), pa.array(np.full(len(own.sums), own.seen))], names=["i", "w", "n"])
        tidy()

    out, total = np.zeros(GATES * INPUTS), 0.0
    for row in blocks.mapInArrow(fit, "i int, w double, n double").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():  # GATES * INPUTS rows
        out[row["i"]], total = row["w"], row["n"]
    sent.destroy()
    return out.reshape(GATES, INPUTS), total


def fitted_beside(counts: DataFrame) -> tuple[np.ndarray, float]:
    """The same from what `counted` fitted: a row for each of its tasks, which are few."""
    out = np.zeros(GATES * INPUTS + 1)
    for row in counts.where(F.col("part") == FITTED).orderBy("task").toLocalIterator():
        out += np.frombuffer(row["counts"])
    return out[:-1].reshape(GATES, INPUTS), float(out[-1])


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Tokens are words, with A-Z in lower case, then one end. Documents whose fold is 1 are held out; the others are learned from. base_score is
    the log10 probability by smoothed counts of single tokens in all training documents; score is that of the mixed model and of the smoothed counts, token
    by token. The model's tables are counted over all training documents; their size follows these documents' bytes (table_bits). Its weights are fitted on
    all of them: on each half of them with the tables of the other, which don't have what they are fitted on. bits per byte are -score * log2(10) / bytes. A null text counts as empty:
    its only token is the end. Texts are scored whole; those of over twice PIECE_BYTES are held in stretches, which begin anew what a document learns of itself.
    Rows with a null id are learned from, and not held out; repeated rows each count and come back. Other columns aren't read; an empty
    table gives no rows. The driver gets the predictors' tables, whose size table_bits bounds, and sums.
    """
    spark = docs.sparkSession
    blocks = blocks_of(docs, id_col, text_col)
    counts = settle(word_counts(blocks))
    sums = counts.agg(F.sum("known").alias("v"), F.sum("n").alias("n")).first()
    train = F.arrays_zip(F.transform("folds", lambda f: (f != 1).cast("long")).alias("t"), F.col("sizes").alias("s"))
    ends, size = blocks.select(F.aggregate(train, F.lit(0).cast("long"), lambda a, x: a + x["t"]), F.aggregate(train, F.lit(0).cast("long"), lambda a, x: a + x["t"] * x["s"])).toDF("a", "b").agg(F.sum("a"), F.sum("b")).first()
    ends, size = ends or 0, size or 0
    total = (sums["n"] or 0) + ends
    floor = float(np.log10(total + 0.5 * ((sums["v"] or 0) + (ends > 0) + 1)))
    bits = table_bits(size)
    whole_code = Code(_triple_counts(blocks))
    code = whole_code.parts()
    # Few tasks, as each has tables of its own to add up.
    few = blocks.coalesce(tasks(spark, size, COUNTED_BYTES))
    halves = [settle(counted(few, code, bits, 0))]
    sent = spark.sparkContext.broadcast((code, tables_of(halves[0], whole_code, bits)))
    both = settle(counted(few, code, bits, 1, sent))
    sent.destroy()
    halves.append(both.where(F.col("part") != FITTED))
    fits = [fitted(few, code, bits, tables_of(halves[1], whole_code, bits), 0), fitted_beside(both)]
    fit_bits = sum(n for _, n in fits)
    weights = (sum(w for w, _ in fits) / fit_bits).astype(np.float32) if fit_bits else None
    tables = tables_of(halves[0].unionAll(halves[1]), whole_code, bits)
    sent = spark.sparkContext.broadcast((code, tables, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        keep_freed()
        for batch in batches:
            for i in range(batch.num_rows):
                own = own or Mixer(Code.of(sent.value[0]), bits, sent.value[1], sent.value[2])
                yield _scored_block(own, {c: batch.column(c)[i] for c in batch.schema.names}, total, ends, floor)
        tidy()

    joined = blocks.join(counts.select("block", "seen"), "block", "left")
    return joined.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scored_block(own: Mixer, row: dict, total: int, ends: int, floor: float) -> pa.RecordBatch:
    block = Block(row)
    hashes, sizes = block.words()
    seen = np.empty(0)
    if row["seen"].is_valid:
        seen = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["seen"].as_py()), np.int64)[distinct(hashes)[1]]
    elif len(hashes):
        raise RuntimeError("a block of documents has no counts")
    logs, end = np.log10(seen + 0.5), np.log10(ends + 0.5)
    starts = np.cumsum(sizes) - sizes
    sum_of = lambda x: np.add.reduceat(np.append(x, 0.0), starts) * (sizes > 0) if len(sizes) else np.empty(0)
    base = sum_of(logs) + end - (sizes + 1) * floor
    known = sum_of((seen > 0).astype(np.float64)).astype(np.int64) + (ends > 0)
    units = np.maximum(sizes, 1)
    last = np.cumsum(units) - 1
    single = np.zeros(int(units.sum()))
    single[np.arange(len(hashes)) + np.repeat(np.cumsum(units) - units - starts, sizes)] = logs - floor
    single[last] += end - floor
    score = together(own.units(block.lines()), single, units)
    n = len(sizes)
    columns = [pa.array(block.ids, pa.int64()), pa.array(block.folds == 1), pa.array(sizes + 1, pa.int64())]
    columns += [pa.array(known, pa.int64()), pa.array([total] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
