"""Secret scans: fixed patterns, and guess costs of values that stand where credentials stand."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.llm.common import SLICE_ROWS, as_texts, map_slices, tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# A run of the last class is taken whole by + as by {n,}; so a short one fails here instead of being dropped afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

#: Where a credential's value may stand, wider than ASSIGN: more names, a header's scheme, "is", and values with any signs. A name begins a word, or a part
#: of one as in dbPassword and DB_PASSWORD.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|login|pin)(?![A-Za-z])["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*(?:(?:bearer|basic)\x20+)?["'`]?([^\s"'`,;<>|]{8,})""",
    re.ASCII | re.IGNORECASE,
)
#: Bits of guessing from which a value counts as a secret; below are words, dates, walks and the like.
LEAST_BITS = 36.0
#: Letters of a word at most.
LONGEST = 18

# Common words of passwords, by rank.
WORDS = """password pass letmein welcome admin login master dragon monkey shadow sunshine princess football baseball superman batman
love secret hello freedom whatever trustno qwerty abc user test guest root default changeme change example sample demo temp
summer winter spring autumn monday friday january june july august december iloveyou angel money family flower cookie
computer internet server system service access token key api value string null none true false undefined placeholder your my the
new old first last name api here please insert enter replace todo some with from this that john michael james david daniel jessica ashley thomas robert jordan hunter killer pepper ginger
orange purple yellow silver golden diamond star tiger eagle lion bear wolf house home work office company city""".split()
# Rows of keyboards and other runs that people type.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
#: Letters of a word at least; bits of a segment's kind, of how often a repeat's unit comes, and of a leet spelling.
SHORTEST, KIND, TIMES, SPELT = 3, 2.0, 6.0, 2.0
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")
_DATE_SIGNS = range(4, 11)


def ranked_words(vocabulary_path: str | None) -> dict[str, int]:
    """Words by rank, WORDS first, then those of a vocabulary file (a token in base64 and its number on each line), whose numbers follow how frequent tokens are."""
    words = dict.fromkeys(WORDS)
    if vocabulary_path:
        with open(vocabulary_path, "rb") as lines:
            for line in lines:
                token = base64.b64decode(line.split()[0]).strip().lower()
                if len(token) >= SHORTEST and token.isalpha():
                    words.setdefault(token.decode())
    return {w: i + 2 for i, w in enumerate(words)}


@lru_cache(maxsize=1)
def usual_words() -> dict[str, int]:
    import public_tokenizers

    return ranked_words(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def sign_bits(c: str) -> float:
    """Bits of one sign under brute force."""
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return math.log2(1000)


def word_bits(raw: str, words: dict[str, int]) -> float | None:
    """Bits of a word: its rank, where its capitals are, and whether signs stand for letters. None of what isn't one."""
    lower = raw.lower()
    rank, spelt = words.get(lower), 0.0
    if not rank:
        rank, spelt = words.get(lower.translate(LEET)), SPELT
        if not rank:
            return None
    form = 0 if raw == lower else 1 if raw in (raw.upper(), raw.capitalize()) else len(raw) - 1
    return math.log2(rank) + form + spelt


def date_bits(raw: str) -> float | None:
    if not _DATE.fullmatch(raw):
        return None
    return math.log2(150 * 365) if len(raw) > 4 else math.log2(150)


def walk_bits(raw: str) -> float | None:
    """Bits of three or more neighbours on a row, in either direction."""
    lower = raw.lower()
    rows = [len(row) for row in WALKS if lower in row or lower in row[::-1]]
    return math.log2(2 * len(WALKS) * min(rows)) + math.log2(len(raw)) + (raw != lower) if rows and len(raw) > 2 else None


def guess_bits(value: str, enough: float = math.inf, words: dict[str, int] | None = None) -> float:
    """log2 of the guesses for a value: the least cost over its segmentations into words, dates, repeats, walks and brute-force spans.

    Each segment costs the bits of its own kind and KIND more. A repeat is a unit of up to 4 signs, 3 or more times. The empty value costs 0. Where the
    cost is certain to reach `enough`, what is certain so far is given instead. Only costs of segments that end further on are held, and of
    the last places, so any value is taken whole, in time that grows with its length.
    """
    words = usual_words() if words is None else words
    n = len(value)
    lower = value.lower()
    ahead: dict[int, float] = {}  # by end, beyond i: the least cost with a word, date or walk that ends there
    costs = [0.0]  # of the last 12 places and i
    repeats = [[math.inf] * 4 for _ in range(5)]  # by unit's size: of the last places, the cost with a repeat that ends there
    best, brute = 0.0, math.inf  # up to i; and the same with a brute-force span at the end

    def reach(end: int, bits: float | None) -> None:
        if bits is not None:
            ahead[end] = min(ahead.get(end, math.inf), best + KIND + bits)

    for i in range(n):
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            reach(j, word_bits(value[i:j], words))
        if value[i].isdigit():
            for size in _DATE_SIGNS:
                if i + size <= n:
                    reach(i + size, date_bits(value[i : i + size]))
        for row in WALKS:
            for line in (row, row[::-1]):
                at = line.find(lower[i])
                j = i
                while at >= 0 and j < n and at < len(line) and lower[j] == line[at]:
                    j, at = j + 1, at + 1
                    if j - i >= 3:
                        reach(j, math.log2(2 * len(WALKS) * len(row)) + math.log2(j - i) + (value[i:j] != lower[i:j]))
        brute = min(brute, best + KIND) + sign_bits(value[i])
        best = min(brute, ahead.pop(i + 1, math.inf))
        end = i + 1
        for size in range(1, 5):
            unit, before = value[end - size : end], math.inf
            if end >= 2 * size and unit == value[end - 2 * size : end - size]:
                before = repeats[size][-size]
                if end >= 3 * size and unit == value[end - 3 * size : end - 2 * size]:
                    before = min(before, costs[-3 * size] + KIND + TIMES + sum(map(sign_bits, unit)))
            repeats[size] = [*repeats[size][-3:], before]
            best = min(best, before)
        costs = [*costs[-12:], best]
        # Every segmentation has a cut here, or a segment across it.
        if best >= enough and (least := min([best, *ahead.values(), *(c for x in repeats for c in x)])) >= enough:
            return least
    return best


def _left(text: str, a: int, b: int, spans: list[tuple[int, int]]) -> bool:
    """Whether the spans, by start, leave a part of a:b that is more than brackets which close around it."""
    rest = []
    for x, y in spans:
        if x < b and a < y:
            rest.append(text[a:x])
            a = y
    return bool("".join([*rest, text[a:b]]).strip(")]}"))


def scan(text: str, words: dict[str, int] | None = None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of each span, in code points, by start and then kind."""
    found = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b, _ in found)
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        if _left(text, a, b, base) and guess_bits(m[1], LEAST_BITS, words) >= LEAST_BITS:
            found.append(("guess", a, b, a))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """The text with each secret, without the name before it, replaced by <secret>; secrets that overlap by one."""
    out, at = [], 0
    for a, b in sorted((s, e) for _, _, e, s in spans):
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def _words(docs: DataFrame, vocabulary_path: str | None) -> Callable[[], dict[str, int]]:
    """The ranked words on executors; of a fixed size, as the vocabulary is."""
    sent = docs.sparkSession.sparkContext.broadcast(ranked_words(vocabulary_path) if vocabulary_path else usual_words())
    return lambda: sent.value


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs, from its whole text.

    A null text counts as empty, which has no spans: spans is "" then. Repeated rows each come back, as do rows with a null id. Very long texts and
    values are taken whole, in time that grows with their length. Other columns aren't read; an empty table gives no rows. vocabulary_path names a file of
    ordinary words by rank that the driver reads (ranked_words).
    """
    columns = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
    words = _words(docs, vocabulary_path)

    def of(batch: pa.RecordBatch) -> dict[str, list]:
        each = [scan(x, words()) for x in as_texts(batch.column(1))]
        base = [[s for s in x if s[0] != "guess"] for x in each]
        counts = {f"n_{k}": [sum(s[0] == k for s in x) for x in each] for k in KINDS[:3]}
        return {"doc_id": batch.column(0), **counts, "base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], "spans": [joined(x) for x in each]}

    return map_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in columns), of, columns)


def without_secrets(docs: DataFrame, text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """docs with its secrets replaced in the text; every row and column stays, a null text too, and columns may have any names."""
    kept = docs.columns
    words = _words(docs, vocabulary_path)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        slices = [texts.slice(i, SLICE_ROWS) for i in range(0, len(texts), SLICE_ROWS)]
        done = [pa.array([None if x is None else redacted(x, scan(x, words())) for x in part.to_pylist()], pa.string()) for part in slices]
        out = pa.concat_arrays(done) if done else pa.array([], pa.string())
        tidy()
        return out

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string"))).select(*kept)
