"""Language identification: scripts narrow the candidates, and a Viterbi path over word scores labels spans of mixed-language text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.llm.common import SLICE_ROWS, as_texts

#: Training documents of a language that the model is fitted on, about: those whose hash is below the share that gives so many.
MOST_DOCS = 20_000
#: What a change of language costs a path, in natural-log units, and what a word costs in a language that doesn't use its script.
SWITCH, FOREIGN = 12.0, 12.0
#: A language uses a script that has this share of its letters.
SCRIPT_SHARE = 0.01
#: Bits of the table of each length of letter sequences, and of whole words (0), for up to 8 languages; and how many counts each cell has beforehand.
TABLES, SMOOTHING = {1: 12, 2: 15, 3: 17, 4: 18, 0: 18}, 0.5
#: Words whose scores a worker keeps.
KEPT_WORDS = 400_000
UNKNOWN = "und"

#: First code points of the blocks of scripts; a block ends where the next begins.
SCRIPTS = {
    "latin": (0x0041, 0x1E00, 0x2C60, 0xA720, 0xAB30, 0xFF21),
    "greek": (0x0370, 0x1F00),
    "cyrillic": (0x0400, 0x1C80, 0x2DE0, 0xA640),
    "armenian": (0x0530,),
    "hebrew": (0x0590, 0xFB1D),
    "arabic": (0x0600, 0x08A0, 0xFB50, 0xFE70),
    "devanagari": (0x0900, 0xA8E0),
    "bengali": (0x0980,),
    "gurmukhi": (0x0A00,),
    "gujarati": (0x0A80,),
    "oriya": (0x0B00,),
    "tamil": (0x0B80,),
    "telugu": (0x0C00,),
    "kannada": (0x0C80,),
    "malayalam": (0x0D00,),
    "sinhala": (0x0D80,),
    "thai": (0x0E00,),
    "lao": (0x0E80,),
    "tibetan": (0x0F00,),
    "myanmar": (0x1000, 0xA9E0, 0xAA60),
    "georgian": (0x10A0, 0x1C90, 0x2D00),
    "hangul": (0x1100, 0x3130, 0xA960, 0xAC00),
    "ethiopic": (0x1200, 0x2D80, 0xAB00),
    "khmer": (0x1780,),
    "kana": (0x3040, 0x31F0, 0xFF66),
    "han": (0x2E80, 0x3100, 0x3400, 0xF900, 0x20000),
    # Blocks that belong to none of these, where one of them ends.
    "other": (0x0000, 0x0700, 0x0300, 0x1400, 0x1800, 0x1CC0, 0x2000, 0x3000, 0x3200, 0xA000, 0xA490, 0xA830, 0xA900, 0xA980, 0xAA00, 0xAA80, 0xABC0, 0xD7B0, 0xE000, 0xFE00, 0xFEFF, 0xFFA0, 0x2FA20),
}
_NAMES = list(SCRIPTS)
_BLOCKS = sorted((first, i) for i, firsts in enumerate(SCRIPTS.values()) for first in firsts)
_FIRST, _SCRIPT = np.array([b for b, _ in _BLOCKS]), np.array([s for _, s in _BLOCKS])

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,39}")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str) -> list[str]:
    """Runs of letters with their marks; a run of over 40 comes in stretches."""
    return _WORD.findall(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Features:
    """Cells of letter sequences. Tables follow each other, one for each length in TABLES, with fewer bits for many languages."""

    def __init__(self, languages: int) -> None:
        less = max(0, (max(languages, 1) - 1).bit_length() - 3)
        self.bits = {n: max(6, b - less) for n, b in TABLES.items()}
        self.begin, at = {}, 0
        for n, b in self.bits.items():
            self.begin[n] = at
            at += 1 << b
        self.cells = at

    def of(self, some: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, cell, number of the word) of all sequences of each length in lower-cased words between two bounds; 0 is whole words."""
        lowered = [f"<{w.lower()}>" for w in some]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        signs = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(some)), sizes)
        ends = np.cumsum(sizes)
        left = ends[owner] - np.arange(len(signs))  # signs from here to the word's end
        h = np.zeros(len(signs), np.uint64)
        for n in range(1, max(TABLES) + 1):
            h = h[: len(signs) - n + 1] * _A + signs[n - 1 :] + np.uint64(1)
            fits = left[: len(h)] >= n
            yield n, self.cell(n, h[fits]), owner[: len(h)][fits]
        placed = mixed((signs + np.uint64(1)) * _A + left.astype(np.uint64))
        yield 0, self.cell(0, np.add.reduceat(placed, ends - sizes)), np.arange(len(some))

    def cell(self, n: int, h: np.ndarray) -> np.ndarray:
        return self.begin[n] + (mixed(h) >> np.uint64(64 - self.bits[n])).astype(np.int64)


def scripts_of(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the script, number of the word) of each letter of the words; marks have no script."""
    text = "".join(some)
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(some)), np.fromiter(map(len, some), np.int64, len(some)))
    script = _SCRIPT[np.searchsorted(_FIRST, signs, "right") - 1]
    letters = ~((signs >= 0x300) & (signs < 0x370))
    return script[letters], owner[letters]


class Model:
    """Log-probabilities of cells, and the scripts that each language uses."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        """counts: languages x cells; scripts: languages x letters of each script."""
        self.languages, self.features = languages, Features(len(languages))
        table = np.empty(counts.shape, np.float32)
        for n, b in self.features.bits.items():
            own = slice(self.features.begin[n], self.features.begin[n] + (1 << b))
            seen = max(1, int((counts[:, own].sum(0) > 0).sum()))
            table[:, own] = np.log((counts[:, own] + SMOOTHING) / (counts[:, own].sum(1, keepdims=True) + SMOOTHING * seen))
        self.table = np.ascontiguousarray(table.T)
        self.uses = scripts > SCRIPT_SHARE * scripts.sum(1, keepdims=True)

    def score(self, some: list[str]) -> np.ndarray:
        """words x languages: how much likelier a word is than in its best language (0), a mean over the lengths of sequences."""
        out = np.zeros((len(some), len(self.languages)), np.float64)
        for n, cell, owner in self.features.of(some):
            if n == 0:
                out += self.table[cell]
                continue
            for at in range(0, len(cell), 1 << 18):
                part, whose = self.table[cell[at : at + (1 << 18)]], owner[at : at + (1 << 18)]
                starts = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
                out[whose[starts]] += np.add.reduceat(part, starts, axis=0)
        out /= len(TABLES)
        # A language is a candidate if it uses all scripts of the word, or if none does.
        script, owner = scripts_of(some)
        fits = np.ones(out.shape, bool)
        foreign = ~self.uses[:, script].T
        for k in range(len(self.languages)):
            fits[owner[foreign[:, k]], k] = False
        narrowed = fits.any(1)
        out -= np.where(fits | ~narrowed[:, None], out, -np.inf).max(1, keepdims=True)
        return np.where(narrowed[:, None] & ~fits, -FOREIGN, np.maximum(out, -FOREIGN)) if len(some) else out


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The languages of the path over words that scores most, less switch for each change; of equally good ones the smaller language, and rather none than a change."""
    n, k = scores.shape
    base = int(scores.sum(0).argmax())
    # If no run of words gains over half a change in another language, no path with changes is better than none.
    gain = np.cumsum(scores - scores[:, base : base + 1], axis=0)
    least = np.minimum.accumulate(np.vstack((np.zeros((1, k)), gain[:-1])), axis=0)
    if (gain - least).max() <= switch / 2:
        return np.full(n, base)
    # Before each word: what the best path so far that ends in each language scores, and the score and the language that a change starts from.
    ahead: list[tuple[list[float], float, int]] = []
    now, *rest = scores.tolist()
    for row in rest:
        top = max(now)
        ahead.append((now, top - switch, now.index(top)))
        now = [(x if x >= top - switch else top - switch) + y for x, y in zip(now, row, strict=True)]
    path = [now.index(max(now))]
    for before, change, top in reversed(ahead):
        path.append(path[-1] if before[path[-1]] >= change else top)
    return np.array(path[::-1])


class Labeller:
    """Labels texts; keeps the scores of a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.scores, self.letters = np.empty((0, len(self.model.languages))), np.empty(0, np.int64)

    def label(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(languages of words, their letters, their scores) of each text."""
        if len(self.number) > KEPT_WORDS:
            self.clear()
        known = len(self.number)
        parts = [np.fromiter(map(self.number.__getitem__, words(x)), np.int64) for x in texts]
        if new := list(self.number)[known:]:
            self.scores = np.concatenate((self.scores, self.model.score(new)))
            self.letters = np.concatenate((self.letters, np.fromiter(map(len, new), np.int64, len(new))))
        for own in parts:
            scores = self.scores[own]
            yield best_path(scores) if len(own) else own, self.letters[own], scores


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS) -> Model:
    """The model of the languages of docs, from rows that aren't held out and have a language and a text.

    Of a language with more than most_docs such rows about most_docs are used, those of least hash of id and text. Tables have a fixed size.
    """
    known = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = sorted(tuple(r) for r in known.groupBy("lang").count().collect())  # a row for each language
    languages = [x for x, _ in rows]
    number = {x: i for i, x in enumerate(languages)}
    shares = F.create_map(*[F.lit(y) for x, n in rows for y in (x, min(1.0, most_docs / n))]) if rows else None
    cells, wide = Features(len(languages)).cells, len(_NAMES)
    counts, scripts = np.zeros((len(languages), cells), np.int64), np.zeros((len(languages), wide), np.int64)
    if not rows:
        return Model(languages, counts, scripts)
    some = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(shares, F.col("lang")) * (1 << 20)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(number))
        total = np.zeros(len(number) * (cells + wide), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                by_lang: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = by_lang[number[lang]]
                    for w in words(text):
                        own[w] += 1
                for k, own in by_lang.items():
                    if own:
                        times, begin = np.fromiter(own.values(), np.int64, len(own)), k * (cells + wide)
                        for _, cell, owner in features.of(list(own)):
                            np.add.at(total, begin + cell, times[owner])
                        script, owner = scripts_of(list(own))
                        np.add.at(total, begin + cells + script, times[owner])
        full = np.flatnonzero(total)
        for at in range(0, len(full), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(full[at : at + (1 << 16)]), pa.array(total[full[at : at + (1 << 16)]])], names=["cell", "n"])

    # At most the tables' cells come back.
    found = some.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros(len(languages) * (cells + wide), np.int64)
    both[found["cell"].to_numpy()] = found["n"].to_numpy()
    both = both.reshape(len(languages), -1)
    return Model(languages, both[:, :cells], both[:, cells:])


def languages_of(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs, with spans also what each part of the text is in: array of (start, end, lang), in code points.

    The scripts of a word narrow its candidates to the languages that use them. Words are scored by their letter sequences, and the best path over all words of the text, where each change of
    language costs SWITCH, labels them. lang_pred is the language of most letters (the first by name of equal ones); score is its share of the letters times
    its probability against the others by the words that are in it.

    A text that is null or has no letter, or any text where the model knows no language, is UNKNOWN with a score of 0 and no spans. Texts are whole, however long; repeated rows each come
    back, a null id too; other columns aren't read; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast([model])  # of the tables' fixed size
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans
    types = [pa.string(), pa.float64(), *[pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))] * spans]
    names = ["doc_id", "lang_pred", "score", *["spans"] * spans]

    def runs(text: str, path: np.ndarray) -> list[dict]:
        places = [m.span() for m in _WORD.finditer(text)]
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        return [{"start": places[a][0], "end": places[b - 1][1], "lang": sent.value[0].languages[path[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value[0]
        if len(sent.value) == 1:
            sent.value.append(Labeller(model))  # stays with the worker
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts, rows = as_texts(part.column(1)), []
                for text, (path, letters, scores) in zip(texts, sent.value[1].label(texts) if model.languages else (((), (), ()) for _ in texts), strict=True):
                    if not len(path):
                        rows.append((UNKNOWN, 0.0, *[[]] * spans))
                        continue
                    own = np.bincount(path, weights=letters, minlength=len(model.languages))
                    best = int(own.argmax())
                    total = scores[path == best].sum(0)
                    likely = 1 / np.exp(np.minimum(total - total[best], 700.0)).sum()
                    rows.append((model.languages[best], float(own[best] / own.sum() * likely), *[runs(text, path)] * spans))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs, by a model of the rows that aren't held out: those whose crc32 of doc_id as text, modulo 4, is not 2.

    A null id isn't held out. Otherwise as `languages_of`; a language of the model is never an input of a prediction.
    """
    found = languages_of(docs, trained(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
