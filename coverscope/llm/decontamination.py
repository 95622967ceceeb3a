"""Benchmark decontamination: template windows, hash-joined, with a check that slots are filled consistently. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.runtime import settle


#: Template words of a window; items of fewer are one window. Those under LEAST_WORDS can't be told from chance inside a text, and match texts that are the
#: whole item alone.
WINDOW, LEAST_WORDS = 8, 5
#: Words by which windows of one item may be shifted against each other, as where a slot is filled by more words.
SHIFT = 4
#: Words of an item that an alignment must cover: so many, or this share of a shorter item.
COVERED, SHARE = 12, 0.75
#: Windows of a benchmark up to which it is broadcast (some 40 bytes each); a larger one is joined by shuffling.
BROADCAST_WINDOWS = 250_000
#: Typed placeholders; in a marked text each stands before the value it replaces.
NAME, NUMBER, UNIT, JOINED = "\u0001", "\u0002", "\u0003", "\u0004"
# Units of measure.
UNITS = """km cm mm nm m kg mg g lb lbs oz l ml km/h kmh mph kph ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks
month months year years meter meters metre metres mile miles inch inches foot feet ft yard yards gram grams kilogram kilograms pound pounds ton tons
litre litres liter liters gallon gallons degree degrees dollar dollars euro euros cent cents percent kw kwh hz khz mhz ghz kb mb gb tb v w""".split()

_UNIT = "(?:" + "|".join(sorted(UNITS, key=lambda x: (-len(x), x))) + ")"
_NUMBER = rf"(?<![\p{{L}}\p{{N}}_.,])[+-]?\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*(?=(?:(?i){_UNIT})?(?![\p{{L}}\p{{N}}]))"
# A capital is the word's own, wherever it stands: at the start of a sentence too, so that a passage has one template whatever is before it.
_NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}[\p{L}\p{M}'’-]*"
_RUN = r"(\u0001\S+)  (?=\u0001)"
_TOKEN = r"[\p{L}\p{N}\p{M}]+|[\u0001-\u0003]\S+"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def marked_tokens(text: Column) -> Column:
    """The lower-cased words of a text, without punctuation; numbers, units after them and runs of capitalised words have a placeholder before them."""
    t = F.translate(text, NAME + NUMBER + UNIT + JOINED, "    ")
    t = F.regexp_replace(t, F.lit(_NAME), F.lit(f"{NAME}$0 "))
    t = F.regexp_replace(t, F.lit(_RUN), F.lit(f"$1{JOINED}"))
    n = F.regexp_replace(t, F.lit(r"\p{Sc}(?=\p{Nd})"), F.lit(f" {UNIT}$0 "))
    n = F.regexp_replace(n, F.lit(_NUMBER), F.lit(f" {NUMBER}$0 "))
    n = F.regexp_replace(n, F.lit(rf"(\u0002\S+\s+)((?i){_UNIT})(?![\p{{L}}\p{{N}}])"), F.lit(f"$1{UNIT}$2"))
    return F.regexp_extract_all(F.lower(F.when(text.rlike(r"\p{Nd}"), n).otherwise(t)), F.lit(_TOKEN), F.lit(0))


def _is_slot(token: Column) -> Column:
    return token < F.lit("\u0004")


def _hashes(tokens: Column) -> Column:
    """The hash of each word's template: of a placeholder alone where there is one."""
    return F.transform(tokens, lambda x: F.xxhash64(F.when(_is_slot(x), F.substring(x, 1, 1)).otherwise(x)))


def _windows(hashes: Column, size: int) -> Column:
    """The hash of each run of `size` words, from those of its words: halves are joined, so that a run of 8 takes 3 steps."""
    if size == 1:
        return hashes
    half = 1 << ((size - 1).bit_length() - 1)
    k = F.greatest(F.size(hashes) - size + 1, F.lit(0))
    join = lambda a, b: F.zip_with(F.slice(a, F.lit(1), k), F.slice(b, F.lit(half + 1), k), lambda x, y: F.xxhash64(x, y))
    if 2 * half == size:
        return _let(_windows(hashes, half), lambda a: join(a, a))
    return join(_windows(hashes, half), _windows(hashes, size - half))


def _rows(text: Column, sizes: list[int]) -> Column:
    """For each place of a text the hash of the window of each size that begins there, or null."""
    none = F.array().cast("array<bigint>")
    windows = lambda h, n: _windows(h, n) if n >= LEAST_WORDS else F.when(F.size(h) == n, _windows(h, n)).otherwise(none)
    return _let(_hashes(marked_tokens(text)), lambda h: F.arrays_zip(*[windows(h, n).alias(str(i)) for i, n in enumerate(sizes)]))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((item_id, ipos, h, size, n, has_slot), (item_id, ipos, value)): windows of the items' templates, and their slots.

    Windows come a second time with names as plain words, for documents whose case tells no names.
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("item_id").isNotNull()).distinct()
    items = items.select("item_id", F.explode(F.array(marked_tokens(F.col("text")))).alias("t")).where(F.size("t") > 0)
    words = F.transform("t", lambda x: F.when(x.startswith(NAME), F.translate(x, NAME + JOINED + "'’-", "     ")).otherwise(x))
    plain = F.regexp_extract_all(F.array_join(words, " "), F.lit(_TOKEN), F.lit(0))
    both = items.unionAll(items.select("item_id", plain.alias("t")))
    sized = both.withColumn("n", F.size("t")).withColumn("size", F.least("n", F.lit(WINDOW)))
    hashed = F.when(F.lit(False), F.array().cast("array<long>"))
    for size in range(1, WINDOW + 1):
        hashed = hashed.when(F.col("size") == size, _windows(_hashes(F.col("t")), size))
    windows = sized.select("item_id", "n", "size", "t", F.posexplode(hashed).alias("ipos", "h"))
    has_slot = F.exists(F.slice("t", F.col("ipos") + 1, F.col("size")), _is_slot)
    windows = windows.select("item_id", "ipos", "h", "size", "n", has_slot.alias("has_slot")).distinct()
    slots = items.select("item_id", F.size("t").alias("n"), F.posexplode("t").alias("ipos", "value")).where(_is_slot(F.col("value")))
    return windows, slots


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(text_key, item_id, covered, item_words, kind): which texts of docs hold which items.

    text_key: xxhash64 of the text. covered: words of the item in the alignment that covers most of it. kind: "verbatim", or
    "reparameterised" where a number, name or unit differs. An alignment counts if it covers COVERED words (or SHARE of a shorter item) and
    fills slots consistently: a value of the item always by the same value, and different names by different ones; or if its windows without slots
    alone cover as much. A null text has no words; equal texts are one; texts are taken whole, however long. Items without an id or a word match nothing; those
    of fewer than LEAST_WORDS words match texts that are no more than the item. A passage may be in the item's case, or in small or capital letters alone.
    """
    windows, item_slots = benchmark_windows(benchmark, item_col, item_text_col)
    windows = settle(windows)
    found = windows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most WINDOW rows
    sizes = sorted({WINDOW, *(r["size"] for r in found)})
    known = windows.select("item_id", "ipos", "h", "size", "n", "has_slot")
    if sum(r["n"] for r in found) <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("text_key"), F.posexplode(_rows(text, sizes)).alias("pos", "x"))
    rows = rows.select("text_key", "pos", F.explode(F.array(*[F.col("x")[str(i)] for i in range(len(sizes))])).alias("h")) if len(sizes) > 1 else rows.select("text_key", "pos", F.col("x")["0"].alias("h"))
    hits = settle(rows.where("h is not null").join(known, "h").drop("h").distinct())
    # The slots of the texts that have windows of items, which are few beside all texts.
    held = hits.select("text_key").distinct()
    held = F.broadcast(held) if held.count() <= BROADCAST_WINDOWS else held
    slots = F.transform(marked_tokens(F.col("text")), lambda x: F.when(_is_slot(x), x))
    values = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(held, "text_key", "left_semi").select("text_key", F.posexplode(slots).alias("pos", "slot")).where("slot is not null").distinct()
    words = lambda w: F.sequence(w["ipos"], w["ipos"] + w["size"] - 1)
    cover = lambda ws: F.array_distinct(F.flatten(F.transform(ws, words)))
    # Windows of one shift, and those of up to SHIFT shifts that follow each other. An alignment has at most SHIFT + 1 times as many as its item.
    delta = F.col("pos") - F.col("ipos")
    groups = F.array(*[F.struct(F.lit(i).alias("grid"), F.floor((delta + i * SHIFT // 2) / w).alias("at")) for i, w in ((0, 1), (1, SHIFT), (2, SHIFT))])
    hits = hits.select("text_key", "item_id", "ipos", "size", "has_slot", "n", delta.alias("delta"), F.explode(groups).alias("g"))
    aligned = hits.groupBy("text_key", "item_id", "g").agg(F.collect_set(F.struct("ipos", "size", "has_slot", "delta")).alias("ws"), F.max("n").alias("item_words"))
    aligned = aligned.withColumn("plain", F.size(cover(F.filter("ws", lambda w: ~w["has_slot"])))).withColumn("covered", F.size(cover(F.col("ws"))))
    need = F.least(F.lit(COVERED), F.ceil(F.col("item_words") * SHARE))
    aligned = aligned.withColumn("need", need).where("covered >= need")
    at = F.array_distinct(F.flatten(F.transform("ws", lambda w: F.transform(words(w), lambda i: F.struct(i.alias("ipos"), w["delta"].alias("delta"))))))
    places = aligned.select("text_key", "item_id", "g", F.explode(at).alias("x")).select("text_key", "item_id", "g", "x.ipos", "x.delta")
    places = places.join(F.broadcast(item_slots) if sum(r["n"] for r in found) <= BROADCAST_WINDOWS else item_slots, ["item_id", "ipos"])
    filled = places.withColumn("pos", F.col("ipos") + F.col("delta")).join(values, ["text_key", "pos"])
    # A name at an end of the item may have run together with one beside it.
    beside = ((F.col("ipos") == 0) & F.col("slot").endswith(F.concat(F.lit(JOINED), "value"))) | ((F.col("ipos") == F.col("n") - 1) & F.col("slot").startswith(F.concat("value", F.lit(JOINED))))
    filled = filled.withColumn("slot", F.when(beside, F.col("value")).otherwise(F.col("slot")))
    filled = filled.groupBy("text_key", "item_id", "g").agg(F.collect_set(F.struct("value", "slot")).alias("p"))
    name = lambda x: x["value"].startswith(NAME)
    once = F.size(F.array_distinct(F.col("p.value"))) == F.size("p")
    apart = F.size(F.array_distinct(F.transform(F.filter("p", name), lambda x: x["slot"]))) == F.size(F.filter("p", name))
    filled = filled.select("text_key", "item_id", "g", (once & apart).alias("consistent"), F.exists("p", lambda x: x["value"] != x["slot"]).alias("changed"))
    judged = aligned.drop("ws").join(filled, ["text_key", "item_id", "g"], "left").where("plain >= need or coalesce(consistent, true)")
    kind = F.when(F.coalesce("changed", F.lit(False)), "reparameterised").otherwise("verbatim")
    best = judged.groupBy("text_key", "item_id").agg(F.max(F.struct("covered", (kind == "verbatim").alias("v"), kind.alias("kind"), "item_words")).alias("b"))
    return best.select("text_key", "item_id", F.col("b.covered").cast("long").alias("covered"), F.col("b.item_words").cast("long").alias("item_words"), "b.kind")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, item_words, kind) of each document that holds an item, as contaminated_texts has it.

    Repeated rows give one; a document with a null id comes with a null one. Other columns aren't read; empty tables give no rows.
    """
    texts = contaminated_texts(docs, benchmark, text_col, item_col, item_text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"))
    return own.join(texts, "text_key").select("doc_id", "item_id", "covered", "item_words", "kind").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns, whatever they are called; rows with a null text stay."""
    bad = contaminated_texts(docs, benchmark, text_col, item_col, item_text_col).select("text_key").distinct()
    key = F.xxhash64(F.coalesce(F.col(f"d.{text_col}").cast("string"), F.lit("")))
    return docs.alias("d").join(bad.alias("b"), key == F.col("b.text_key"), "left_anti")
