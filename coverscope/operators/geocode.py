"""Event locations from a gazetteer, each with the words that name it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from coverscope.functions.numbers import clamp, match_confidence
from coverscope.functions.text import quote_window, same_ignoring_case
from coverscope.runtime import salted_join

MINIMUM, CONTEXT = 0.5, 70
#: Aliases that are sent to the workers at once; more go in several passes over the texts.
SENT_ALIASES = 250_000
#: Texts that become objects at once.
_SLICE = 256
#: Places that the matches of an alias of a large gazetteer go to.
SALTS = 16


class AliasTrie:
    """A trie of aliases over words, whose nodes are known by what leads to them: words in lower case, with what stands between two words as it is, white space as a blank.

    One pass over a text finds all its aliases: from each word on it goes down as far as the text does.
    """

    def __init__(self, aliases: list[str], longest: int) -> None:
        self.nodes: dict[str, bool] = {}
        self.longest, self.pattern = longest, None
        for alias in aliases:
            ends = [e for _, e in self.words(alias)]
            if ends and len(ends) <= longest and ends[-1] == len(alias) and self.words(alias)[0][0] == 0:
                for e in ends[:-1]:
                    self.nodes.setdefault(alias[:e], False)
                self.nodes[alias] = True

    def __getstate__(self) -> dict:
        return {**self.__dict__, "pattern": None}

    def words(self, text: str) -> list[tuple[int, int]]:
        if self.pattern is None:
            import regex

            self.pattern = regex.compile(r"[\p{L}\p{N}\p{M}'’.-]*[\p{L}\p{N}\p{M}]")
        return [m.span() for m in self.pattern.finditer(text)]

    def matches(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, alias) of every run of words that is an alias, by start, then end."""
        places, nodes, blank = self.words(text), self.nodes, re.compile(r"\s+")
        for i, (a, b) in enumerate(places):
            node = text[a:b].lower()
            if (found := nodes.get(node)) is None:
                continue
            if found:
                yield a, b, node
            for c, d in places[i + 1 : i + self.longest]:
                node += blank.sub(" ", text[b:c]).lower() + text[c:d].lower()
                b = d
                if (found := nodes.get(node)) is None:
                    break
                if found:
                    yield a, d, node


def gazetteer_matches(texts: DataFrame, aliases: DataFrame, longest: int = 4, context: int = CONTEXT) -> DataFrame:
    """(texts' columns but text, place columns, start, end, matched_text, quote, ambiguity): where a text names a place, word for word, with what surrounds it.

    texts: text, more. aliases: alias (lower-cased words with single blanks), place_id, more; ambiguity is how many places have the alias. An alias has `longest` words at most. A text is passed over
    once, and isn't part of what comes back. Up to SENT_ALIASES aliases are sent to the workers as a trie; a larger gazetteer is split by the hash of its aliases' first words, each part with a pass of its own.
    """
    meanings = aliases.groupBy("alias").agg(F.countDistinct("place_id").alias("ambiguity"))
    names = aliases.select("alias").where("alias is not null").distinct()
    parts = -(-names.count() // SENT_ALIASES) or 1
    part = F.pmod(F.xxhash64(F.regexp_extract("alias", r"^[\p{L}\p{N}\p{M}'’.-]*[\p{L}\p{N}\p{M}]", 0)), F.lit(parts))
    others = [c for c in texts.columns if c != "text"]
    schema = StructType([*texts.select(*others).schema.fields, StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("matched_text", StringType()), StructField("alias", StringType()), StructField("quote", StringType())])
    found = [texts.select(*others, "text").mapInArrow(_scan(texts, names.where(part == i), longest, context), schema) for i in range(parts)]
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    # An alias may have most of the matches, so these don't go to where its meanings are.
    meant = aliases.join(meanings, "alias")
    if meant.count() <= SENT_ALIASES:
        return every.join(F.broadcast(meant), "alias").drop("alias")  # SENT_ALIASES rows
    return salted_join(every, meant, ["alias"], F.struct("start", "end", "quote"), SALTS).drop("alias")


def _scan(texts: DataFrame, names: DataFrame, longest: int, context: int):  # noqa: ANN202
    """A pass over Arrow batches of texts (the last column) with the trie of the names."""
    sent = texts.sparkSession.sparkContext.broadcast(AliasTrie([r["alias"] for r in names.toLocalIterator()], longest).nodes)  # SENT_ALIASES or so

    def quote(text: str, start: int, end: int) -> str:
        a, b = max(0, start - context), min(len(text), end + context)
        return ("…" if a > 0 else "") + text[a:b].strip(" ") + ("…" if b < len(text) else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = AliasTrie([], longest)
        trie.nodes = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                rows, out = [], []
                for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    for start, end, alias in trie.matches(text or ""):
                        rows.append(i)
                        out.append((start, end, text[start:end], alias, quote(text, start, end)))
                kept = part.select(range(part.num_columns - 1)).take(pa.array(rows, pa.int64())).columns
                new = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*part.schema.names[:-1], "start", "end", "matched_text", "alias", "quote"])

    return run


def located_matches(matches: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """Matches that are sure enough, with confidence and quote. matches: article_id, outlet_id, url, field, start, end, matched_text, place_id, kind, ambiguity; and quote, as gazetteer_matches
    gives it, or text, for matches from elsewhere, which must stand where they say."""
    good = matches.where((F.col("start") >= 0) & (F.col("end") > F.col("start")))
    if "text" in matches.columns:
        there = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
        good = good.where((F.col("end") <= F.length("text")) & same_ignoring_case(there, F.col("matched_text"))).withColumn("quote", quote_window(F.col("text"), F.col("start"), F.col("end"), CONTEXT))
    return good.withColumn("confidence", match_confidence(F.col("field"), F.col("kind"), F.col("ambiguity"))).where(F.col("confidence") >= minimum)


def place_evidence(located: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, place_id, article_id, start, end, url, quote, method, outlet_id, confidence): the evidence of places, a row each.

    Of evidence at one place of an article the later field (summary after title) stands. Matches are dealt out by article first: nearly all differ, so a task that read many would only hold them all to count nothing together.
    """
    keys = keys or []
    own = located.repartition("article_id").groupBy(*keys, "place_id", "article_id", "start", "end").agg(F.max_by(F.struct("url", "quote"), (F.col("field") == "summary").cast("int")).alias("e"), F.max("confidence").alias("confidence"), F.min("outlet_id").alias("outlet_id"))
    return own.select(*keys, "place_id", "article_id", "start", "end", "e.url", "e.quote", F.lit("article_text").alias("method"), "outlet_id", "confidence")


def event_locations(evidence: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, place_id, confidence, articles, outlets) of places with evidence: the strongest mention, more for each further article and outlet.

    keys: what places are gathered within, such as a cluster. Evidence isn't gathered: a place may have that of any number of articles.
    """
    keys = keys or []
    per = evidence.groupBy(*keys, "place_id", "article_id", "outlet_id").agg(F.max("confidence").alias("confidence"))
    places = per.groupBy(*keys, "place_id").agg(F.max("confidence").alias("strongest"), F.countDistinct("article_id").alias("articles"), F.countDistinct("outlet_id").alias("outlets"))
    return places.select(*keys, "place_id", clamp(F.col("strongest") + (F.col("articles") - 1) * 0.06 + (F.col("outlets") - 1) * 0.04).alias("confidence"), "articles", "outlets")


def nearest_region(points: DataFrame, regions: DataFrame, within: float = 24.0) -> DataFrame:
    """(points' columns, region): the region nearest to each point in the plane, if nearer than `within` degrees; of equal ones the least.

    points: latitude, longitude. regions: region, region_latitude, region_longitude. Both are put in cells of `within` degrees, and a point is compared with the regions of
    its own and the eight cells around, which hold all that are near enough.
    """
    cell = lambda c: F.floor(F.col(c) / within)
    numbered = points.withColumn("_id", F.monotonically_increasing_id())
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    spread = numbered.select("_id", "latitude", "longitude", cell("latitude").alias("y"), cell("longitude").alias("x")).select("*", around.alias("dy")).select("*", around.alias("dx"))
    spread = spread.select("_id", "latitude", "longitude", (F.col("y") + F.col("dy")).alias("_y"), (F.col("x") + F.col("dx")).alias("_x"))
    placed = regions.select("region", "region_latitude", "region_longitude", cell("region_latitude").alias("_y"), cell("region_longitude").alias("_x"))
    distance = F.hypot(F.col("latitude") - F.col("region_latitude"), F.col("longitude") - F.col("region_longitude"))
    near = spread.join(placed, ["_y", "_x"]).withColumn("d", distance).where(F.col("d") < within)
    best = near.groupBy("_id").agg(F.min_by("region", F.struct("d", "region")).alias("region"))
    return numbered.join(best, "_id", "left").drop("_id")
