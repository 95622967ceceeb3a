"""Numbers: bounds, similarities, weighted scores."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of what two articles have in common.
WEIGHTS = {"title": 0.38, "entities": 0.23, "time": 0.14, "location": 0.10, "semantic": 0.15}
# How sure a place's mention is, by field and by type, and what each further meaning of the name takes.
FIELD_WEIGHT = {"title": 0.74, "summary": 0.58}
SPECIFICITY = {"city": 0.10, "admin1": 0.07, "country": 0.04}


def clamp(x: Column) -> Column:
    """x within 0 to 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def shared(a: Column, b: Column) -> Column:
    """How many elements two sets share."""
    return F.size(F.array_intersect(a, b))


def share(shared: Column, sizes: Column) -> Column:
    """Shared over all elements of two sets, whose sizes come to `sizes`; 0 of two empty ones."""
    return F.coalesce(shared / F.nullif(sizes - shared, F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 of two empty ones."""
    return share(shared(a, b), F.size(a) + F.size(b))


def jaccard_if_any(a: Column, b: Column) -> Column:
    """jaccard, or null where a set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), jaccard(a, b))


def seconds_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)


def time_similarity(a: Column, b: Column) -> Column:
    """exp(-hours / 36); null where a time is."""
    return F.exp(-seconds_between(a, b) / 3600 / 36)


def weighted_sums(parts: dict[str, Column], total: Column | None = None, weight: Column | None = None) -> tuple[Column, Column]:
    """(total, weight): the parts that aren't null times their weights, and their weights, added one after another to what there is. parts: by the names of WEIGHTS."""
    total, weight = F.lit(0.0) if total is None else total, F.lit(0.0) if weight is None else weight
    for k, x in parts.items():
        total, weight = total + F.coalesce(clamp(x) * WEIGHTS[k], F.lit(0.0)), weight + F.when(x.isNotNull(), WEIGHTS[k]).otherwise(0.0)
    return total, weight


def weighted_mean(total: Column, weight: Column) -> Column:
    return clamp(F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.0)))


def weighted_score(parts: dict[str, Column]) -> Column:
    """The weighted mean of the parts that aren't null; 0 of none. parts: by the names of WEIGHTS."""
    return weighted_mean(*weighted_sums(parts))


# From how much on a part is a reason, and in which words.
REASONS = {"title": (0.45, "title token overlap %.2f"), "entities": (0.35, "named-entity overlap %.2f"), "time": (0.7, "publication times are close (%.2f)"), "location": (None, "shared event-location evidence %.2f"), "semantic": (0.65, "semantic similarity %.2f")}


def _reaches(name: str, part: Column) -> Column:
    least = REASONS[name][0]
    return F.coalesce(part > 0 if least is None else part >= least, F.lit(False))


def said(parts: dict[str, Column]) -> Column:
    """What the parts of a score that are enough for a reason say in words, in the order of REASONS."""
    each = [F.when(_reaches(k, parts[k]), F.array(F.format_string(text, parts[k]))).otherwise(F.array().cast("array<string>")) for k, (_, text) in REASONS.items() if k in parts]
    return F.concat(*each)


def score_reasons(first: Column, parts: dict[str, Column], score: Column) -> Column:
    """What a score rests on, in words: the reasons that are known and those of other parts, or the score itself if there is none."""
    more = functools.reduce(Column.__or__, [_reaches(k, x) for k, x in parts.items()])
    return F.when(more, F.concat(first, said(parts))).when(F.size(first) == 0, F.array(F.format_string("weighted similarity %.2f", score))).otherwise(first)


def rounded(x: Column, places: int) -> Column:
    """A number from 0 on that is rounded as floating-point numbers are, without a decimal number of each."""
    return F.floor(x * F.lit(10.0**places) + 0.5) / F.lit(10.0**places)


def match_confidence(field: Column, kind: Column, ambiguity: Column) -> Column:
    """How sure the mention of a place is."""
    base = F.when(field == "title", FIELD_WEIGHT["title"]).otherwise(FIELD_WEIGHT["summary"])
    special = F.when(kind == "city", SPECIFICITY["city"]).when(kind == "admin1", SPECIFICITY["admin1"]).when(kind == "country", SPECIFICITY["country"]).otherwise(0.02)
    return clamp(base + special - F.least(F.lit(0.28), F.greatest(F.lit(0.0), (ambiguity - 1) * 0.08)))


def finite_number(text: Column) -> Column:
    """A finite number, else null."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def integer(text: Column) -> Column:
    """A whole number, else null."""
    x = finite_number(text)
    return F.when((x == F.floor(x)) & (F.abs(x) < 2**53), x.cast("long"))


def heat_weight(value: Column, raw: bool) -> Column:
    """Weight of a point of the heat map."""
    x = F.log2(value + 1) / 6 if raw else value.cast("double")
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), x))


def marker_scale(value: Column) -> Column:
    return F.greatest(F.lit(0.72), F.least(F.lit(1.8), value + 0.72))
