"""Constraints of stored tables, and rules of nested documents, as issue rows: declared once, evaluated for whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.runtime import spread


@dataclass(frozen=True)
class Table:
    """What a stored table must be. checks: a name and what must not be false; a null passes. unique: sets of columns of which no two rows have the same values, nulls apart. references: the table and column that a column's values
    must be in. The key is unique and has no null."""

    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    checks: dict[str, Callable[[], Column]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


def between(column: str, low: float, high: float) -> Callable[[], Column]:
    return lambda: F.col(column).between(low, high)


def at_least(column: str, low: float) -> Callable[[], Column]:
    return lambda: F.col(column) >= low


def one_of(column: str, *values: object) -> Callable[[], Column]:
    return lambda: F.col(column).isin(*values)


_RUN = {"ingestion_run_id": ("pipeline_runs", "run_id")}
_CLUSTER = {"cluster_id": ("story_clusters", "cluster_id")}
# The constraints of the serving tables.
SERVING = {
    "pipeline_runs": Table(
        ("run_id",), ("source", "status", "input_fingerprint", "started_at", "records_seen", "records_upserted", "retryable", "updated_at"),
        {"status": one_of("status", "running", "succeeded", "degraded", "failed"), "records_seen": at_least("records_seen", 0), "records_upserted": at_least("records_upserted", 0), "retryable": one_of("retryable", 0, 1)},
    ),
    "story_clusters": Table(
        ("cluster_id",), ("ingestion_run_id", "canonical_title", "first_observed_at", "last_observed_at", "raw_article_count", "unique_publisher_count", "normalized_prominence", "cluster_confidence", "membership_explanation", "updated_at"),
        {"raw_article_count": at_least("raw_article_count", 0), "unique_publisher_count": at_least("unique_publisher_count", 0), "normalized_prominence": at_least("normalized_prominence", 0), "cluster_confidence": between("cluster_confidence", 0, 1)},
        references=_RUN,
    ),
    "articles": Table(
        ("article_id",), ("ingestion_run_id", "cluster_id", "canonical_url", "source_url", "title", "publisher_name", "publisher_domain", "language", "published_at", "retrieved_at", "membership_confidence", "membership_evidence", "same_story_json", "content_fingerprint", "updated_at"),
        {"membership_confidence": between("membership_confidence", 0, 1)}, (("cluster_id", "canonical_url"),), _RUN | _CLUSTER,
    ),
    "story_locations": Table(
        ("location_id",), ("ingestion_run_id", "cluster_id", "location_type", "location_granularity", "label", "latitude", "longitude", "confidence", "updated_at"),
        {
            "location_type": one_of("location_type", "event", "mentioned", "publisher_origin", "audience_region"), "location_granularity": one_of("location_granularity", "city", "admin1", "country", "region", "point", "unknown"),
            "latitude": between("latitude", -90, 90), "longitude": between("longitude", -180, 180), "confidence": between("confidence", 0, 1),
        },
        references=_RUN | _CLUSTER | {"evidence_article_id": ("articles", "article_id")},
    ),
    "story_location_evidence": Table(
        ("location_evidence_id",), ("ingestion_run_id", "location_id", "article_id", "source_url", "evidence_quote", "evidence_method", "updated_at"),
        {"evidence_method": one_of("evidence_method", "article_text", "provider_event_geotag", "manual_confirmed")}, (("location_id", "article_id", "source_url", "evidence_quote"),),
        _RUN | {"location_id": ("story_locations", "location_id"), "article_id": ("articles", "article_id")},
    ),
    "story_claims": Table(
        ("claim_id",), ("ingestion_run_id", "cluster_id", "normalized_claim", "stance", "confidence", "evidence_article_id", "evidence_quote", "updated_at"),
        {"stance": one_of("stance", "supports", "disputes", "unclear"), "confidence": between("confidence", 0, 1)}, references=_RUN | _CLUSTER | {"evidence_article_id": ("articles", "article_id")},
    ),
    "regional_prominence": Table(
        ("cluster_id", "region_code", "window_start", "window_end"),
        ("ingestion_run_id", "raw_article_count", "unique_publisher_count", "regional_source_volume", "regional_outlet_count", "normalized_score", "article_share", "outlet_share", "source_normalized_share", "basis", "formula_version", "computed_at"),
        {
            **{c: at_least(c, 0) for c in ("raw_article_count", "unique_publisher_count", "regional_source_volume", "regional_outlet_count", "normalized_score")},
            **{c: between(c, 0, 1) for c in ("article_share", "outlet_share", "source_normalized_share")}, "basis": one_of("basis", "event_location"),
        },
        references=_RUN | _CLUSTER,
    ),
}


def _named(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def violations(tables: dict[str, DataFrame], rules: dict[str, Table] = SERVING) -> DataFrame:
    """(table, constraint, key, n): each row of a table that breaks a constraint of its own, by its key; each set of equal values that should be unique, by them, with how many rows are too many; each row whose reference
    isn't there. Columns that a table lacks count as null.

    A table's own constraints take one pass. Uniqueness is a count after values are dealt out, as nearly all differ and partial sums would hold them all to reduce nothing, and a reference an anti join with the values referred to; a table that isn't given can't be referred to, and its references
    aren't looked at.
    """
    found: list[DataFrame] = []
    for name, table in tables.items():
        rule = rules[name]
        wanted = {*rule.key, *rule.required, *rule.references, *(c for u in rule.unique for c in u)}
        own = table.withColumns({c: F.lit(None).cast("string") for c in sorted(wanted - set(table.columns))})
        say = lambda constraint: F.concat_ws(" ", *map(F.lit, constraint))
        broken = [F.when(F.col(c).isNull(), say(("not null", c))) for c in (*rule.key, *rule.required)] + [F.when(~check(), say(("check", c))) for c, check in rule.checks.items() if c in table.columns]
        rows = own.select(_named(rule.key).alias("key"), F.explode(F.array_compact(F.array(*broken))).alias("constraint"))
        found.append(rows.select(F.lit(name).alias("table"), "constraint", "key", F.lit(1).cast("long").alias("n")))
        for columns in (rule.key, *rule.unique):
            there = own.where(" and ".join(f"`{c}` is not null" for c in columns))
            many = spread(there.select(*columns), *columns).groupBy(*columns).agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
            found.append(many.select(F.lit(name), F.lit(f"unique {','.join(columns)}"), _named(columns), "n"))
        for column, (other, target) in rule.references.items():
            if other in tables:
                there = tables[other] if target in tables[other].columns else tables[other].withColumn(target, F.lit(None).cast(own.schema[column].dataType))
                values = there.select(F.col(target).alias(column))
                absent = own.where(F.col(column).isNotNull()).join(values, column, "left_anti")
                found.append(absent.select(F.lit(name), F.lit(f"foreign key {column}"), _named(rule.key), F.lit(1).cast("long")))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every


Rules = list[tuple[str, str, Callable[[Column], Column]]]


def nested_issues(df: DataFrame, root: dict[str, Column], rules: dict[str, Rules], keys: list[str]) -> DataFrame:
    """(keys, code, path): what a nested document breaks, and where, with positions from 0: clusters[3].articles[2].url.

    root: the arrays of a row, by name. rules: for each level, written clusters[] or clusters[].articles[], its (code, field, condition of an element that breaks it); the field "" is the element itself. Each array is
    opened once, its elements with their path; a level that has no rules but levels below is opened too. A null array has no elements; a null element is an element.
    """
    levels = sorted({".".join(level.split(".")[:i]) for level in rules for i in range(1, level.count(".") + 2)}, key=lambda x: (x.count("."), x))
    opened: dict[str, DataFrame] = {}
    found: list[DataFrame] = []
    for level in levels:
        above, _, name = level.rpartition(".")
        name = name.removesuffix("[]")
        if above:
            parent, items, path = opened[above], F.col("item")[name], F.concat(F.col("path"), F.lit(f".{name}["))
        else:
            parent, items, path = df, root[name], F.lit(f"{name}[")
        each = parent.select(*keys, path.alias("_path"), F.posexplode(items).alias("_at", "item"))
        opened[level] = each.select(*keys, F.concat("_path", F.col("_at").cast("string"), F.lit("]")).alias("path"), "item")
        if level in rules:
            said = [F.when(bad(F.col("item")), F.struct(F.lit(code).alias("code"), (F.concat(F.col("path"), F.lit(f".{of}")) if of else F.col("path")).alias("path"))) for code, of, bad in rules[level]]
            found.append(opened[level].select(*keys, F.explode(F.array_compact(F.array(*said))).alias("i")).select(*keys, "i.code", "i.path"))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every
