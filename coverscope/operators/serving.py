"""Story lists, story detail, health and the rolling-window view, as queries over the serving tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.functions.dates import age_seconds, window_start
from coverscope.operators import signals


@dataclass(frozen=True)
class StoryQuery:
    """Arguments of a story list, checked."""

    metric: str = "raw"
    region: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    limit: int = 20
    offset: int = 0

    def __post_init__(self) -> None:
        if self.metric not in ("raw", "normalized"):
            raise ValueError("metric must be raw or normalized")
        if self.region is not None and not re.fullmatch(r"[A-Z0-9_-]{2,16}", self.region):
            raise ValueError("region must be 2 to 16 of A-Z, 0-9, _ and -")
        if self.since and self.until and self.since > self.until:
            raise ValueError("since must not be after until")
        if not 1 <= self.limit <= 100 or self.offset < 0:
            raise ValueError("limit must be from 1 to 100, offset not negative")


def primary_locations(locations: DataFrame) -> DataFrame:
    """The event location of each cluster that is surest, then has most evidence, then the least id.

    locations: cluster_id, location_id, location_type, confidence, evidence_count, more.
    """
    fields = [c for c in locations.columns if c != "cluster_id"]
    order = F.struct((-F.col("confidence")).alias("a"), (-F.col("evidence_count")).alias("b"), F.col("location_id").alias("c"))
    best = locations.where("location_type = 'event'").groupBy("cluster_id").agg(F.min_by(F.struct(*fields), order).alias("l"))
    return best.select("cluster_id", *[F.col(f"l.{c}").alias(c) for c in fields])


def with_primary_flag(locations: DataFrame) -> DataFrame:
    primary = primary_locations(locations).select("cluster_id", "location_id", F.lit(True).alias("is_primary"))
    return locations.join(primary, ["cluster_id", "location_id"], "left").withColumn("is_primary", F.coalesce("is_primary", F.lit(False)))


def _ranked(clusters: DataFrame, metric: str) -> list[Column]:
    return [F.col("raw_article_count" if metric == "raw" else "normalized_prominence").desc(), F.col("last_observed_at").desc(), F.col("cluster_id").asc()]


def list_stories(clusters: DataFrame, locations: DataFrame, query: StoryQuery = StoryQuery(), evidence: DataFrame | None = None) -> DataFrame:
    """The stories of a query with their primary locations: those with an evidenced event location in the region, observed within the times, by the metric."""
    own = clusters
    if query.region is not None:
        there = locations.where((F.col("location_type") == "event") & (F.col("region_code") == query.region))
        if evidence is not None:
            there = there.join(evidence.select("location_id").distinct(), "location_id", "left_semi")
        own = own.join(there.select("cluster_id").distinct(), "cluster_id", "left_semi")
    if query.since is not None:
        own = own.where(F.col("last_observed_at") >= F.lit(query.since))
    if query.until is not None:
        own = own.where(F.col("first_observed_at") <= F.lit(query.until))
    page = own.orderBy(*_ranked(own, query.metric)).offset(query.offset).limit(query.limit)
    primary = primary_locations(locations).select("cluster_id", *[F.col(c).alias(f"primary_{c}") for c in locations.columns if c not in ("cluster_id", "location_type")])
    return page.join(primary, "cluster_id", "left")


def story_details(clusters: DataFrame, articles: DataFrame, locations: DataFrame, claims: DataFrame, prominence: DataFrame) -> DataFrame:
    """Each cluster with its articles (latest first), locations (by type, then confidence; no audience regions), claims and prominence (greatest first), as arrays of rows.

    A cluster's children are gathered by id; a story has as many as it has articles.
    """
    out = clusters.join(primary_locations(locations).select("cluster_id", F.col("location_id").alias("primary_location_id")), "cluster_id", "left")
    shown = locations.where("location_type <> 'audience_region'")
    negative = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    parts = (
        ("articles", articles, [F.coalesce(negative("published_at"), F.lit(0).cast("long")), F.col("article_id")]),
        ("locations", shown, [F.col("location_type"), -F.col("confidence"), F.col("location_id")]),
        ("claims", claims, [-F.col("confidence"), F.col("claim_id")]),
        ("regional_prominence", prominence, [-F.col("score"), F.col("region")]),
    )
    for name, rows, order in parts:
        fields = [c for c in rows.columns if c != "cluster_id"]
        item = F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*fields).alias("row"))
        nested = rows.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]).alias(name))
        empty = F.array().cast(nested.schema[name].dataType)
        out = out.join(nested, "cluster_id", "left").withColumn(name, F.coalesce(name, empty))
    return out


def health(clusters: DataFrame, articles: DataFrame, runs: DataFrame, now: Column, stale_after_seconds: int = 1800) -> DataFrame:
    """One row: how fresh the store is, what the last day brought, and whether that is ok, degraded (and why) or unavailable."""
    since = now - F.expr("interval 24 hours")
    a = clusters.agg(F.max("last_observed_at").alias("latest_story_at"), F.count_if(F.col("last_observed_at") >= since).alias("cluster_count_24h"))
    b = articles.agg(F.count_if(F.col("published_at") >= since).alias("article_count_24h"))
    recent = F.col("started_at") >= since
    c = runs.agg(
        F.count_if((F.col("status") == "failed") & recent).alias("failures_24h"), F.countDistinct(F.when(F.col("status").isin("succeeded", "degraded") & recent, F.col("source"))).alias("active_source_count"),
        F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("latest_run"),
    )
    one = a.crossJoin(b).crossJoin(c)  # one row each
    one = one.withColumn("freshness_age_seconds", age_seconds(F.col("latest_story_at"), now))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("freshness_age_seconds") > stale_after_seconds, "latest story is stale"),
            F.when(F.col("latest_run.status") == "failed", "latest pipeline run failed"),
            F.when(F.col("latest_run.status") == "degraded", "latest pipeline run was degraded"),
        )
    )
    one = one.withColumn("reasons", reasons)
    status = F.when(F.col("latest_story_at").isNull(), "unavailable").when(F.size("reasons") > 0, "degraded").otherwise("ok")
    return one.select(status.alias("status"), "latest_story_at", "freshness_age_seconds", "cluster_count_24h", "article_count_24h", "failures_24h", "active_source_count", F.col("latest_run.run_id").alias("latest_run_id"), F.col("latest_run.status").alias("latest_run_status"), "reasons")


def shown_health(health_row: DataFrame, region_count: Column, omitted: Column, repeated: Column) -> DataFrame:
    """Health as the explorer shows it, with what the view left out."""
    more = F.array_compact(F.array(F.when(omitted > 0, F.concat(omitted.cast("string"), F.lit(" cluster(s) omitted without cited event locations"))), F.when(repeated > 0, F.concat(repeated.cast("string"), F.lit(" duplicate cluster summary row(s) collapsed by cluster id")))))
    status = F.when(F.col("status") == "ok", "healthy").when(F.col("status") == "unavailable", "stale").otherwise("degraded")
    message = F.nullif(F.array_join(F.concat("reasons", more), "; "), F.lit(""))
    return health_row.select(status.alias("status"), "latest_story_at", "freshness_age_seconds", "active_source_count", region_count.alias("region_count"), message.alias("message"))


def shown_locations(locations: DataFrame) -> DataFrame:
    """Locations as the explorer shows them: evidenced event locations with a region and a type."""
    kind = F.when(F.col("granularity") == "region", "multi-region").when(F.col("granularity") == "point", "unknown").otherwise(F.col("granularity"))
    own = locations.where("location_type = 'event' and evidence_article_id is not null")
    return with_primary_flag(own).withColumn("location_kind", kind).withColumn("region", F.coalesce("region_code", "country_code", "location_id"))


def intelligence(clusters: DataFrame, locations: DataFrame, articles: DataFrame, window: str, now: datetime, metric: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(stories, regions) of a rolling window: clusters observed within it that have an evidenced event location, and the rollup of their regions. No cap."""
    recent = clusters.where((F.col("last_observed_at") >= F.lit(window_start(window, now))) & (F.col("first_observed_at") <= F.lit(now))).dropDuplicates(["cluster_id"])
    shown = shown_locations(locations)
    primary = shown.where("is_primary").select("cluster_id", F.col("region").alias("primary_region"))
    stories = recent.join(primary, "cluster_id")
    per = articles.groupBy("cluster_id").agg(F.countDistinct("domain").alias("outlet_count"), F.countDistinct("language").alias("language_count"), F.avg("membership_confidence").alias("membership_confidence"))
    stories = stories.join(per, "cluster_id", "left")
    regions = signals.region_rollup(stories.select("cluster_id", F.col("raw_article_count").alias("raw"), F.col("normalized_prominence").alias("normalized")), shown.join(stories.select("cluster_id"), "cluster_id", "left_semi"), articles)
    return stories, regions.orderBy(F.col("raw_prominence" if metric == "raw" else "normalized_prominence").desc(), "region")


def search(stories: DataFrame, text: str) -> DataFrame:
    """Stories whose title, summary, locations, publishers or domains hold a text, whatever its case. Arrays: labels, publishers, domains."""
    part = F.lower(F.lit(text.strip()))
    anywhere = F.lower(F.concat_ws("\n", "title", "summary")).contains(part)
    for column in ("labels", "publishers", "domains"):
        anywhere = anywhere | F.exists(column, lambda x: F.lower(x).contains(part))
    return stories.where(F.coalesce(anywhere, F.lit(False)))


def within_region(stories: DataFrame, region: str) -> DataFrame:
    """Stories with any location in a region. Array: regions."""
    return stories.where(F.array_contains("regions", region))


def duplicate_rows(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    """One row: rows beyond the first of each key."""
    return df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicates"))
