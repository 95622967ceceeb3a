"""From search answers to clusters with places, and the one story that stands for a window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.operators import clustering, geocode, prominence, validate
from coverscope.runtime import settle
from coverscope.sources.articles import unique_articles


@dataclass
class Result:
    articles: DataFrame
    memberships: DataFrame
    clusters: DataFrame
    locations: DataFrame
    evidence: DataFrame
    prominence: DataFrame


def _texts(articles: DataFrame) -> DataFrame:
    fields = F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("summary").alias("field"), F.col("summary").alias("text")))
    return articles.select("article_id", "outlet_id", "url", F.inline(fields)).where("text is not null")


def run(articles: DataFrame, aliases: DataFrame, threshold: float = clustering.THRESHOLD) -> Result:
    """Clusters of articles, each with the places its own articles name, and their prominence.

    articles: columns of schemas.ARTICLES and ord. aliases: alias, place_id, name, kind, country, admin1, latitude, longitude. Places are found once; those of all articles help to
    cluster them, and those of each cluster's are its own.
    """
    own = settle(unique_articles(articles))
    matches = settle(geocode.located_matches(geocode.gazetteer_matches(_texts(own), aliases)))
    at = matches.groupBy("article_id").agg(F.collect_set("place_id").alias("location_ids"))
    placed = own.join(at, "article_id", "left").withColumn("location_ids", F.coalesce("location_ids", F.array().cast("array<string>")))
    members = settle(clustering.clusters_of(placed, threshold))
    full = members.join(own, "article_id")
    seen = F.coalesce("published_at", "retrieved_at")
    clusters = full.groupBy("cluster_id").agg(F.min_by("title", F.struct(~F.col("is_canonical"), "position")).alias("title"), F.min(seen).alias("first_observed_at"), F.max(seen).alias("last_observed_at"), F.count(F.lit(1)).alias("article_count"), F.countDistinct("outlet_id").alias("outlet_count"))
    evidence = geocode.place_evidence(matches.join(members.select("article_id", "cluster_id"), "article_id"), ["cluster_id"])
    places = geocode.event_locations(evidence, ["cluster_id"])
    known = aliases.select("place_id", "name", "kind", "country", "admin1", "latitude", "longitude").dropDuplicates(["place_id"])
    places = places.join(known, "place_id").withColumn("region", prominence.region_key(F.col("country"), F.col("admin1"), F.col("place_id")))
    shares = prominence.regional_prominence(full.select("cluster_id", "outlet_id"), places.select("cluster_id", "region"))
    return Result(own, members, clusters, places, evidence, shares)


def truth_slice(result: Result, start: Column, end: Column) -> DataFrame:
    """One row: the outcome (ok, or the first reason there is none) and the cluster of most outlets, then articles, that passes all checks."""
    issues = validate.slice_issues(result.clusters, result.memberships.join(result.articles, "article_id"), result.locations, start, end)
    full = result.memberships.join(result.articles, "article_id")
    at = F.coalesce("published_at", "retrieved_at")
    current = full.where(at.between(start, end)).select("cluster_id", F.lit(True).alias("current")).distinct()
    placed = result.locations.select("cluster_id", F.lit(True).alias("placed")).distinct()
    bad = issues.select("cluster_id", F.lit(True).alias("bad")).distinct()
    own = result.clusters.join(current, "cluster_id", "left").join(placed, "cluster_id", "left").join(bad, "cluster_id", "left")
    is_current, is_placed = F.coalesce("current", F.lit(False)), F.coalesce("placed", F.lit(False))
    many = F.col("outlet_count") >= 2
    order = F.struct((-F.col("outlet_count")).alias("a"), (-F.col("article_count")).alias("b"), F.col("cluster_id").alias("c"))
    good = is_current & is_placed & many & F.col("bad").isNull()
    counts = own.agg(
        F.count_if(is_current).alias("current"), F.count_if(is_current & is_placed).alias("placed"), F.count_if(is_current & is_placed & many).alias("many"), F.min_by(F.when(good, F.col("cluster_id")), F.when(good, order)).alias("cluster_id"),
    )
    articles = result.articles.agg(F.count(F.lit(1)).alias("articles"))
    reason = (
        F.when(F.col("articles") == 0, "no_articles").when(F.col("current") == 0, "no_current_cluster").when(F.col("placed") == 0, "no_geolocated_cluster").when(F.col("many") == 0, "no_multi_outlet_cluster").when(F.col("cluster_id").isNull(), "invalid_cluster").otherwise("ok")
    )
    return articles.crossJoin(counts).select(reason.alias("outcome"), "cluster_id")  # one row each
