"""Merging clusters that are one story: an equal headline, and an equal place or document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverscope.functions.text import collated, headline_key, headline_words, not_ascii
from coverscope.operators.components import LOCAL_LINKS, connected_components
from coverscope.runtime import by_hash, first_by, settle


def evidence_keys(clusters: DataFrame, articles: DataFrame, locations: DataFrame) -> DataFrame:
    """(cluster_id, key): a headline with the primary location, and with each canonical URL. A title alone is no evidence.

    clusters: cluster_id, title. articles: cluster_id, canonical_url. locations: cluster_id, location_key, the primary ones.
    """
    # Only titles that Python may change go there, and where there are none its workers aren't started.
    title, other = F.col("title"), not_ascii(F.col("title"))
    titled, rest = clusters.where(~other).select("cluster_id", headline_words(title).alias("t")), clusters.where(other)
    if not rest.isEmpty():
        titled = titled.unionAll(rest.select("cluster_id", headline_key(title).alias("t")))
    titled = titled.where("t <> ''")
    by_place = titled.join(locations.select("cluster_id", "location_key"), "cluster_id").select("cluster_id", F.concat_ws("|", F.lit("location"), "t", "location_key").alias("key"))
    by_document = titled.join(articles.where("canonical_url <> ''").select("cluster_id", "canonical_url"), "cluster_id").select("cluster_id", F.concat_ws("|", F.lit("document"), "t", "canonical_url").alias("key"))
    return by_place.unionAll(by_document).distinct()


def merged_ids(clusters: DataFrame, articles: DataFrame, locations: DataFrame) -> DataFrame:
    """(cluster_id, merged_id): each cluster with the least id of those that share evidence with it, directly or through others.

    A cluster first goes by the least one of those at its place under its headline, so what is left to link are places, not clusters: their number follows
    that of headlines and places, however many clusters each has. All that go by one are linked with it by their key, and of a key all that its clusters go by
    are linked with the least, so a key of many gives as many links as it has, not pairs, and no link is lost where a cluster has several places.
    """
    clusters = settle(clusters.select("cluster_id", "title"))
    keys = settle(evidence_keys(clusters, articles, locations))
    placed = keys.where(F.col("key").startswith("location|"))
    least = placed.groupBy("key").agg(F.min("cluster_id").alias("v"))
    by = settle(placed.join(by_hash(least), "key").groupBy("cluster_id").agg(F.min("v").alias("v")))
    held = keys.join(by_hash(by), "cluster_id", "left").select(F.coalesce("v", "cluster_id").alias("u"), "key").distinct()
    least = held.groupBy("key").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = held.join(by_hash(least), "key").where("u <> v").select("u", "v")
    labels = connected_components(links, LOCAL_LINKS).select(F.col("node").alias("v"), F.col("label").alias("merged_id"))
    own = clusters.select("cluster_id").join(by_hash(by), "cluster_id", "left").withColumn("v", F.coalesce("v", "cluster_id"))
    return own.join(by_hash(labels), "v", "left").select("cluster_id", F.coalesce("merged_id", "v").alias("merged_id"))


def _renamed(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(by_hash(ids), "cluster_id").withColumn("source_cluster_id", F.col("cluster_id")).withColumn("cluster_id", F.col("merged_id")).drop("merged_id")


def merged_headers(clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """The least id, its title, the first and last times."""
    own = _renamed(clusters, ids)
    return own.groupBy("cluster_id").agg(F.min_by("title", "source_cluster_id").alias("title"), F.min("first_observed_at").alias("first_observed_at"), F.max("last_observed_at").alias("last_observed_at"), F.count(F.lit(1)).alias("merged_from"))


def distinct_articles(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Each article of a merged cluster once: the higher provider score, then the lesser URL."""
    own = _renamed(articles, ids)
    return first_by(own, ["cluster_id", "article_id"], [-F.coalesce("provider_score", F.lit(0.0)), collated(F.col("canonical_url")), F.col("source_cluster_id")])


def ranked(articles: DataFrame) -> DataFrame:
    """Articles of merged clusters with their rank."""
    score = F.coalesce("provider_score", F.lit(0.0))
    order = Window.partitionBy("cluster_id").orderBy(score.desc(), F.col("published_at").desc_nulls_last(), collated(F.col("canonical_url")), "canonical_url")
    return articles.withColumn("rank", F.row_number().over(order))


def merged_articles(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Each article of a merged cluster once, with its rank."""
    return ranked(distinct_articles(articles, ids))


def merged_memberships(memberships: DataFrame, ids: DataFrame) -> DataFrame:
    """Memberships by article: greatest confidence, least match and threshold, components of the surer one, all reasons in order.

    memberships: cluster_id, article_id, confidence, matched_article_id, threshold, components (any type), reasons (array).
    """
    own = _renamed(memberships, ids)
    n = F.count(F.lit(1))
    reasons = F.array_distinct(F.flatten(F.collect_list("reasons")))
    return own.groupBy("cluster_id", "article_id").agg(
        F.max("confidence").alias("confidence"), F.min("matched_article_id").alias("matched_article_id"), F.min("threshold").alias("threshold"),
        F.min_by("components", F.struct((-F.col("confidence")).alias("c"), "source_cluster_id")).alias("components"), F.when(n > 1, F.array_sort(reasons)).otherwise(F.first("reasons")).alias("reasons"),
    )


def merged_locations(locations: DataFrame, ids: DataFrame) -> DataFrame:
    """Locations by key: the surer one with all evidence; with its rank. locations: cluster_id, location_key, confidence, evidence (array), more."""
    own = _renamed(locations, ids)
    fields = [c for c in own.columns if c not in ("cluster_id", "location_key", "evidence", "confidence", "source_cluster_id")]
    out = own.groupBy("cluster_id", "location_key").agg(
        F.max("confidence").alias("confidence"), F.min_by(F.struct(*fields), F.struct((-F.col("confidence")).alias("c"), "source_cluster_id")).alias("b"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    )
    order = Window.partitionBy("cluster_id").orderBy(F.col("confidence").desc(), collated(F.col("location_key")), "location_key")
    return out.select("cluster_id", "location_key", "confidence", "evidence", *[F.col(f"b.{c}").alias(c) for c in fields]).withColumn("rank", F.row_number().over(order))


def merged_claims(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims by id, text and polarity: greatest confidence, all evidence. claims: cluster_id, claim_id, text, polarity, confidence, evidence (array)."""
    return _renamed(claims, ids).groupBy("cluster_id", "claim_id", "text", "polarity").agg(F.max("confidence").alias("confidence"), F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("evidence"))
