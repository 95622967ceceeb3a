"""From the three tables of a batch to stories with places and prominence, and from those to the serving tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverscope.functions import text as X
from coverscope.operators import gates, merge, prominence
from coverscope.operators.serving import primary_locations
from coverscope.runtime import first_by, settle
from coverscope.schemas import RUNS, Gates, Limits
from coverscope.sources.articles import joined_articles


@dataclass
class Snapshot:
    """Tables of one batch; each a DataFrame."""

    clusters: DataFrame
    articles: DataFrame
    locations: DataFrame
    prominence: DataFrame
    statistics: DataFrame


def location_type(code: Column) -> Column:
    return F.when(code == 1, "country").when(code.isin(2, 5), "admin1").when(code.isin(3, 4), "city").otherwise("point")


def ranked_articles(joined: DataFrame, retrieved_at: Column, most: int) -> DataFrame:
    """The articles of each event, surest first, then latest, then as they came; one for each canonical URL; `most` at most, the batch's own limit."""
    own = joined_articles(joined, retrieved_at)
    order = [-F.col("confidence"), -F.unix_micros(F.col("mention_time").cast("timestamp")), F.col("key_ord")]
    one = first_by(own, ["event_id", "canonical_url"], order)
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(*order))
    return one.withColumn("rank", rank).where(F.col("rank") <= most)


def provisional(articles: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, cluster articles, locations): a cluster for each event with articles, titled as its first, at the event's place with all its articles as evidence."""
    name = F.concat(F.lit("event_"), F.col("event_id"))
    own = articles.withColumn("cluster_id", name)
    clusters = own.groupBy("cluster_id", "event_id").agg(F.min_by("title", "rank").alias("title"), F.min("mention_time").alias("first_observed_at"), F.max("mention_time").alias("last_observed_at"), F.least(F.lit(1.0), F.avg("provider_score")).alias("confidence"))
    evidence = own.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("article_id", "url", F.lit("").alias("quote"), F.lit("provider_event_geotag").alias("method")))).alias("evidence"))
    geo = gates.last_of_event(events).where("geo is not null").select("event_id", "geo.*")
    fixed = lambda c: F.format_string("%.5f", F.round(c, 5))
    located = clusters.select("cluster_id", "event_id", "confidence").join(geo, "event_id").join(evidence, "event_id")
    locations = located.select(
        "cluster_id", X.stable_id("location", F.coalesce("feature_id", F.concat_ws("|", "full_name", fixed("latitude"), fixed("longitude")))).alias("location_id"), location_type(F.col("type")).alias("kind"), F.col("full_name").alias("name"),
        F.col("country_code").alias("country"), F.col("adm1_code").alias("admin1"), "latitude", "longitude", "confidence",
        F.transform("evidence", lambda e: e.withField("quote", F.concat(F.lit("Event place: "), F.col("full_name")))).alias("evidence"),
    )
    locations = locations.withColumn("location_key", X.location_key(F.col("kind"), F.col("country"), F.col("admin1"), F.col("name"), F.col("latitude"), F.col("longitude")))
    return clusters.drop("event_id", "confidence"), own.drop("event_id"), locations


def ranked_clusters(headers: DataFrame, articles: DataFrame, most: int) -> DataFrame:
    """The clusters of most outlets, then articles, then latest; `most` at most, the batch's own limit."""
    size = articles.groupBy("cluster_id").agg(F.countDistinct("outlet_id").alias("outlet_count"), F.count(F.lit(1)).alias("article_count"))
    return headers.join(size, "cluster_id").orderBy(F.col("outlet_count").desc(), F.col("article_count").desc(), F.col("last_observed_at").desc(), "cluster_id").limit(most)


def assembled(clusters: DataFrame, articles: DataFrame, locations: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clusters, articles, locations, prominence) after merging duplicates, ranking, the cap, and prominence over what the cap leaves."""
    ids = settle(merge.merged_ids(clusters, articles, locations))
    headers, own, places = merge.merged_headers(clusters, ids), settle(merge.distinct_articles(articles, ids)), merge.merged_locations(locations, ids)
    kept = settle(ranked_clusters(headers, own, most))
    own, places = merge.ranked(own.join(kept.select("cluster_id"), "cluster_id", "left_semi")), places.join(kept.select("cluster_id"), "cluster_id", "left_semi")
    regions = places.select("cluster_id", prominence.region_key(F.col("country"), F.col("admin1"), F.col("location_id")).alias("region"))
    return kept, own, places, prominence.regional_prominence(own, regions)


def build(events: DataFrame, mentions: DataFrame, documents: DataFrame, retrieved_at: Column, rules: Gates = Gates(), limits: Limits = Limits()) -> Snapshot:
    """The stories of a batch. events, mentions, documents: columns of schemas, parsed and valid."""
    eligible = settle(gates.eligible_mentions(mentions, events, rules))
    joined = settle(gates.joined_documents(eligible, gates.folded_documents(gates.needed_documents(documents, eligible), rules)))
    articles = settle(ranked_articles(joined, retrieved_at, limits.articles_per_cluster))
    clusters, own, locations = provisional(articles, events)
    kept, own, places, shares = assembled(clusters, own, locations, limits.clusters)
    before = clusters.agg(F.count(F.lit(1)).alias("clusters_provisional"))
    after = kept.agg(F.count(F.lit(1)).alias("clusters_emitted"), F.sum("article_count").alias("articles_emitted"))
    statistics = gates.gate_counters(joined).crossJoin(before).crossJoin(after)  # one row each
    return Snapshot(kept, own, places, shares, statistics)


def composed(snapshots: list[Snapshot], most: int, include: list[str] | None = None) -> Snapshot:
    """Several snapshots as one: their clusters together, merged again, with prominence over all of them."""
    union = lambda name: settle(_union([getattr(s, name) for s in snapshots]))
    clusters, articles, locations = union("clusters"), union("articles"), union("locations")
    if include:
        clusters = clusters.where(F.col("cluster_id").isin(*include))
        articles, locations = (x.join(clusters.select("cluster_id"), "cluster_id", "left_semi") for x in (articles, locations))
    header = clusters.select("cluster_id", "title", "first_observed_at", "last_observed_at")
    kept, own, places, shares = assembled(header, articles, locations, most)
    return Snapshot(kept, own, places, shares, _union([s.statistics for s in snapshots]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def serving_tables(snapshot: Snapshot, run_id: str, memberships: DataFrame | None = None) -> dict[str, DataFrame]:
    """The snapshot's serving tables, their ids under the run's name: clusters, articles, locations, evidence, prominence."""
    named = lambda c: F.concat(F.lit(f"{run_id}:"), F.col(c))
    child = lambda c: F.concat(F.lit(f"{run_id}:"), F.col("cluster_id"), F.lit(":"), F.col(c))
    run = F.lit(run_id).alias("run_id")
    places = snapshot.locations.withColumn("region_code", prominence.region_key(F.col("country"), F.col("admin1"), F.col("location_id")))
    confidence = (memberships if memberships is not None else snapshot.articles.select("cluster_id", F.col("provider_score").alias("confidence"))).groupBy("cluster_id").agg(F.avg("confidence").alias("cluster_confidence"))
    counted = places.select("*", F.lit("event").alias("location_type"), F.size("evidence").alias("evidence_count"))
    primary = primary_locations(counted).select("cluster_id", F.col("region_code").alias("region"))
    shares = snapshot.prominence
    clusters = snapshot.clusters.join(prominence.primary_prominence(shares, primary), "cluster_id", "left").join(confidence, "cluster_id", "left").join(primary, "cluster_id", "left")
    fingerprint = X.stable_id("content", F.concat_ws("|", "canonical_url", "title", F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")), "domain"))
    quotes = places.select("cluster_id", "location_id", "rank", F.explode("evidence").alias("e"))
    snippet = quotes.groupBy("cluster_id", F.col("e.article_id").alias("article_id")).agg(F.min_by("e.quote", "rank").alias("quote"))
    articles = snapshot.articles.join(snippet, ["cluster_id", "article_id"], "left")
    index = F.row_number().over(Window.partitionBy("cluster_id", "location_id").orderBy("e.article_id", "e.url", "e.quote")) - 1
    return {
        "story_clusters": clusters.select(run, named("cluster_id").alias("cluster_id"), "title", F.col("region").alias("primary_region_code"), "first_observed_at", "last_observed_at", F.col("article_count").alias("raw_article_count"), F.col("outlet_count").alias("unique_publisher_count"), F.coalesce("normalized_prominence", F.lit(0.0)).alias("normalized_prominence"), F.coalesce("cluster_confidence", F.lit(0.0)).alias("cluster_confidence")),
        "articles": articles.select(run, child("article_id").alias("article_id"), named("cluster_id").alias("cluster_id"), "canonical_url", "url", "title", "publisher_name", "domain", "language", "published_at", "retrieved_at", F.coalesce("quote", F.substring(X.optional(F.col("summary")), 1, 1200)).alias("evidence_snippet"), F.col("provider_score").alias("membership_confidence"), fingerprint.alias("content_fingerprint")),
        "story_locations": counted.select(run, child("location_id").alias("location_id"), named("cluster_id").alias("cluster_id"), "location_type", F.col("kind").alias("granularity"), F.col("name").alias("label"), "latitude", "longitude", F.col("country").alias("country_code"), "region_code", "confidence", "evidence_count"),
        "story_location_evidence": quotes.withColumn("i", index).select(run, F.concat(child("location_id"), F.lit(":evidence:"), F.col("i")).alias("location_evidence_id"), child("location_id").alias("location_id"), F.concat(F.lit(f"{run_id}:"), F.col("cluster_id"), F.lit(":"), F.col("e.article_id")).alias("article_id"), F.col("e.url").alias("source_url"), F.col("e.quote").alias("evidence_quote"), F.col("e.method").alias("evidence_method")),
        "regional_prominence": shares.select(run, named("cluster_id").alias("cluster_id"), F.col("region").alias("region_code"), F.col("article_count").alias("raw_article_count"), F.col("outlet_count").alias("unique_outlet_count"), F.col("regional_articles").alias("regional_source_volume"), F.col("regional_outlets").alias("regional_outlet_count"), F.col("score").alias("normalized_score"), "article_share", "outlet_share", "source_normalized_share", F.lit("event_location").alias("basis")),
    }


def run_record(spark: SparkSession, run_id: str, batch_id: str, md5s: dict[str, str], clusters: DataFrame, tables: dict[str, DataFrame], started_at: Column, completed_at: Column, seen: dict[str, int], healthy: bool = True) -> DataFrame:
    """The run of a batch, with the columns of schemas.RUNS: a fingerprint of what went in and came out (as many ids as the cap of clusters), rows seen, and rows of all serving tables."""
    counted = None
    for table in tables.values():
        one = table.agg(F.count(F.lit(1)).alias("n"))
        counted = one if counted is None else counted.unionAll(one)
    upserted = counted.agg(F.sum("n").alias("records_upserted"))  # a row for each table
    ids = clusters.agg(F.array_sort(F.collect_set("cluster_id")).alias("ids"))
    body = F.to_json(F.struct(F.lit(batch_id).alias("batch"), F.array(*[F.lit(md5s[k]) for k in sorted(md5s)]).alias("files"), F.col("ids").alias("clusters")))
    watermark = F.to_timestamp(F.lit(batch_id), "yyyyMMddHHmmss")
    none = F.lit(None).cast("string")
    own = ids.crossJoin(upserted).select(  # one row each
        F.lit(run_id).alias("run_id"), F.lit("batch").alias("source"), F.lit("succeeded" if healthy else "degraded").alias("status"), F.concat(F.lit(batch_id + ":"), X.stable_id("snapshot", body)).alias("input_fingerprint"), started_at.cast("timestamp").alias("started_at"),
        completed_at.cast("timestamp").alias("completed_at"), watermark.alias("source_watermark_at"), F.lit(sum(seen.values())).cast("long").alias("records_seen"), F.coalesce("records_upserted", F.lit(0)).cast("long").alias("records_upserted"), none.alias("error_kind"),
        none.alias("error_message"), F.lit(False).alias("retryable"), none.alias("receipt"), completed_at.cast("timestamp").alias("updated_at"),
    )
    return spark.createDataFrame([], RUNS).unionByName(own)
