"""What a story's sources disagree on, how they frame it, and which editorial markets cover it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STANCES = {"asserts": "supports", "denies": "disputes"}


def with_stance(claims: DataFrame) -> DataFrame:
    """Claims with the stance of their polarity."""
    return claims.withColumn("stance", F.when(F.col("polarity") == "asserts", "supports").when(F.col("polarity") == "denies", "disputes").otherwise("unclear"))


def claim_positions(articles: DataFrame, claims: DataFrame) -> DataFrame:
    """(article_id, claim_position): disputes before supports before unclear; reports without a claim."""
    found = claims.groupBy(F.col("evidence_article_id").alias("article_id")).agg(*[F.max(F.col("stance") == s).alias(s) for s in ("disputes", "supports", "unclear")])
    position = F.when(F.col("disputes"), "disputes").when(F.col("supports"), "supports").when(F.col("unclear"), "unclear").otherwise("reports")
    return articles.select("article_id").distinct().join(found, "article_id", "left").select("article_id", position.alias("claim_position"))


def framing(articles: DataFrame, claims: DataFrame) -> DataFrame:
    """(article_id, framing, confidence): the one stance of an article's claims, or mixed; the least confidence; nulls without a claim."""
    found = claims.groupBy(F.col("evidence_article_id").alias("article_id")).agg(F.collect_set("stance").alias("s"), F.min("confidence").alias("confidence"))
    value = F.when(F.size("s") > 1, "mixed").when(F.array_contains("s", "supports"), "supports").when(F.array_contains("s", "disputes"), "disputes").when(F.size("s") > 0, "unclear")
    return articles.select("article_id").distinct().join(found, "article_id", "left").select("article_id", value.alias("framing"), "confidence")


def conflicts(claims: DataFrame) -> DataFrame:
    """(cluster_id, status, confidence, normalized_claim, support_claim, dispute_claim) of each cluster with claims.

    claims: cluster_id, claim_id, normalized_claim, stance, confidence, network (of the article's publisher, null if the article is unknown). not_assessed below two
    networks; detected where networks support and dispute one claim: that of the surest claim, its surest support with a dispute of another network, and
    that network's surest dispute; else not_detected, with the least confidence.

    A claim's supports and disputes aren't paired: for each the surest dispute is kept, and the surest one of another network than that, which answer for
    a support of any network.
    """
    known = claims.where(F.col("network").isNotNull())
    networks = known.groupBy("cluster_id").agg(F.countDistinct("network").alias("networks"))
    keys = ["cluster_id", "normalized_claim"]
    order = F.struct((-F.col("confidence")).alias("c"), F.col("claim_id").alias("i"))
    ranked = claims.groupBy(*keys).agg(F.min(order).alias("claim_order"))
    by_network = known.where("stance = 'disputes'").groupBy(*keys, "network").agg(F.min(F.struct(order.alias("o"), "network", "confidence", "claim_id")).alias("d"))
    # The first dispute and the first of another network.
    best = by_network.groupBy(*keys).agg(F.min("d").alias("d1"))
    second = by_network.join(best, keys).where("d.network <> d1.network").groupBy(*keys).agg(F.min("d").alias("d2"))
    disputes = best.join(second, keys, "left")
    supports = known.where("stance = 'supports'").join(disputes, keys).withColumn("dispute", F.when(F.col("network") != F.col("d1.network"), F.col("d1")).otherwise(F.col("d2"))).where("dispute is not null")
    supports = supports.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), "claim_id", "confidence", "dispute")).alias("s"))
    first = supports.join(ranked, keys).groupBy("cluster_id").agg(F.min(F.struct("claim_order", "normalized_claim", "s")).alias("f"))
    every = claims.groupBy("cluster_id").agg(F.min("confidence").alias("least"))
    out = every.join(networks, "cluster_id", "left").join(first, "cluster_id", "left")
    few = F.coalesce("networks", F.lit(0)) < 2
    status = F.when(few, "not_assessed").when(F.col("f").isNotNull(), "detected").otherwise("not_detected")
    shown = lambda c: F.when(~few, c)
    return out.select(
        "cluster_id", status.alias("status"), F.when(few, None).when(F.col("f").isNotNull(), F.least("f.s.confidence", "f.s.dispute.confidence")).otherwise(F.col("least")).alias("confidence"),
        shown(F.col("f.normalized_claim")).alias("normalized_claim"), shown(F.col("f.s.claim_id")).alias("support_claim"), shown(F.col("f.s.dispute.claim_id")).alias("dispute_claim"),
    )


def omission() -> dict[str, object]:
    """Omission is never inferred: there is no baseline to infer it from."""
    return {"status": "not_assessed", "confidence": None, "method": "unavailable", "evidence": [], "reason": "No evidence-backed editorial-market baseline is available."}


def market_heat(sources: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, market, label, raw_article_count, unique_outlet_count, source_normalized_share, latitude, longitude) of each editorial market.

    sources: keys, article_id, domain, market, label, latitude, longitude, confidence. An article counts for one market: the surest, then the least. The share
    is the mean over all outlets of how much of what each has is in the market. Coordinates are those of the surest source, then of the least article.
    Markets go by share, greatest first, then by name.
    """
    keys = keys or []
    fields = F.struct("market", "label", "latitude", "longitude", "confidence", "domain")
    one = sources.where(F.col("market").isNotNull()).groupBy(*keys, "article_id").agg(F.min_by(fields, F.struct((-F.col("confidence")).alias("c"), "market")).alias("s")).select(*keys, "article_id", "s.*")
    place = F.struct((-F.col("confidence")).alias("c"), "article_id")
    by = one.groupBy(*keys, "market", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("article_id", "label")).alias("first"), F.min(F.when(F.col("latitude").isNotNull(), F.struct(place.alias("o"), "latitude", "longitude"))).alias("at")
    )
    totals = by.groupBy(*keys, "domain").agg(F.sum("n").alias("total"))
    outlets = totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("outlets"))
    joined = by.join(totals, [*keys, "domain"])
    shares = joined.groupBy(*keys, "market").agg(
        F.sum("n").alias("raw_article_count"), F.count(F.lit(1)).alias("unique_outlet_count"), F.sum(F.col("n") / F.col("total")).alias("_s"), F.min("first").alias("first"), F.min("at").alias("at")
    )
    out = shares.join(outlets, keys) if keys else shares.crossJoin(outlets)  # one row
    out = out.select(*keys, "market", F.col("first.label").alias("label"), "raw_article_count", "unique_outlet_count", (F.col("_s") / F.col("outlets")).alias("source_normalized_share"), F.col("at.latitude").alias("latitude"), F.col("at.longitude").alias("longitude"))
    return out.orderBy(*keys, F.col("source_normalized_share").desc(), "market")


def heat_points(markets: DataFrame, sources: DataFrame) -> DataFrame:
    """Markets that a source backs with the same place, as points of a map."""
    backed = sources.where(F.col("market").isNotNull() & F.col("latitude").isNotNull()).select("market", "latitude", "longitude").distinct()
    return markets.where(F.col("latitude").isNotNull()).join(backed, ["market", "latitude", "longitude"], "left_semi")


def _placed(clusters: DataFrame, locations: DataFrame) -> DataFrame:
    """Each cluster once in each of its regions, by its best location there."""
    best = F.struct((-F.col("confidence")).alias("c"), (-F.col("evidence_count")).alias("e"), F.col("location_id").alias("i"))
    one = locations.groupBy("cluster_id", "region").agg(F.min(F.struct(best.alias("o"), "label", "latitude", "longitude", "confidence")).alias("l"))
    return one.join(clusters.select("cluster_id", "raw", "normalized"), "cluster_id")


def region_rollup(clusters: DataFrame, locations: DataFrame, articles: DataFrame) -> DataFrame:
    """(region, label, latitude, longitude, raw_prominence, normalized_prominence, story_count, source_count) of each region; region_stories has its stories.

    clusters: cluster_id, raw, normalized. locations: cluster_id, region, location_id, label, latitude, longitude, confidence, evidence_count. articles: cluster_id, domain. A cluster
    counts once in a region, by its best location there.
    """
    placed = _placed(clusters, locations)
    outlets = placed.select("cluster_id", "region").join(articles.select("cluster_id", "domain").distinct(), "cluster_id").groupBy("region").agg(F.countDistinct("domain").alias("source_count"))
    rolled = placed.groupBy("region").agg(
        F.min_by(F.col("l"), F.struct((-F.col("l.confidence")).alias("c"), "cluster_id")).alias("l"), F.sum("raw").alias("raw_prominence"), F.max("normalized").alias("normalized_prominence"), F.count(F.lit(1)).alias("story_count"),
    )
    return rolled.join(outlets, "region", "left").select("region", F.col("l.label").alias("label"), F.col("l.latitude").alias("latitude"), F.col("l.longitude").alias("longitude"), "raw_prominence", "normalized_prominence", "story_count", F.coalesce("source_count", F.lit(0)).alias("source_count"))


def region_stories(clusters: DataFrame, locations: DataFrame) -> DataFrame:
    """(region, rank, cluster_id, normalized, raw): the stories of each region, greatest first. Rows as for region_rollup; a region's are sorted, never gathered into one."""
    order = [F.col("normalized").desc(), F.col("raw").desc(), F.col("cluster_id").desc()]
    return _placed(clusters, locations).select("region", F.row_number().over(Window.partitionBy("region").orderBy(*order)).alias("rank"), "cluster_id", "normalized", "raw")
