"""How prominently each region covers each story: raw counts next to shares, with their denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.functions.numbers import clamp
from coverscope.runtime import by_hash


def region_key(country: Column, admin1: Column, location_id: Column) -> Column:
    return F.coalesce(country, admin1, location_id)


def regional_prominence(articles: DataFrame, regions: DataFrame, in_order: bool = False) -> DataFrame:
    """(cluster_id, region, counts, shares, score) of each cluster in each of its regions.

    articles: cluster_id, outlet_id, a row for each article of a cluster. regions: cluster_id, region. The source-normalized share is the mean over all
    outlets of a region of how much of what they have there is this cluster: an outlet counts once, however much it writes.

    Articles are first counted by cluster and outlet, so what is joined and summed has a row for each outlet of a cluster. in_order: a cluster's shares of outlets are added one after another, least first, so
    that its score is the same to its last bit however rows come, for what is ranked by it.
    """
    outlets = articles.groupBy("cluster_id", "outlet_id").agg(F.count(F.lit(1)).alias("n"))
    regions = regions.select("cluster_id", "region").distinct()
    placed = outlets.join(regions, "cluster_id")
    by_outlet = placed.groupBy("region", "outlet_id").agg(F.sum("n").alias("outlet_articles"))
    corpus = by_outlet.groupBy("region").agg(F.sum("outlet_articles").alias("regional_articles"), F.count(F.lit(1)).alias("regional_outlets"))
    each = placed.join(by_hash(by_outlet), ["region", "outlet_id"]).withColumn("_share", F.col("n") / F.col("outlet_articles"))
    own = F.sum("_share")
    if in_order:  # shares are above 0, so the last sum is the greatest
        so_far = F.sum("_share").over(Window.partitionBy("cluster_id", "region").orderBy("_share").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        each, own = each.withColumn("_so_far", so_far), F.max("_so_far")
    shares = each.groupBy("cluster_id", "region").agg(F.sum("n").alias("article_count"), F.count(F.lit(1)).alias("outlet_count"), own.alias("_own"))
    out = shares.join(corpus, "region")
    article_share, source_share = F.col("article_count") / F.col("regional_articles"), F.col("_own") / F.col("regional_outlets")
    return out.select(
        "cluster_id", "region", "article_count", "outlet_count", "regional_articles", "regional_outlets",
        clamp(article_share).alias("article_share"), clamp(F.col("outlet_count") / F.col("regional_outlets")).alias("outlet_share"),
        clamp(source_share).alias("source_normalized_share"), clamp((article_share + source_share) / 2).alias("score"),
    )


def primary_prominence(prominence: DataFrame, primary: DataFrame) -> DataFrame:
    """(cluster_id, normalized_prominence): the score in the cluster's primary region, else its greatest."""
    joined = prominence.join(primary.select("cluster_id", F.col("region").alias("_primary")), "cluster_id", "left")
    return joined.groupBy("cluster_id").agg(F.coalesce(F.max(F.when(F.col("region") == F.col("_primary"), F.col("score"))), F.max("score"), F.lit(0.0)).alias("normalized_prominence"))


def current_formula(prominence: DataFrame, legacy_suffix: str = "legacy-components-unavailable") -> DataFrame:
    """Rows of the formula in use: those whose formula_version doesn't end as legacy ones do; a null is of the one in use."""
    return prominence.where(~F.coalesce(F.col("formula_version").endswith(legacy_suffix), F.lit(False)))
