"""The given tables as coverage tables: orders as events, line items as mentions, parts as documents, suppliers as outlets, customers' nations as places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope.functions import text as X
from coverscope.functions import urls as U


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order with the nation of its customer as its place."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "n_regionkey")
    own = orders.join(placed, F.col("o_custkey") == F.col("c_custkey"), "left")
    geo = F.when(F.col("n_name").isNotNull(), F.struct(F.lit(1).alias("type"), F.col("n_name").alias("full_name"), F.col("n_name").alias("country_code")))
    return own.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ord"), F.col("o_orderdate").alias("date_added"), F.col("n_name").alias("region"), "n_regionkey", geo.alias("geo"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item: type 1 unless its flag is N, of the raw text if its status is F, sure to twice its quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("identifier"), F.when(F.col("l_returnflag") != "N", 1).otherwise(2).alias("mention_type"), (F.col("l_linestatus") == "F").alias("in_raw_text"),
        (F.col("l_quantity") * 2).alias("confidence"), F.col("l_shipdate").alias("mention_time"), F.col("l_suppkey").alias("outlet_id"), F.struct("l_suppkey", "l_linenumber").alias("ord"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of size 40 or less; those of Brand#1 have no title."""
    own = table(spark, sf_dir, "part").where("p_size <= 40")
    return own.select(F.col("p_partkey").alias("document_id"), F.when(F.col("p_brand") != "Brand#1", F.col("p_name")).alias("title"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a claim on its part in its order's story: R disputes, A supports, N is unclear; the network is the supplier's nation."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("network"))
    own = table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey", "left")
    stance = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "disputes").otherwise("unclear")
    name = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")
    return own.select(
        F.col("l_orderkey").alias("cluster_id"), name.alias("claim_id"), F.col("l_partkey").alias("normalized_claim"), stance.alias("stance"), F.round(1 - F.col("l_discount"), 6).alias("confidence"), "network",
        F.concat_ws(":", "l_orderkey", "l_suppkey").alias("evidence_article_id"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as an article: its title element, URL and domain."""
    own = table(spark, sf_dir, "pages")
    return own.select("page_id", "url", X.page_title(F.col("html"), "title").alias("title"), U.canonical_url(F.col("url")).alias("canonical_url"), U.domain(F.col("url")).alias("domain"))
