"""Outlets whose origin and editorial market are documented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope.functions.urls import normalized_domain

# Domain, origin (country, code, confidence), market (code, label, latitude, longitude, confidence).
PROFILES = (
    ("albuquerqueexpress.com", "Australia", "AU", 0.96, "US-NM-ABQ", "Albuquerque metropolitan area, New Mexico", 35.0844, -106.6504, 0.99),
    ("australiannews.net", "United Arab Emirates", "AE", 0.82, "AU", "Australia", -25.2744, 133.7751, 0.94),
    ("1075theriver.iheart.com", "United States", "US", 0.96, "US-TN-NASHVILLE", "Nashville, Tennessee", 36.1627, -86.7816, 0.97),
    ("993thebeat.iheart.com", "United States", "US", 0.96, "US-FL-PANAMA-CITY", "Panama City and the Florida Gulf Coast", 30.1588, -85.6602, 0.97),
    ("hot1079.iheart.com", "United States", "US", 0.96, "US-NY-SYRACUSE", "Syracuse, New York", 43.0481, -76.1474, 0.97),
    ("kiss959fm.iheart.com", "United States", "US", 0.96, "US-DELMARVA", "Delmarva", 38.3607, -75.5994, 0.97),
    ("kissfmrgv.iheart.com", "United States", "US", 0.96, "US-TX-RGV", "Rio Grande Valley, Texas", 26.2034, -98.23, 0.97),
    ("kisswheeling.iheart.com", "United States", "US", 0.96, "US-OHIO-VALLEY-WHEELING", "Ohio Valley around Wheeling", 40.064, -80.7201, 0.93),
    ("q102.iheart.com", "United States", "US", 0.96, "US-PA-PHILADELPHIA", "Philadelphia, Pennsylvania", 39.9526, -75.1652, 0.97),
    ("radiosunny.iheart.com", "United States", "US", 0.96, "US-NY-CANANDAIGUA", "Canandaigua, New York", 42.8742, -77.288, 0.94),
    ("throwback963.iheart.com", "United States", "US", 0.96, "US-LA-NEW-ORLEANS", "New Orleans, Louisiana", 29.9511, -90.0715, 0.97),
    ("wjbt.iheart.com", "United States", "US", 0.96, "US-FL-JACKSONVILLE", "Jacksonville, Florida", 30.3322, -81.6557, 0.97),
    ("wyht.iheart.com", "United States", "US", 0.96, "US-OH-MID-OHIO", "Mid-Ohio around Mansfield", 40.7584, -82.5154, 0.97),
)
SCHEMA = "registry_domain string, origin_country string, origin_code string, origin_confidence double, market_code string, market_label string, market_latitude double, market_longitude double, market_confidence double"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), SCHEMA)


def with_profile(articles: DataFrame, profiles: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Every article with its outlet's profile, or nulls. The registry is a list kept by hand; Spark broadcasts it by its size."""
    return articles.join(profiles, normalized_domain(F.col(domain_col)) == F.col("registry_domain"), "left").drop("registry_domain")


def _assessment(known: Column, value: Column, confidence: Column, method: str, reason: str) -> Column:
    return F.struct(
        F.when(known, "observed").otherwise("unknown").alias("status"), F.when(known, value).alias("value"), F.when(known, confidence).alias("confidence"),
        F.when(known, method).otherwise("unavailable").alias("method"), F.when(~known, reason).alias("reason"),
    )


def same_story_context() -> Column:
    """Origin, editorial market, framing and tone of an article with a profile: four assessments that never fill in for one another."""
    origin = F.col("origin_code").isNotNull() | F.col("origin_country").isNotNull()
    never = F.lit(False)
    none = F.lit(None).cast("string")
    return F.struct(
        _assessment(origin, F.coalesce("origin_code", "origin_country"), F.col("origin_confidence"), "publisher_registry", "No publisher origin is documented.").alias("publisher_origin"),
        _assessment(F.col("market_code").isNotNull(), F.col("market_code"), F.col("market_confidence"), "documented_outlet_market", "No editorial market is documented.").alias("editorial_market"),
        _assessment(never, none, F.lit(None).cast("double"), "model_analysis", "Framing was not assessed.").alias("framing"),
        _assessment(never, none, F.lit(None).cast("double"), "model_analysis", "Tone was not assessed.").alias("tone"),
    )


# Fields of assessments as stored, and what stands for a market that older rows don't have.
_ASSESSED = "struct<status:string,value:string,confidence:double,method:string,evidence:array<string>,reason:string>"
_MARKET = (
    "struct<status:string,value:struct<regionCode:string,label:string,coordinates:struct<latitude:double,longitude:double>>,confidence:double,method:string,"
    "evidence:array<struct<kind:string,url:string,quote:string,articleId:string>>,reason:string>"
)
SAME_STORY = f"publisherOrigin {_ASSESSED}, editorialMarket {_MARKET}, framing {_ASSESSED}, tone {_ASSESSED}"
LEGACY_REASON = "Legacy row has no verified primary editorial-market assessment; superseded fields are not reinterpreted."
LEGACY_COLUMNS = ("publisher_origin_country", "audience_region_code")


def parsed_articles(rows: DataFrame, column: str = "same_story_json") -> DataFrame:
    """Stored articles with same_story, parsed from their JSON, and same_story_error, which is null where it is as it should be; without the legacy columns.

    A row without a market is an older one, whose market is unknown; one that breaks a rule has an error and no same_story. Errors: invalid_json, not_an_object, invalid_ and the field,
    inconsistent_editorialMarket where the evidence isn't of the kinds that the method needs.
    """
    text = F.col(column)
    tree = F.try_parse_json(text)
    x = F.from_json(text, SAME_STORY)
    unsaid = lambda c: c.isNull() | (F.trim(c) == "")
    no = F.lit(False)
    known = lambda c: F.coalesce(c.isin("observed", "unknown"), no)
    legacy = F.try_variant_get(tree, "$.editorialMarket", "variant").isNull()
    m = x["editorialMarket"]
    place = m["value"]["coordinates"]
    item_ok = lambda e: F.coalesce(e["kind"].isin("outlet_market_documentation", "outlet_language", "publisher_location") & e["url"].rlike("(?i)^https?://") & ~unsaid(e["quote"]) & (e["articleId"].isNull() | (F.trim(e["articleId"]) != "")), no)
    unknown_ok = m["value"].isNull() & m["confidence"].isNull() & (m["method"] == "unavailable") & (F.size(m["evidence"]) == 0) & ~unsaid(m["reason"])
    seen_ok = (
        ~unsaid(m["value"]["regionCode"]) & ~unsaid(m["value"]["label"]) & (place.isNull() | (place["latitude"].between(-90, 90) & place["longitude"].between(-180, 180))) & m["confidence"].between(0, 1)
        & m["method"].isin("documented_outlet_market", "language_and_publisher_location", "manual_confirmed") & (F.size(m["evidence"]) > 0) & F.forall(m["evidence"], item_ok) & m["reason"].isNull()
    )
    kinds = F.transform(m["evidence"], lambda e: e["kind"])
    has = lambda k: F.coalesce(F.array_contains(kinds, k), no)
    consistent = F.when(m["method"] == "language_and_publisher_location", has("outlet_language") & has("publisher_location")).otherwise(has("outlet_market_documentation"))
    error = F.when(text.isNull() | tree.isNull(), "invalid_json").when(~F.schema_of_variant(tree).startswith("OBJECT"), "not_an_object")
    for field in ("publisherOrigin", "framing", "tone"):
        error = error.when(~known(x[field]["status"]) | x[field]["evidence"].isNull(), f"invalid_{field}")
    error = error.when(~legacy & (~known(m["status"]) | ~F.coalesce(F.when(m["status"] == "unknown", unknown_ok).otherwise(seen_ok), no)), "invalid_editorialMarket")
    error = error.when(~legacy & (m["status"] == "observed") & ~consistent, "inconsistent_editorialMarket")
    older = F.from_json(F.lit(f'{{"status": "unknown", "method": "unavailable", "evidence": [], "reason": "{LEGACY_REASON}"}}'), _MARKET)
    own = rows.withColumn("same_story_error", error)
    good = F.col("same_story_error").isNull()
    return own.withColumn("same_story", F.when(good, F.when(legacy, x.withField("editorialMarket", older)).otherwise(x))).drop(column, *LEGACY_COLUMNS)
