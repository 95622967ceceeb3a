"""Validation: each rule makes issue rows (cluster_id, code, path); nothing is repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.functions.urls import is_http_url

# What values, methods and kinds of evidence may be.
LOCATION_METHODS = ("article_text", "provider_event_geotag", "manual_confirmed")
FRAMINGS = ("supports", "disputes", "straight_report", "mixed", "unclear")
TONES = ("positive", "negative", "neutral", "mixed", "unclear")
METHODS = {
    "publisher_origin": ("provider_metadata", "publisher_registry"),
    "editorial_market": ("documented_outlet_market", "language_and_publisher_location", "manual_confirmed"),
    "framing": ("claim_stance_comparison", "model_analysis", "manual_confirmed"),
    "tone": ("model_analysis", "manual_confirmed"),
}
#: Evidence that a method of an editorial market needs, all of each.
MARKET_EVIDENCE = {"documented_outlet_market": ("outlet_market_documentation",), "language_and_publisher_location": ("outlet_language", "publisher_location")}
EVIDENCE_KINDS = ("outlet_market_documentation", "outlet_language", "publisher_location")


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def _unsure(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (x < 0) | (x > 1)


def _outside(x: Column, bound: float) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) > bound)


def issues_of(df: DataFrame, rules: list[tuple[str, str, Column]], keys: list[str] | None = None) -> DataFrame:
    """(keys, code, path): a row for each rule (code, path, condition) that a row of df breaks."""
    keys = keys or ["cluster_id"]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for code, path, bad in rules]))
    return df.select(*keys, F.explode(found).alias("i")).select(*keys, "i.code", "i.path")


def cluster_issues(clusters: DataFrame, articles: DataFrame, memberships: DataFrame) -> DataFrame:
    """Of clusters, their articles, and the memberships that go with them in both directions."""
    header = [
        ("missing_id", "id", _blank(F.col("cluster_id"))), ("missing_title", "title", _blank(F.col("title"))), ("invalid_timestamp", "first_observed_at", F.col("first_observed_at").isNull()),
        ("invalid_timestamp", "last_observed_at", F.col("last_observed_at").isNull()), ("inverted_observation_window", "first_observed_at", F.col("first_observed_at") > F.col("last_observed_at")),
    ]
    own = issues_of(clusters, header)
    tagged = lambda df, code, path: df.select("cluster_id", F.lit(code).alias("code"), F.lit(path).alias("path"))
    own = own.unionAll(tagged(clusters.join(articles, "cluster_id", "left_anti"), "empty_cluster", "articles"))
    for column, code in (("article_id", "duplicate_article_id"), ("canonical_url", "duplicate_canonical_url")):
        n = articles.groupBy("cluster_id", column).agg((F.count(F.lit(1)) - 1).cast("int").alias("n")).where("n > 0")
        own = own.unionAll(tagged(n.select("cluster_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")), code, f"articles.{column}"))
    own = own.unionAll(issues_of(articles, [("invalid_url", "articles.url", ~is_http_url(F.col("url")) | ~is_http_url(F.col("canonical_url"))), ("invalid_timestamp", "articles.retrieved_at", F.col("retrieved_at").isNull())]))
    pair = ["cluster_id", "article_id"]
    own = own.unionAll(tagged(articles.select(*pair).distinct().join(memberships, pair, "left_anti"), "missing_membership", "memberships"))
    own = own.unionAll(tagged(memberships.join(articles, pair, "left_anti"), "unknown_membership_article", "memberships.article_id"))
    return own.unionAll(issues_of(memberships, [("invalid_confidence", "memberships.confidence", _unsure(F.col("confidence")))]))


def evidence_issues(evidence: DataFrame, articles: DataFrame, path: str, methods: tuple[str, ...] | None = None) -> DataFrame:
    """Of evidence rows: cluster_id, article_id, url, quote, and method where methods are given."""
    rules = [("invalid_url", f"{path}.url", ~is_http_url(F.col("url"))), ("empty_quote", f"{path}.quote", _blank(F.col("quote")))]
    if methods:
        rules.append(("invalid_event_location_evidence_method", f"{path}.method", ~F.coalesce(F.col("method").isin(*methods), F.lit(False))))
    unknown = evidence.join(articles.select("cluster_id", "article_id").distinct(), ["cluster_id", "article_id"], "left_anti")
    return issues_of(evidence, rules).unionAll(unknown.select("cluster_id", F.lit("unknown_evidence_article").alias("code"), F.lit(f"{path}.article_id").alias("path")))


def location_issues(locations: DataFrame, articles: DataFrame) -> DataFrame:
    """Of event locations: cluster_id, confidence, latitude, longitude, evidence (array of article_id, url, quote, method)."""
    rules = [
        ("invalid_confidence", "locations.confidence", _unsure(F.col("confidence"))), ("invalid_latitude", "locations.latitude", _outside(F.col("latitude"), 90)),
        ("invalid_longitude", "locations.longitude", _outside(F.col("longitude"), 180)), ("missing_location_evidence", "locations.evidence", F.size(F.coalesce("evidence", F.array())) == 0),
    ]
    return issues_of(locations, rules).unionAll(evidence_issues(locations.select("cluster_id", F.inline("evidence")), articles, "locations.evidence", LOCATION_METHODS))


def claim_issues(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Of claims: cluster_id, confidence, evidence (array of article_id, url, quote)."""
    rules = [("invalid_confidence", "claims.confidence", _unsure(F.col("confidence"))), ("missing_claim_evidence", "claims.evidence", F.size(F.coalesce("evidence", F.array())) == 0)]
    return issues_of(claims, rules).unionAll(evidence_issues(claims.select("cluster_id", F.inline("evidence")), articles, "claims.evidence"))


def prominence_issues(prominence: DataFrame) -> DataFrame:
    rules = [("invalid_raw_prominence", "prominence.raw", (F.col("article_count") < 0) | (F.col("outlet_count") < 0))]
    if "basis" in prominence.columns:
        rules.append(("invalid_prominence_basis", "prominence.basis", F.col("basis") != "event_location"))
    return issues_of(prominence, rules + [("invalid_confidence", f"prominence.{c}", _unsure(F.col(c))) for c in ("score", "article_share", "outlet_share", "source_normalized_share")])


def region_rules(region: Column, path: str) -> list[tuple[str, str, Column]]:
    """Of a region: code, label, latitude, longitude; coordinates can be missing, both."""
    there = region["latitude"].isNotNull() | region["longitude"].isNotNull()
    return [
        ("invalid_region", path, region.isNull()), ("missing_region_code", f"{path}.code", region.isNotNull() & _blank(region["code"])), ("missing_region_label", f"{path}.label", region.isNotNull() & _blank(region["label"])),
        ("invalid_latitude", f"{path}.latitude", there & _outside(region["latitude"], 90)), ("invalid_longitude", f"{path}.longitude", there & _outside(region["longitude"], 180)),
    ]


def assessment_rules(kind: str, a: Column, evidence: bool) -> list[tuple[str, str, Column]]:
    """Of an assessment (status, value, confidence, method, reason, evidence): unknown ones say why and nothing else, observed ones what and how.

    evidence: whether an observed one must have any. The rules of its value, and of what evidence a market's method needs, follow by kind.
    """
    observed, unknown = a["status"] == "observed", a["status"] == "unknown"
    n = F.size(F.coalesce(a["evidence"], F.array()))
    rules = [
        ("missing_assessment", kind, a.isNull()), ("invalid_assessment_status", f"{kind}.status", a.isNotNull() & ~F.coalesce(observed | unknown, F.lit(False))),
        ("invalid_unknown_value", f"{kind}.value", unknown & a["value"].isNotNull()), ("invalid_unknown_confidence", f"{kind}.confidence", unknown & a["confidence"].isNotNull()),
        ("invalid_unknown_method", f"{kind}.method", unknown & ~F.coalesce(a["method"] == "unavailable", F.lit(False))), ("missing_unknown_reason", f"{kind}.reason", unknown & _blank(a["reason"])),
        ("unexpected_unknown_evidence", f"{kind}.evidence", unknown & (n > 0)), ("invalid_confidence", f"{kind}.confidence", observed & _unsure(a["confidence"])),
        ("invalid_assessment_method", f"{kind}.method", observed & ~F.coalesce(a["method"].isin(*METHODS[kind]), F.lit(False))), ("invalid_observed_reason", f"{kind}.reason", observed & a["reason"].isNotNull()),
    ]
    if evidence:
        rules.append(("missing_assessment_evidence", f"{kind}.evidence", observed & (n == 0)))
    if kind in ("framing", "tone"):
        rules.append((f"invalid_{kind}", f"{kind}.value", observed & ~F.coalesce(a["value"].isin(*(FRAMINGS if kind == "framing" else TONES)), F.lit(False))))
    if kind == "editorial_market":
        for method, kinds in MARKET_EVIDENCE.items():
            lacks = F.lit(False)
            for k in kinds:
                lacks = lacks | ~F.exists(F.coalesce(a["evidence"], F.array()), lambda e, k=k: e["kind"] == k)
            rules.append(("editorial_market_method_evidence_mismatch", f"{kind}.evidence", observed & (a["method"] == method) & lacks))
        rules.append(("invalid_editorial_market_evidence_kind", f"{kind}.evidence.kind", F.exists(F.coalesce(a["evidence"], F.array()), lambda e: ~F.coalesce(e["kind"].isin(*EVIDENCE_KINDS), F.lit(False)))))
    return rules


def context_issues(articles: DataFrame, json_col: str = "same_story_json", keys: list[str] | None = None) -> DataFrame:
    """Of stored comparison contexts: one that isn't there, one that is no object, and regions whose coordinates are there but no object."""
    keys = keys or ["cluster_id"]
    value = F.try_parse_json(F.col(json_col))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    rules = [("missing_same_story_context", "same_story", F.col(json_col).isNull()), ("invalid_same_story_context", "same_story", F.col(json_col).isNotNull() & ~is_object(F.col("_v")))]
    for name in ("publisherOrigin", "editorialMarket"):
        there = F.try_variant_get("_v", f"$.{name}.value.coordinates", "variant")
        observed = F.try_variant_get("_v", f"$.{name}.status", "string") == "observed"
        rules.append(("invalid_coordinates", f"same_story.{name}.value.coordinates", observed & there.isNotNull() & ~is_object(there)))
    return issues_of(articles.withColumn("_v", value), rules, keys)


def health_issues(health: DataFrame) -> DataFrame:
    return issues_of(health, [("invalid_health_counts", "health.successful_source_count", F.col("successful_source_count") > F.col("source_count"))])


def slice_issues(clusters: DataFrame, articles: DataFrame, locations: DataFrame, start: Column, end: Column) -> DataFrame:
    """What a cluster lacks to stand for a window: two outlets, an event location, an article within it."""
    at = F.coalesce("published_at", "retrieved_at")
    per = articles.groupBy("cluster_id").agg(F.countDistinct("outlet_id").alias("outlets"), F.max(at.between(start, end)).alias("inside"))
    placed = locations.select("cluster_id", F.lit(True).alias("placed")).distinct()
    own = clusters.select("cluster_id").join(per, "cluster_id", "left").join(placed, "cluster_id", "left")
    return issues_of(
        own,
        [
            ("insufficient_independent_outlets", "articles", F.coalesce("outlets", F.lit(0)) < 2), ("missing_event_location", "locations", F.col("placed").isNull()), ("outside_window", "articles", ~F.coalesce("inside", F.lit(False))),
        ],
    )


def snapshot_issues(version: str, source_kinds: list[str], cluster_count: int, emitted: int) -> list[tuple[str, str]]:
    """Of a snapshot's envelope, on the driver: (code, path)."""
    found = []
    if version != "1.0":
        found.append(("invalid_snapshot_version", "schema_version"))
    if sorted(source_kinds) != ["documents", "events", "mentions"]:
        found.append(("missing_source_files", "source.files"))
    if cluster_count != emitted:
        found.append(("invalid_cluster_count", "statistics.clusters_emitted"))
    return found


def assert_none(issues: DataFrame) -> None:
    """Raises with the first issues, if there are any."""
    rows = issues.limit(20).collect()
    if rows:
        raise ValueError("; ".join(f"{r['code']} at {r['path']}" for r in rows))
