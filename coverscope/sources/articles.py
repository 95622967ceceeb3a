"""Records of two search services as articles, and the union of sources under one health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope import schemas
from coverscope.functions import dates as D
from coverscope.functions import text as X
from coverscope.functions import urls as U
from coverscope.runtime import first_by

MOST_DOCUMENTS, MOST_NEWS = 250, 20
#: Columns that answers carry only to give retrieved_at.
_TIMES = ("finished_at",)


def read_json(spark: SparkSession, path: str, news: bool) -> DataFrame:
    """Landed answers of a search service, by their declared schema; what doesn't fit is null."""
    return spark.read.schema(schemas.NEWS_RESULTS if news else schemas.SEARCH_RESULTS).json(path, multiLine=True)


def _article(url: Column, title: Column, retrieved_at: Column, **more: Column) -> list[Column]:
    canonical = U.canonical_url(url)
    domain = U.domain(canonical)
    own = {
        "article_id": X.stable_id("article", canonical), "canonical_url": canonical, "url": url, "title": title, "summary": F.lit(None).cast("string"), "outlet_id": X.stable_id("publisher", domain), "domain": domain,
        "publisher_name": domain, "language": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp"), "retrieved_at": retrieved_at, "provider": F.lit(None).cast("string"),
        "provider_record_id": F.lit(None).cast("string"), "provider_score": F.lit(None).cast("double"),
    } | more
    return [own[name].cast(kind).alias(name) for name, kind in (x.split(" ") for x in schemas.ARTICLES.split(", "))]


def document_articles(answers: DataFrame, retrieved_at: Column, most: int = MOST_DOCUMENTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Articles of a document search; records without a title or a readable URL are dropped. origin_country: the country it states, sure to 0.8. carry: columns of the answers
    that their articles keep."""
    rows = answers.select(*carry, F.inline(F.slice("articles", 1, most)))
    own = rows.select(*(c for c in carry if c not in _TIMES), *_article(F.trim("url"), X.optional(F.col("title")), retrieved_at, language=F.lower(X.optional(F.col("language"))), published_at=D.seen_date(F.trim("seendate")), provider=F.lit("documents")), X.optional(F.col("sourcecountry")).alias("origin_country"))
    return own.where("canonical_url is not null and title is not null")


def news_articles(answers: DataFrame, retrieved_at: Column, most: int = MOST_NEWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Articles of a news search, with summaries and scores. carry: columns of the answers that their articles keep."""
    rows = answers.select(*carry, F.inline(F.slice("results", 1, most)))
    own = rows.select(*(c for c in carry if c not in _TIMES), *_article(F.trim("url"), X.optional(F.col("title")), retrieved_at, summary=X.optional(F.col("content")), published_at=X.optional(F.col("published_date")).try_cast("timestamp"), provider=F.lit("news"), provider_score=F.col("score")))
    return own.where("canonical_url is not null and title is not null")


def joined_articles(joined: DataFrame, retrieved_at: Column) -> DataFrame:
    """Articles of joined mentions (operators.gates), with event_id, mention_time and key_ord. The publisher's name is the document's, else the mention's, else the domain."""
    canonical = U.canonical_url(F.col("identifier"))
    own = joined.where("outcome = 'joined'").select(
        *_article(
            F.col("identifier"), F.col("doc_title"), retrieved_at, publisher_name=F.coalesce(X.optional(F.col("doc_common_name")), X.optional(F.col("source_name")), U.domain(canonical)),
            language=X.language_tag(F.coalesce("doc_translation", "translation")), published_at=F.col("doc_published_at"), provider=F.lit("batch"), provider_record_id=F.col("doc_record_id"), provider_score=F.col("confidence") / 100,
        ),
        "event_id", "mention_time", "confidence", "key_ord",
    )
    return own.where("canonical_url is not null")


def unique_articles(articles: DataFrame) -> DataFrame:
    """Of articles of one canonical URL the one with the longest summary, then the first. ord: their order over all sources."""
    return first_by(articles, ["canonical_url"], [-F.coalesce(F.length("summary"), F.lit(0)), F.col("ord")])


def source_health(statuses: DataFrame, article_count: Column) -> DataFrame:
    """One row of the sources' health. statuses: provider, ok, kind, message, warnings (array). article_count: an aggregate's value or a literal."""
    own = statuses.agg(
        F.count(F.lit(1)).alias("source_count"), F.count_if("ok").alias("successful_source_count"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("ok"), F.coalesce("warnings", F.array().cast("array<string>"))).otherwise(F.array(F.concat(F.col("provider"), F.lit(": "), F.col("kind"), F.lit(" — "), F.col("message"))))))).alias("warnings"),
    )
    none = article_count == 0
    status = F.when(F.col("successful_source_count") == 0, "unavailable").when((F.col("successful_source_count") < F.col("source_count")) | none, "degraded").otherwise("healthy")
    more = F.when(none, F.array(F.lit("No live articles were returned; no fallback records were created."))).otherwise(F.array().cast("array<string>"))
    return own.select(status.alias("status"), "source_count", "successful_source_count", F.concat("warnings", more).alias("warnings"))
