"""From clusters worth a search and what searches found to stories with two more independent sources, and all other results with the reason why not."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.functions import numbers as N
from coverscope.functions import text as X
from coverscope.functions import urls as U
from coverscope.operators import enrich
from coverscope.operators.enrich import MOST_RESULTS, MOST_SHINGLES, MOST_TITLE, MOST_WORDS
from coverscope.runtime import counted_so_far, settle

# Reasons why a result isn't an addition, in the order in which they are looked for.
LOW, NO_URL, NO_ARTICLE, KNOWN_URL, KNOWN_DOMAIN, UNLIKE, FAR, FULL, NO_TEXT, KNOWN_NETWORK, SAME_WORDS, SAME_RUNS, SAME_TITLE, ENOUGH, TOO_FEW, NOT_NEEDED = (
    "relevance score below 0.5", "invalid URL", "a site without articles", "canonical URL already present", "domain already present", "neither title nor names alike", "published too far away in time", "the story has its most candidates",
    "no extracted text of 500 characters", "network already present", "text too like another's in words", "text too like another's in runs of words", "title too like another's", "the story has its two additions",
    "the story has fewer than two independent additions", "enough stories were found",
)


@dataclass
class Collected:
    """stories: cluster_id, position, content_similarity, shingle_similarity, title_similarity. additions: cluster_id, position (0, 1), url, canonical_url, domain, network, sha256, title_overlap, entity_overlap.
    rejected: cluster_id, url, reason."""

    stories: DataFrame
    additions: DataFrame
    rejected: DataFrame


def collected(clusters: DataFrame, articles: DataFrame, results: DataFrame, contents: DataFrame, target: int = 20) -> Collected:
    """The first `target` stories, in the order of their clusters, that have two additions; a story's additions are the first of its results that pass, by score (then URL).

    clusters: cluster_id, title, article_count, priority, last_observed_at, as enrich.searchable gives them (the most promising first). articles: cluster_id, canonical_url, domain, summary. results: cluster_id, url, title, score,
    published_at. contents: url, raw_content. Each result is in additions or in rejected. A cluster's results pass by in order; what is kept of them is its domains and at most two results. The order of clusters is a prefix sum over
    ranges, so nothing is gathered for the whole.
    """
    own = results.withColumn("canonical_url", U.canonical_url(F.col("url"))).withColumn("domain", U.normalized_domain(U.domain(F.col("canonical_url"))))
    own = own.join(clusters.select("cluster_id", F.col("title").alias("cluster_title"), "last_observed_at"), "cluster_id")
    words, names = X.title_tokens(F.col("title")), X.entities(F.coalesce("title", F.lit("")))
    own = own.withColumn("title_overlap", F.coalesce(N.jaccard(X.title_tokens(F.col("cluster_title")), words), F.lit(0.0))).withColumn("entity_overlap", F.coalesce(N.jaccard_if_any(X.entities(F.col("cluster_title")), names), F.lit(0.0)))
    have = articles.groupBy("cluster_id").agg(  # a cluster's articles are capped
        F.collect_set("canonical_url").alias("urls"), F.collect_set(U.normalized_domain(F.col("domain"))).alias("domains"), F.collect_set(X.network(U.normalized_domain(F.col("domain")), F.coalesce("summary", F.lit("")))).alias("networks")
    )
    texts = enrich.extracted_contents(contents)
    own = own.join(have, "cluster_id", "left").join(texts, "canonical_url", "left")
    near = N.seconds_between(F.col("published_at"), F.col("last_observed_at")) <= enrich.HOURS * 3600
    early = F.when(F.col("score").isNull() | F.isnan("score") | (F.col("score") < enrich.MINIMUM_SCORE), LOW).when(F.col("canonical_url").isNull() | F.col("domain").isNull(), NO_URL).when(F.col("domain").isin(*enrich.NON_ARTICLE_DOMAINS), NO_ARTICLE)
    early = early.when(F.array_contains(F.coalesce("urls", F.array().cast("array<string>")), F.col("canonical_url")), KNOWN_URL).when(F.array_contains(F.coalesce("domains", F.array().cast("array<string>")), F.col("domain")), KNOWN_DOMAIN)
    late = F.when((F.col("title_overlap") < 0.08) & (F.col("entity_overlap") < 0.1), UNLIKE).when(~F.coalesce(near, F.lit(False)), FAR)
    own = settle(own.select("cluster_id", "url", "canonical_url", "domain", "title", "score", "title_overlap", "entity_overlap", "networks", "raw_content", "sha256", early.alias("early"), late.alias("late"), F.monotonically_increasing_id().alias("row")))
    body = F.when(F.col("early").isNull() & F.col("late").isNull(), F.col("raw_content"))
    rows = own.select(
        "cluster_id", "row", "domain", "early", "late", "networks", X.network(F.col("domain"), F.coalesce("raw_content", F.lit(""))).alias("network"), body.isNotNull().alias("has_text"), X.text_tokens(body).alias("words"), X.word_shingles(body).alias("shingles"), words.alias("title_words"),
        F.col("score"), F.col("canonical_url"),
    )
    passing = rows.repartition("cluster_id").sortWithinPartitions("cluster_id", F.col("score").desc_nulls_last(), F.col("canonical_url").asc_nulls_last(), "row")
    schema = "row long, cluster_id string, reason string, network string, position int, content_similarity double, shingle_similarity double, title_similarity double"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        story = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if story is None or story.id != row["cluster_id"]:
                    out += story.done() if story else []
                    story = Story(row)
                out += story.add(row)
            yield _rows(out, schema, types)
        yield _rows(story.done() if story else [], schema, types)

    judged = settle(passing.mapInArrow(judge, schema))
    found = judged.where("reason is null").groupBy("cluster_id").agg(F.max("content_similarity").alias("content_similarity"), F.max("shingle_similarity").alias("shingle_similarity"), F.max("title_similarity").alias("title_similarity"))
    ordered = clusters.select("cluster_id", "priority", "article_count").join(found.withColumn("found", F.lit(True)), "cluster_id", "left")
    placed = settle(counted_so_far(ordered, [F.col("priority").desc(), F.col("article_count").desc(), F.col("cluster_id").asc()], F.col("found").isNotNull(), "n"))
    stories = placed.where(F.col("found") & (F.col("n") <= target)).select("cluster_id", (F.col("n") - 1).alias("position"), "content_similarity", "shingle_similarity", "title_similarity")
    both = own.drop("networks").join(judged.select("row", "reason", "network", "position"), "row").join(stories.select("cluster_id", F.lit(True).alias("kept")), "cluster_id", "left")
    both = both.withColumn("reason", F.when(F.col("reason").isNull() & F.col("kept").isNull(), NOT_NEEDED).otherwise(F.col("reason")))
    additions = both.where("reason is null").select("cluster_id", "position", "url", "canonical_url", "domain", "network", "sha256", "title_overlap", "entity_overlap")
    return Collected(stories, additions, both.where("reason is not null").select("cluster_id", "url", "reason"))


def _rows(out: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _share(a: list, b: list) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x and y else 0.0


class Story:
    """A cluster whose results come by score. A result that is taken waits until it is known whether a second one is."""

    def __init__(self, row: dict) -> None:
        self.id, self.networks = row["cluster_id"], set(row["networks"] or ())
        self.domains: set[str] = set()
        self.taken: list[dict] = []

    def reason(self, row: dict) -> str | None:
        if row["early"] or (row["domain"] in self.domains and KNOWN_DOMAIN) or row["late"]:
            return row["early"] or (KNOWN_DOMAIN if row["domain"] in self.domains else row["late"])
        if len(self.domains) == MOST_RESULTS:
            return FULL
        self.domains.add(row["domain"])
        if not row["has_text"]:
            return NO_TEXT
        if len(self.taken) == 2:
            return ENOUGH
        if row["network"] in self.networks or any(t["network"] == row["network"] for t in self.taken):
            return KNOWN_NETWORK
        for part, most, reason in (("words", MOST_WORDS, SAME_WORDS), ("shingles", MOST_SHINGLES, SAME_RUNS), ("title_words", MOST_TITLE, SAME_TITLE)):
            if any((s := _share(t[part], row[part])) > most or (s == most and part == "shingles") for t in self.taken):
                return reason
        return None

    def add(self, row: dict) -> list[tuple]:
        reason = self.reason(row)
        if reason is not None:
            return [(row["row"], self.id, reason, row["network"], None, None, None, None)]
        self.taken.append(row)
        return []

    def done(self) -> list[tuple]:
        if len(self.taken) < 2:
            return [(t["row"], self.id, TOO_FEW, t["network"], None, None, None, None) for t in self.taken]
        parts = [_share(self.taken[0][p], self.taken[1][p]) for p in ("words", "shingles", "title_words")]
        return [(t["row"], self.id, None, t["network"], i, *parts) for i, t in enumerate(self.taken)]
