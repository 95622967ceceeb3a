"""Enrichment of clusters by searches: which cluster a search is for, which results may join it, and which pairs are independent."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.functions import numbers as N
from coverscope.functions import text as X
from coverscope.functions import urls as U
from coverscope.runtime import counted_so_far, first_by, settle

# Sites that hold no articles.
NON_ARTICLE_DOMAINS = "facebook.com instagram.com reddit.com tiktok.com x.com youtube.com".split()
MINIMUM_SCORE, MOST_RESULTS, HOURS, RAW_CHARS = 0.5, 8, 38, 500
# How alike two results of a story may be in words, in runs of five words, and in title.
MOST_WORDS, MOST_SHINGLES, MOST_TITLE = 0.72, 0.12, 0.6


def priority(title: Column, article_count: Column) -> Column:
    """How much a follow-up search of a cluster promises."""
    words = F.size(X.title_tokens(title))
    return F.when(title.rlike(X.HIGH_YIELD), 100).otherwise(0) + F.least(F.lit(30), words) + F.least(F.lit(10), article_count * 2) - F.when(title.rlike(X.LOW_YIELD), 100).otherwise(0)


def searchable(clusters: DataFrame, limit: int, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The clusters to search for, most promising first: one for each set of title words. clusters: cluster_id, title, article_count."""
    own = clusters.where(~F.col("title").rlike(X.LOW_YIELD)).withColumn("title_key", X.title_set_key(F.col("title"))).where("title_key <> ''")
    own = own.where(F.col("cluster_id").isin(*include)) if include else own
    own = own.where(~F.col("cluster_id").isin(*exclude)) if exclude else own
    own = own.withColumn("priority", priority(F.col("title"), F.col("article_count")))
    one = first_by(own, ["title_key"], [-F.col("priority"), -F.col("article_count"), F.col("cluster_id")])
    return one.orderBy(F.col("priority").desc(), F.col("article_count").desc(), "cluster_id").limit(limit).withColumn("query", X.search_query(F.col("title")))


def target_clusters(searches: DataFrame, clusters: DataFrame, least: float = 0.3) -> DataFrame:
    """(search_id, cluster_id, score): the cluster whose title is most like a search's query or any of its results' titles.

    searches: search_id, text (a row for the query and for each result). clusters: cluster_id, title, ord. Texts and titles are joined on a common word, so no pair
    without one is made; the words are those of titles, without stop words.
    """
    words = clusters.select("cluster_id", "ord", X.title_tokens(F.col("title")).alias("t"))
    said = searches.select("search_id", F.array_sort(X.title_tokens(F.col("text"))).alias("s")).distinct()  # texts of the same words are one
    pairs = said.select("search_id", "s", F.explode("s").alias("w")).join(words.select("cluster_id", "ord", F.size("t").alias("n"), F.explode("t").alias("w")), "w")
    shared = pairs.groupBy("search_id", "s", "cluster_id", "ord", "n").agg(F.count(F.lit(1)).alias("k"))
    score = F.col("k") / (F.size("s") + F.col("n") - F.col("k"))
    best = shared.withColumn("score", score).groupBy("search_id", "cluster_id", "ord").agg(F.max("score").alias("score"))
    return first_by(best, ["search_id"], [-F.col("score"), F.col("ord"), F.col("cluster_id")], ["cluster_id", "score"]).where(F.col("score") >= least)


def memberships(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """(cluster_id, article_id, matched_article_id, confidence, parts) of candidates that belong to their cluster.

    candidates: cluster_id, article_id, title, summary, at, search_score, query_overlap. articles: cluster_id, article_id, title, summary, at, ord. A candidate is compared with its cluster's articles;
    the best match and the search decide.
    """
    known = articles.select("cluster_id", F.col("article_id").alias("matched_article_id"), "ord", X.title_tokens(F.col("title")).alias("kt"), X.entities(F.col("title"), F.col("summary")).alias("ke"), F.col("at").alias("ka"))
    own = candidates.withColumn("t", X.title_tokens(F.col("title"))).withColumn("e", X.entities(F.col("title"), F.col("summary")))
    parts = own.join(known, "cluster_id").select(
        "cluster_id", "article_id", "search_score", "query_overlap", "matched_article_id", "ord", N.jaccard(F.col("t"), F.col("kt")).alias("title_overlap"),
        F.coalesce(N.jaccard_if_any(F.col("e"), F.col("ke")), F.lit(0.0)).alias("entity_overlap"), F.coalesce(N.time_similarity(F.col("at"), F.col("ka")), F.lit(0.0)).alias("time_overlap"),
    )
    score = F.col("title_overlap") * 0.45 + F.col("entity_overlap") * 0.35 + F.col("time_overlap") * 0.2
    best = first_by(parts.withColumn("score", score), ["cluster_id", "article_id"], [-F.col("score"), F.col("ord")])
    confidence = F.col("score") * 0.45 + F.col("query_overlap") * 0.3 + F.col("search_score") * 0.25
    good = (F.col("search_score") >= 0.5) & (F.col("query_overlap") >= 0.35) & (F.col("time_overlap") >= 0.35) & ((F.col("title_overlap") >= 0.08) | (F.col("entity_overlap") >= 0.1))
    return best.withColumn("confidence", confidence).where(good & (F.col("confidence") >= 0.35)).withColumn("confidence", F.least(F.lit(0.95), "confidence")).drop("ord")


def url_batches(urls: DataFrame, size: int = 20, groups: int = 1024) -> DataFrame:
    """(url, batch): distinct URLs in batches of `size`, all of them full but the last.

    They are numbered within groups by hash, and a group's numbers follow those of the groups before, from one row for each; so no task numbers them all.
    """
    own = urls.select("url").distinct().withColumn("_g", F.pmod(F.xxhash64("url"), F.lit(groups)))
    sizes = own.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_g", F.coalesce(F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_g").orderBy("url")) - 1
    return own.withColumn("_at", at).join(F.broadcast(before), "_g").select("url", F.floor((F.col("_at") + F.col("_before")) / size).alias("batch"))


def extracted_contents(contents: DataFrame) -> DataFrame:
    """(canonical_url, raw_content, sha256): the texts of pages that are long enough to be compared; of one URL the last by its text."""
    long = contents.where(F.length("raw_content") >= RAW_CHARS).select(U.canonical_url(F.col("url")).alias("canonical_url"), "raw_content").where("canonical_url is not null")
    return long.groupBy("canonical_url").agg(F.max("raw_content").alias("raw_content")).withColumn("sha256", F.sha2("raw_content", 256))


def independent_pairs(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Two results of each cluster that are independent of it and of one another; clusters with fewer give none.

    candidates: cluster_id, rank, canonical_url, domain, title, raw_content. existing: cluster_id, network. In order of rank a candidate is taken if its network is new, and no taken one is too like
    it in words (0.72), in runs of five words (0.12) or in title (0.6). A cluster has MOST_RESULTS candidates at most, which is a task's group.
    """
    own = candidates.withColumn("network", X.network(F.col("domain"), F.col("raw_content"))).join(existing.select("cluster_id", "network").distinct(), ["cluster_id", "network"], "left_anti")
    own = own.select("cluster_id", "rank", "canonical_url", "domain", "network", X.text_tokens(F.col("raw_content")).alias("words"), X.word_shingles(F.col("raw_content")).alias("shingles"), X.title_tokens(F.col("title")).alias("title_words"))
    schema = "cluster_id string, canonical_url string, domain string, network string, position int"

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        def share(a: list, b: list) -> float:
            x, y = set(a), set(b)
            return len(x & y) / len(x | y) if x and y else 0.0

        taken: list = []
        for row in frame.sort_values(["rank", "canonical_url"]).itertuples():
            clash = any(t.network == row.network or share(t.words, row.words) > MOST_WORDS or share(t.shingles, row.shingles) >= MOST_SHINGLES or share(t.title_words, row.title_words) > MOST_TITLE for t in taken)
            if not clash:
                taken.append(row)
            if len(taken) == 2:
                break
        if len(taken) < 2:
            taken = []
        return pd.DataFrame([(t.cluster_id, t.canonical_url, t.domain, t.network, i) for i, t in enumerate(taken)], columns=[x.split()[0] for x in schema.split(", ")])

    return own.groupBy("cluster_id").applyInPandas(pick, schema)


def curated(stories: DataFrame, searches: DataFrame, contents: DataFrame, selected: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A receipt's stories, searches and extracted contents that are of the selected clusters: stories by id, searches by those stories' titles, contents by those
    searches' results. Raises if a selected id isn't there.

    stories: cluster_id, title. searches: query, url, a row for each result. contents: url. Any more columns stay.
    """
    wanted = stories.sparkSession.createDataFrame([(x,) for x in sorted(set(selected))], "cluster_id string")
    if absent := [r["cluster_id"] for r in missing_ids(wanted, stories).collect()]:  # of the ids given
        raise ValueError(f"selected clusters are absent from the receipt: {', '.join(sorted(absent))}")
    own = stories.join(wanted, "cluster_id", "left_semi")
    asked = searches.join(own.select(F.col("title").alias("query")), "query", "left_semi")
    urls = asked.select(U.canonical_url(F.col("url")).alias("_c"))
    return own, asked, contents.withColumn("_c", U.canonical_url(F.col("url"))).join(urls, "_c", "left_semi").drop("_c")


def require_approved(clusters: DataFrame, articles: DataFrame, approved: list[str], least: int = 3) -> None:
    """Raises unless each approved cluster is there with `least` articles or more. clusters, articles: cluster_id."""
    wanted = clusters.sparkSession.createDataFrame([(x,) for x in sorted(set(approved))], "cluster_id string")
    enough = articles.join(wanted, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    there = clusters.select("cluster_id").join(enough, "cluster_id", "left_semi")
    if absent := [r["cluster_id"] for r in missing_ids(wanted, there).collect()]:  # of the ids given
        raise ValueError(f"approved clusters are absent or have under {least} articles: {', '.join(sorted(absent))}")


def missing_ids(wanted: DataFrame, clusters: DataFrame, key: str = "cluster_id") -> DataFrame:
    return wanted.select(key).distinct().join(clusters.select(key), key, "left_anti")


def framed(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """Articles with the framing and tone that a rule confirmed by hand gives their outlet. rules: domain, title_pattern (or null), framing, tone, priority; a list kept by hand."""
    fits = (F.col("domain") == F.col("_d")) & (F.col("title_pattern").isNull() | F.expr("title rlike title_pattern"))
    own = articles.join(rules.withColumnRenamed("domain", "_d"), fits, "left").drop("_d", "title_pattern")
    return first_by(own, ["article_id"], [F.coalesce("priority", F.lit(0))]).drop("priority")


# Reasons why a search result doesn't join a cluster, in the order in which they are looked for; the score below which it isn't looked at.
REASONS = ("no matching cluster", "relevance score below 0.4", "invalid article URL or record", "no successful extraction", "canonical URL already present", "publisher network already represented", "same-story threshold not met")
LEAST_SCORE = 0.4
#: Reasons of results that come after a cap was reached.
SEARCH_FULL, ALL_FULL = "the search has given its most articles", "all searches have given their most articles"
PARTS = ("title_overlap", "entity_overlap", "time_overlap")


def enriched(searches: DataFrame, results: DataFrame, clusters: DataFrame, articles: DataFrame, contents: DataFrame, per_search: int = 3, total: int = 6) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): search results that join clusters as articles, with their confidence and what it rests on; and all others, with the first reason of REASONS or the cap that was reached.

    searches: search_id, query, and ord, their order (else that of their ids). results: search_id, article_id, url, title, summary, score, at. clusters: cluster_id, title, ord. articles: cluster_id, article_id, title, summary,
    at, ord, canonical_url, domain. contents: url, raw_content. A search is for the cluster that target_clusters tells.

    It is as if searches were gone through in order, and the results of each by score (then URL and id; those without a score last): one that joins counts for those after it, of the same or a later search for the
    cluster: its URL, its network, and as a match. A search gives per_search articles at most, all together `total`, and what comes after that isn't looked at. A cluster's results pass by in
    order, and only the articles that joined are kept; the order of all results is a prefix sum over ranges (counted_so_far).
    """
    searches = searches if "ord" in searches.columns else searches.withColumn("ord", F.col("search_id"))
    asked = searches.select("search_id", F.col("query").alias("text")).unionAll(results.select("search_id", F.col("title").alias("text")))
    target = target_clusters(asked, clusters).select("search_id", "cluster_id")
    query_overlap = N.jaccard(X.title_tokens(F.col("cluster_title")), X.title_tokens(F.col("query")))
    known = clusters.select("cluster_id", F.col("title").alias("cluster_title"))
    own = results.join(searches.select("search_id", "query", F.col("ord").alias("search_ord")), "search_id").join(target, "search_id", "left").join(known, "cluster_id", "left").withColumn("query_overlap", query_overlap)
    own = own.withColumn("score", F.nanvl("score", F.lit(None).cast("double"))).withColumn("canonical_url", U.canonical_url(F.col("url"))).withColumn("domain", U.domain(F.col("canonical_url")))
    own = own.join(extracted_contents(contents).select("canonical_url", F.col("sha256")), "canonical_url", "left").withColumn("network", X.network(F.col("domain"), F.lit("")))
    have = articles.groupBy("cluster_id").agg(F.collect_set("canonical_url").alias("urls"), F.collect_set(X.network(F.col("domain"), F.lit(""))).alias("networks"))  # a cluster's articles are capped
    own = own.join(have, "cluster_id", "left")
    reason = F.when(F.col("cluster_id").isNull(), REASONS[0]).when(F.col("score").isNull() | (F.col("score") < LEAST_SCORE), REASONS[1]).when(F.col("canonical_url").isNull() | (F.trim(F.coalesce("title", F.lit(""))) == ""), REASONS[2])
    own = settle(own.withColumn("reason", reason.when(F.col("sha256").isNull(), REASONS[3])).withColumn("row", F.monotonically_increasing_id()))
    # The best match among the articles that the cluster has.
    before = articles.select("cluster_id", F.col("article_id").alias("matched"), "ord", X.title_tokens(F.col("title")).alias("kt"), X.entities(F.col("title"), F.col("summary")).alias("ke"), F.col("at").alias("ka"))
    own = own.withColumn("t", X.title_tokens(F.coalesce("title", F.lit("")))).withColumn("e", X.entities(F.coalesce("title", F.lit("")), F.col("summary")))
    parts = own.where("reason is null").select("row", "cluster_id", "t", "e", "at").join(before, "cluster_id").select(
        "row", "matched", "ord", N.jaccard(F.col("t"), F.col("kt")).alias("title_overlap"), F.coalesce(N.jaccard_if_any(F.col("e"), F.col("ke")), F.lit(0.0)).alias("entity_overlap"), F.coalesce(N.time_similarity(F.col("at"), F.col("ka")), F.lit(0.0)).alias("time_overlap")
    )
    score = F.col("title_overlap") * 0.45 + F.col("entity_overlap") * 0.35 + F.col("time_overlap") * 0.2
    best = first_by(parts.withColumn("match_score", score), ["row"], [-F.col("match_score"), F.col("ord")], ["matched", "match_score", *PARTS])
    order = [F.col("search_ord").asc(), F.col("search_id").asc(), F.col("score").desc_nulls_last(), F.col("canonical_url").asc_nulls_last(), F.col("article_id").asc_nulls_last(), F.col("row").asc()]
    rows = own.where("cluster_id is not null").join(best, "row", "left").withColumn("micros", F.unix_micros(F.col("at").cast("timestamp"))).repartition("cluster_id").sortWithinPartitions("cluster_id", *order)
    columns = ("row", "cluster_id", "search_id", "article_id", "canonical_url", "network", "score", "query_overlap", "urls", "networks", "t", "e", "micros", "matched", "match_score", *PARTS, "reason")
    schema = "row long, matched_article_id string, confidence double, title_overlap double, entity_overlap double, time_overlap double, reason string"
    types = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if cluster is None or cluster.id != row["cluster_id"]:
                    cluster = Growing(row, per_search)
                out.append((row["row"], *cluster.judged(row)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    judged = rows.select(*columns).mapInArrow(judge, schema)
    every = own.drop("reason").join(judged, "row", "left").withColumn("reason", F.when(F.col("cluster_id").isNull(), REASONS[0]).otherwise(F.col("reason")))
    every = counted_so_far(every, order, F.col("reason").isNull(), "n")
    every = settle(every.withColumn("reason", F.when(F.col("n") - F.col("reason").isNull().cast("long") >= total, ALL_FULL).otherwise(F.col("reason"))))
    accepted = every.where("reason is null").select("cluster_id", "article_id", "url", "matched_article_id", "confidence", "sha256", *PARTS, F.col("n").alias("position"))
    return accepted, every.where("reason is not null").select("search_id", "article_id", "url", "reason")


class Growing:
    """A cluster that results join one after another."""

    def __init__(self, row: dict, per_search: int) -> None:
        self.id, self.per_search = row["cluster_id"], per_search
        self.urls, self.networks = set(row["urls"] or ()), set(row["networks"] or ())
        self.taken: list[dict] = []
        self.search, self.given = None, 0

    def judged(self, row: dict) -> tuple:
        """(matched_article_id, confidence, parts, reason) of the next result."""
        if row["search_id"] != self.search:
            self.search, self.given = row["search_id"], 0
        if self.given == self.per_search:
            return None, None, None, None, None, SEARCH_FULL
        if row["reason"] is not None:
            return None, None, None, None, None, row["reason"]
        if row["canonical_url"] in self.urls or row["network"] in self.networks:
            return None, None, None, None, None, REASONS[4] if row["canonical_url"] in self.urls else REASONS[5]
        best = (row["match_score"], *(row[p] for p in PARTS), row["matched"]) if row["matched"] is not None else None
        for x in self.taken:
            title, names = _share(row["t"], x["t"]), _share(row["e"], x["e"]) if row["e"] and x["e"] else 0.0
            time = 0.0 if row["micros"] is None or x["micros"] is None else math.exp(-abs(row["micros"] - x["micros"]) / 3.6e9 / 36)
            one = title * 0.45 + names * 0.35 + time * 0.2
            best = (one, title, names, time, x["article_id"]) if best is None or one > best[0] else best
        confidence = best[0] * 0.45 + row["query_overlap"] * 0.3 + row["score"] * 0.25 if best else 0.0
        if best is None or row["score"] < 0.5 or row["query_overlap"] < 0.35 or best[3] < 0.35 or (best[1] < 0.08 and best[2] < 0.1) or confidence < 0.35:
            return best[4] if best else None, min(0.95, confidence), *(best[1:4] if best else (None,) * 3), REASONS[6]
        self.taken.append(row)
        self.urls.add(row["canonical_url"])
        self.networks.add(row["network"])
        self.given += 1
        return best[4], min(0.95, confidence), *best[1:4], None


def _share(a: list, b: list) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 0.0
