"""Every query over the given tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope import schemas
from coverscope.functions import dates as D
from coverscope.functions import numbers as N
from coverscope.functions import text as X
from coverscope.functions import urls as U
from coverscope.functions.dates import age_seconds, window_start
from coverscope.operators import clustering, constraints, enrich, gates, geocode, merge, prominence, receipts, registry, serving, signals, validate
from coverscope.plans import adapters as A
from coverscope.plans import snapshot
from coverscope.runtime import settle
from coverscope.sources import articles as search_sources
from coverscope.sources import batch, sinks
from coverscope.streaming import micro_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = datetime(2024, 1, 31)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Events, mentions that pass the gates (one for each event and document), and articles, as SQL.
GATED = """
with ev as (
  select o_orderkey as event_id, o_orderdate as date_added, n_name as region, n_regionkey from orders
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
el as (
  select * from (
    select l_orderkey as event_id, l_partkey as document_id, l_suppkey as outlet_id, l_quantity * 2 as confidence, l_shipdate as mention_time, l_linenumber,
      row_number() over (partition by l_orderkey, l_partkey order by l_quantity desc, l_shipdate desc, l_suppkey, l_linenumber) as r
    from lineitem where l_returnflag <> 'N' and l_linestatus = 'F' and l_quantity * 2 >= 80 and l_orderkey in (select event_id from ev)) where r = 1),
dc as (select p_partkey as document_id, case when p_brand <> 'Brand#1' then p_name end as title from part where p_size <= 40),
ar as (select el.*, dc.title, ev.region, ev.n_regionkey from el join dc using (document_id) join ev using (event_id) where dc.title is not null)
"""


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.eligible_mentions(A.mentions(spark, sf_dir), A.events(spark, sf_dir))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.joined_documents(_eligible(spark, sf_dir), A.documents(spark, sf_dir))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of each story: event_id as cluster_id, outlet, document, title, confidence, time. Queries that use them several times write them once, in each call (settle)."""
    own = _joined(spark, sf_dir).where("outcome = 'joined'")
    return own.select(F.col("event_id").alias("cluster_id"), "outlet_id", F.col("identifier").alias("document_id"), F.col("doc_title").alias("title"), "confidence", "mention_time")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).where("geo is not null").select(F.col("event_id").alias("cluster_id"), "region")


@query(GATED + "select event_id, document_id, outlet_id, confidence, mention_time, title from ar")
def gated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _joined(spark, sf_dir).where("outcome = 'joined'")
    return own.select("event_id", F.col("identifier").alias("document_id"), "outlet_id", "confidence", "mention_time", F.col("doc_title").alias("title"))


@query(GATED + "select count(*) as eligible, count(*) filter (title is not null) as joined, count(*) filter (dc.document_id is null) as without_document, count(*) filter (dc.document_id is not null and title is null) as without_title from el left join dc using (document_id)")
def gate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate_counters(_joined(spark, sf_dir))


_REGIONAL = GATED + """,
co as (select region, event_id as cluster_id, outlet_id, count(*) as n from ar group by all),
ot as (select region, outlet_id, sum(n) as total from co group by all),
rg as (select region, sum(total) as regional_articles, count(*) as regional_outlets from ot group by all),
sh as (select co.region, cluster_id, sum(n)::bigint as article_count, count(*) as outlet_count, sum(n / total) as own from co join ot using (region, outlet_id) group by all),
pr as (select cluster_id, region, article_count, outlet_count, regional_articles::bigint as regional_articles, regional_outlets,
  article_count / regional_articles as article_share, outlet_count / regional_outlets as outlet_share, own / regional_outlets as source_share,
  (article_count / regional_articles + own / regional_outlets) / 2 as score from sh join rg using (region))
"""


@query(_REGIONAL + "select cluster_id, region, article_count, outlet_count, regional_articles, regional_outlets, round(article_share, 9) as article_share, round(outlet_share, 9) as outlet_share, round(source_share, 9) as source_normalized_share, round(score, 9) as score from pr")
def regional_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prominence.regional_prominence(_articles(spark, sf_dir), _regions(spark, sf_dir))
    return own.select("cluster_id", "region", "article_count", "outlet_count", "regional_articles", "regional_outlets", *[F.round(c, 9).alias(c) for c in ("article_share", "outlet_share", "source_normalized_share", "score")])


@query("""
select l_orderkey as event_id, l_partkey as document_id, l_suppkey as outlet_id, l_quantity * 2 as confidence, l_shipdate as mention_time from (
  select *, row_number() over (partition by l_orderkey, l_partkey order by l_quantity desc, l_shipdate desc, l_suppkey, l_linenumber) as r from lineitem) where r = 1
""")
def dedupe_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = gates.deduplicated_mentions(A.mentions(spark, sf_dir))
    return own.select("event_id", F.col("identifier").alias("document_id"), "outlet_id", "confidence", "mention_time")


@query("""
with s as (
  select l_partkey as document_id, list({'published_at': l_shipdate, 'title': case when l_linestatus = 'O' then l_returnflag end} order by l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_linestatus, l_returnflag) as x
  from lineitem group by all),
d as (select document_id, list_reduce(x, lambda old, new: case when (new.title is not null and old.title is null) or new.published_at > old.published_at then new else old end) as d from s)
select document_id, d.published_at as published_at, d.title as title from d
""")
def dedupe_documents_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("document_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_linestatus", "l_returnflag").alias("ord"), F.col("l_shipdate").alias("published_at"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("title")
    )
    return gates.folded_documents(own).select("document_id", "published_at", "title")


_CLUSTERS = GATED + """,
cl as (select event_id as cluster_id, any_value(region) as region, count(*) as article_count, count(distinct outlet_id) as outlet_count, min(mention_time) as first_observed_at, max(mention_time) as last_observed_at from ar group by event_id)
"""


def _clusters(articles: DataFrame, regions: DataFrame) -> DataFrame:
    own = articles.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count"), F.countDistinct("outlet_id").alias("outlet_count"), F.min("mention_time").alias("first_observed_at"), F.max("mention_time").alias("last_observed_at"))
    return own.join(regions, "cluster_id", "left")


@query(_CLUSTERS + "select cluster_id, article_count, outlet_count, first_observed_at, last_observed_at from cl order by outlet_count desc, article_count desc, last_observed_at desc, cluster_id limit 200")
def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = settle(_articles(spark, sf_dir))
    headers = _clusters(own, _regions(spark, sf_dir)).select("cluster_id", "first_observed_at", "last_observed_at")
    return snapshot.ranked_clusters(headers, own, 200).select("cluster_id", "article_count", "outlet_count", "first_observed_at", "last_observed_at")


# A story's locations: the nations of its line items' suppliers.
_PLACES = """
lo as (select l_orderkey as cluster_id, n_name as location_id, n_regionkey as region_code, max(round(1 - l_discount, 6)) as confidence, count(*) as evidence_count
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all)
"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = A.table(spark, sf_dir, "supplier"), A.table(spark, sf_dir, "nation")
    outlets = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name", "n_regionkey")
    own = A.table(spark, sf_dir, "lineitem").join(outlets, "l_suppkey")
    return own.groupBy(F.col("l_orderkey").alias("cluster_id"), F.col("n_name").alias("location_id"), F.col("n_regionkey").alias("region_code")).agg(F.max(F.round(1 - F.col("l_discount"), 6)).alias("confidence"), F.count(F.lit(1)).alias("evidence_count")).withColumn("location_type", F.lit("event"))


@query("with" + _PLACES + "select cluster_id, location_id, region_code, confidence, evidence_count from lo qualify row_number() over (partition by cluster_id order by confidence desc, evidence_count desc, location_id) = 1")
def primary_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.primary_locations(_places(spark, sf_dir)).select("cluster_id", "location_id", "region_code", "confidence", "evidence_count")


_LIST = _CLUSTERS + "," + _PLACES + """,
pl as (select cluster_id, location_id as primary_location_id, confidence as primary_confidence from lo qualify row_number() over (partition by cluster_id order by confidence desc, evidence_count desc, location_id) = 1)
"""


def _listed(spark: SparkSession, sf_dir: str, q: serving.StoryQuery) -> DataFrame:
    clusters = _clusters(_articles(spark, sf_dir), _regions(spark, sf_dir)).withColumn("raw_article_count", F.col("article_count"))
    places = settle(_places(spark, sf_dir)).withColumn("region_code", F.concat(F.lit("R"), F.col("region_code")))
    return serving.list_stories(clusters, places, q).select("cluster_id", "article_count", "outlet_count", "first_observed_at", "last_observed_at", "primary_location_id", "primary_confidence")


@query(_LIST + "select cluster_id, article_count, outlet_count, first_observed_at, last_observed_at, primary_location_id, primary_confidence from (select * from cl order by article_count desc, last_observed_at desc, cluster_id limit 100 offset 20) left join pl using (cluster_id)")
def story_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, serving.StoryQuery(limit=100, offset=20))


@query(_LIST + """
select cluster_id, article_count, outlet_count, first_observed_at, last_observed_at, primary_location_id, primary_confidence from (
  select * from cl where cluster_id in (select cluster_id from lo where region_code = 2) and last_observed_at >= timestamp '1998-01-01' and first_observed_at <= timestamp '2001-01-01'
  order by article_count desc, last_observed_at desc, cluster_id limit 100) left join pl using (cluster_id)
""")
def story_list_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, serving.StoryQuery(region="R2", since=datetime(1998, 1, 1), until=datetime(2001, 1, 1), limit=100))


@query(_REGIONAL + "," + _PLACES + """
select c.cluster_id, c.articles, l.locations, p.regions from (
  select event_id as cluster_id, string_agg(outlet_id || ':' || document_id, ',' order by mention_time desc, outlet_id, document_id) as articles from ar group by all) c
left join (select cluster_id, string_agg(location_id, ',' order by confidence desc, location_id) as locations from lo group by all) l using (cluster_id)
left join (select cluster_id, string_agg(region, ',' order by round(score, 9) desc, region) as regions from pr group by all) p using (cluster_id)
""")
def story_detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = settle(_articles(spark, sf_dir))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    articles = own.select("cluster_id", F.concat_ws(":", pad("outlet_id"), pad("document_id")).alias("article_id"), F.concat_ws(":", "outlet_id", "document_id").alias("name"), F.col("mention_time").alias("published_at"))
    places = _places(spark, sf_dir)
    ids = own.select("cluster_id").distinct()
    claims = A.claims(spark, sf_dir).join(ids, "cluster_id", "left_semi").select("cluster_id", "claim_id", "confidence")
    shares = prominence.regional_prominence(own, _regions(spark, sf_dir)).withColumn("score", F.round("score", 9))
    full = serving.story_details(ids, articles, places, claims, shares)
    joined = lambda c: F.array_join(c, ",")
    return full.select("cluster_id", joined(F.col("articles.name")).alias("articles"), F.nullif(joined(F.col("locations.location_id")), F.lit("")).alias("locations"), F.nullif(joined(F.col("regional_prominence.region")), F.lit("")).alias("regions"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("source"), status.alias("status"), F.col("ts").alias("started_at"))


@query("""
with e as (select *, timestamp '2024-01-31' as now from events)
select max(ts) as latest_story_at, greatest(0, floor(epoch(any_value(now)) - epoch(max(ts))))::bigint as freshness_age_seconds, count(*) filter (ts >= now - interval 24 hours) as cluster_count_24h,
  count(*) filter (ts >= now - interval 24 hours) as article_count_24h, count(*) filter (event_type = 'error' and ts >= now - interval 24 hours) as failures_24h,
  count(distinct event_type) filter (event_type <> 'error' and ts >= now - interval 24 hours) as active_source_count,
  arg_max(event_id, (ts, event_id)) as latest_run_id, case arg_max(event_type, (ts, event_id)) when 'error' then 'failed' else 'succeeded' end as latest_run_status,
  case when max(ts) is null then 'unavailable' when greatest(0, floor(epoch(any_value(now)) - epoch(max(ts)))) > 1800 or arg_max(event_type, (ts, event_id)) = 'error' then 'degraded' else 'ok' end as status
from e
""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    own = serving.health(runs.select(F.col("started_at").alias("last_observed_at")), runs.select(F.col("started_at").alias("published_at")), runs, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return own.drop("reasons")


def _rolling(window: str) -> Query:
    def count(spark: SparkSession, sf_dir: str) -> DataFrame:
        now = F.lit(NOW).cast("timestamp_ntz")
        own = A.table(spark, sf_dir, "events").where(F.col("ts").between(F.lit(window_start(window, NOW)).cast("timestamp_ntz"), now))
        return own.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.min(age_seconds(F.col("ts"), now)).alias("youngest"))

    return count


for _name, _hours in (("6h", 6), ("24h", 24), ("7d", 168)):
    QUERIES[f"rolling_window_{_name}"] = _rolling(_name)
    ORACLES[f"rolling_window_{_name}"] = f"""
select event_type, count(*) as n, count(distinct user_id) as users, min(floor(epoch(timestamp '2024-01-31') - epoch(ts)))::bigint as youngest
from events where ts between timestamp '2024-01-31' - interval {_hours} hours and timestamp '2024-01-31' group by event_type
"""


@query("select time_bucket(interval 60 seconds, ts, timestamp '1970-01-01') as window_start, user_id, count(*) as requests, greatest(0, count(*) - 2) as over from events group by all")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micro_batch.limited(A.table(spark, sf_dir, "events"), "user_id", "ts", limit=2)


@query("""
with one as (select doc_id, lang as market, source as domain from documents where lang is not null),
by_outlet as (select market, domain, count(*) as n from one group by all),
totals as (select domain, sum(n) as total from by_outlet group by all)
select market, sum(n)::bigint as raw_article_count, count(*) as unique_outlet_count, round(sum(n / total) / (select count(*) from totals), 9) as source_normalized_share
from by_outlet join totals using (domain) group by market
""")
def market_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), F.col("source").alias("domain"), F.col("lang").alias("market"), F.upper("lang").alias("label"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit(0.9).alias("confidence")
    )
    return signals.market_heat(own).select("market", "raw_article_count", "unique_outlet_count", F.round("source_normalized_share", 9).alias("source_normalized_share"))


_CLAIMS = """
with cm as (select l_orderkey as cluster_id, concat_ws(':', l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_quantity, l_extendedprice) as claim_id, l_partkey as normalized_claim,
  case l_returnflag when 'A' then 'supports' when 'R' then 'disputes' else 'unclear' end as stance, round(1 - l_discount, 6) as confidence, s_nationkey as network, l_orderkey || ':' || l_suppkey as article_id
  from lineitem left join supplier on l_suppkey = s_suppkey)
"""


@query(_CLAIMS + """,
pairs as (select s.cluster_id, s.normalized_claim, s.claim_id as support_claim, d.claim_id as dispute_claim, least(s.confidence, d.confidence) as confidence,
  row_number() over (partition by s.cluster_id order by r.c desc, r.i, s.confidence desc, s.claim_id, d.confidence desc, d.claim_id) as k
  from cm s join cm d on s.cluster_id = d.cluster_id and s.normalized_claim = d.normalized_claim and s.network <> d.network and s.stance = 'supports' and d.stance = 'disputes'
  join (select cluster_id, normalized_claim, max(confidence) as c, arg_min(claim_id, (-confidence, claim_id)) as i from cm group by all) r on r.cluster_id = s.cluster_id and r.normalized_claim = s.normalized_claim),
every as (select cluster_id, min(confidence) as least, count(distinct network) as networks from cm group by all)
select e.cluster_id, case when networks < 2 then 'not_assessed' when p.cluster_id is not null then 'detected' else 'not_detected' end as status,
  case when networks < 2 then null else coalesce(p.confidence, least) end as confidence, case when networks >= 2 then p.normalized_claim end as normalized_claim
from every e left join pairs p on e.cluster_id = p.cluster_id and k = 1
""")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.conflicts(A.claims(spark, sf_dir)).select("cluster_id", "status", "confidence", "normalized_claim")


@query(_CLAIMS + "select article_id, case when count(distinct stance) > 1 then 'mixed' else min(stance) end as framing, min(confidence) as confidence from cm group by article_id")
def framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = A.claims(spark, sf_dir)
    return signals.framing(claims.select(F.col("evidence_article_id").alias("article_id")), claims)


@query(_CLAIMS + "select article_id, case when bool_or(stance = 'disputes') then 'disputes' when bool_or(stance = 'supports') then 'supports' else 'unclear' end as claim_position from cm group by article_id")
def claim_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = A.claims(spark, sf_dir)
    return signals.claim_positions(claims.select(F.col("evidence_article_id").alias("article_id")), claims)


# Stories of GATED and _REGIONAL with places: each in each of its regions by its best place there, and the rollup of regions; {stories} are those that count.
_ROLLUP = """,
one as (select cluster_id, region_code, arg_min(location_id, (-confidence, -evidence_count, location_id)) as label, max(confidence) as confidence from lo where cluster_id in (select cluster_id from {stories}) group by all),
pl2 as (select o.*, cl.article_count as raw, coalesce(score, 0) as normalized from one o join cl using (cluster_id) left join pr using (cluster_id)),
so as (select region_code, count(distinct outlet_id) as source_count from one join ar on event_id = cluster_id group by all)
select region_code as region, arg_min(label, (-confidence, cluster_id)) as label, sum(raw)::bigint as raw_prominence, round(max(normalized), 9) as normalized_prominence, count(*) as story_count, any_value(source_count) as source_count
from pl2 join so using (region_code) group by region_code
"""


def _served(spark: SparkSession, sf_dir: str, in_order: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, locations, articles) with the columns of the serving tables. in_order: as for regional_prominence."""
    own, regions = settle(_articles(spark, sf_dir)), settle(_regions(spark, sf_dir))
    primary = prominence.primary_prominence(prominence.regional_prominence(own, regions, in_order), regions)
    clusters = _clusters(own, regions).join(primary, "cluster_id", "left").withColumn("raw_article_count", F.col("article_count")).withColumn("normalized_prominence", F.coalesce("normalized_prominence", F.lit(0.0)))
    none = F.lit(None).cast("string")
    locations = settle(_places(spark, sf_dir)).select("*", F.col("location_id").alias("label"), F.lit("country").alias("granularity"), none.alias("country_code"), F.lit("a").alias("evidence_article_id"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"))
    articles = own.select("cluster_id", F.col("outlet_id").alias("domain"), (F.col("outlet_id") % 3).alias("language"), (F.col("confidence") / 100).alias("membership_confidence"))
    return settle(clusters), locations, articles


@query(_LIST.replace("with ev", "with ev", 1).replace(_CLUSTERS, _REGIONAL + "," + _CLUSTERS[len(GATED) + 1:], 1) + _ROLLUP.format(stories="cl"))
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, locations, articles = _served(spark, sf_dir)
    own = signals.region_rollup(clusters.select("cluster_id", F.col("raw_article_count").alias("raw"), F.col("normalized_prominence").alias("normalized")), locations.withColumn("region", F.col("region_code")), articles)
    return own.select("region", "label", "raw_prominence", F.round("normalized_prominence", 9).alias("normalized_prominence"), "story_count", "source_count")


_SEEN = datetime(2000, 6, 1)
_RECENT = _LIST.replace(_CLUSTERS, _REGIONAL + "," + _CLUSTERS[len(GATED) + 1:], 1) + """,
st as (select cl.*, region_code as primary_region from cl join (select cluster_id, region_code from lo qualify row_number() over (partition by cluster_id order by confidence desc, evidence_count desc, location_id) = 1) using (cluster_id)
  where last_observed_at >= timestamp '2000-06-01' - interval 7 days and first_observed_at <= timestamp '2000-06-01')
"""


@query(_RECENT + """
select cluster_id, primary_region, count(distinct outlet_id) as outlet_count, count(distinct outlet_id % 3) as language_count, round(avg(confidence / 100), 9) as membership_confidence, any_value(round(coalesce(score, 0), 9)) as normalized_prominence
from st join ar on event_id = cluster_id left join pr using (cluster_id) group by cluster_id, primary_region
""")
def intelligence_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, locations, articles = _served(spark, sf_dir)
    stories, _ = serving.intelligence(clusters.drop("outlet_count"), locations, articles, "7d", _SEEN)
    return stories.select("cluster_id", "primary_region", "outlet_count", "language_count", F.round("membership_confidence", 9).alias("membership_confidence"), F.round("normalized_prominence", 9).alias("normalized_prominence"))


@query(_RECENT + _ROLLUP.format(stories="st"))
def intelligence_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, locations, articles = _served(spark, sf_dir)
    _, regions = serving.intelligence(clusters.drop("outlet_count"), locations, articles, "7d", _SEEN)
    return regions.select("region", "label", "raw_prominence", F.round("normalized_prominence", 9).alias("normalized_prominence"), "story_count", "source_count")


@query(_RECENT + """,
one as (select cluster_id, region_code from lo where cluster_id in (select cluster_id from st) group by all)
select region_code as region, row_number() over (partition by region_code order by coalesce(score, 0) desc, cl.article_count desc, cluster_id desc) as rank, cluster_id, cl.article_count as raw from one join cl using (cluster_id) left join pr using (cluster_id)
""")
def region_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, locations, articles = _served(spark, sf_dir, in_order=True)
    stories, _ = serving.intelligence(clusters.drop("outlet_count"), locations, articles, "7d", _SEEN)
    own = stories.select("cluster_id", F.col("raw_article_count").alias("raw"), F.col("normalized_prominence").alias("normalized"))
    return signals.region_stories(own, locations.withColumn("region", F.col("region_code"))).select("region", "rank", "cluster_id", "raw")


_FNV = "lower(lpad(to_hex(list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint)), 8, '0'))"


@query("select page_id, 'article_' || " + _FNV.format("url") + " as article_id, 'content_' || " + _FNV.format("(url || '|' || page_id)") + " as content_id from pages")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", X.stable_id("article", F.col("url")).alias("article_id"), X.stable_id("content", F.concat_ws("|", "url", "page_id")).alias("content_id"))


_URL = "regexp_extract(url, '^([A-Za-z]+)://([^/?#:]+)([^?#]*)(?:\\?([^#]*))?', {0})"


_CANONICAL = f"""
p as (select page_id, lower({_URL.format(1)}) as scheme, lower({_URL.format(2)}) as host, {_URL.format(3)} as path, list_sort(list_filter(string_split({_URL.format(4)}, '&'), lambda x: x <> '' and not starts_with(lower(x), 'utm_'))) as q from pages),
cu as (select page_id, scheme || '://' || host || case when path in ('', '/') then '/' else regexp_replace(path, '/+$', '') end || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as canonical_url from p)
"""


@query("with" + _CANONICAL + "select page_id, canonical_url from cu")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical_url"))


@query(f"select regexp_replace(lower({_URL.format(2)}), '^www\\.', '') as domain, count(*) as n from pages group by 1")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


_TITLE = """
tl as (select page_id, url, nullif(substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&apos;', ''''), '&gt;', '>'), '&lt;', '<'), '&nbsp;', ' '), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')), 1, 600), '') as title from pages)
"""


@query("with" + _TITLE + "select page_id, title from tl")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pages(spark, sf_dir).select("page_id", "title")


_WORDS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[\\pL\\pN]+'), lambda t: length(t) > 1 and t not in ({_WORDS}))))"


@query("with" + _TITLE + f"select page_id, array_to_string({_TOKENS}, ' ') as title_key, len({_TOKENS}) as n_tokens from tl where title is not null")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.pages(spark, sf_dir).where("title is not null")
    return own.select("page_id", X.title_set_key(F.col("title")).alias("title_key"), F.size(X.title_tokens(F.col("title"))).cast("long").alias("n_tokens"))


@query("with" + _TITLE + f""",
tk as (select page_id, {_TOKENS} as t from tl),
cl as (select t, min(page_id) as page_id from tk where len(t) > 0 group by t),
pairs as (select l.page_id as a, r.page_id as b, len(list_intersect(l.t, r.t)) as k, len(l.t) + len(r.t) as n from cl l join cl r on l.page_id < r.page_id)
select a, b, round(k / (n - k), 9) as similarity from pairs where k / (n - k) >= 0.3
""")
def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = settle(A.pages(spark, sf_dir).select("page_id", X.title_tokens(F.coalesce("title", F.lit(""))).alias("t")))
    pairs = clustering.candidate_pairs(own, "page_id", "t", 0.3)
    l, r = own.alias("l"), own.alias("r")  # noqa: E741
    both = pairs.join(l, F.col("a") == F.col("l.page_id")).join(r, F.col("b") == F.col("r.page_id"))
    return both.select("a", "b", F.round(N.jaccard(F.col("l.t"), F.col("r.t")), 9).alias("similarity")).where("similarity >= 0.3")


@query("""
with w as (select item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), ' '), lambda x: x <> '') as every from benchmark),
s as (select item_id, every, every[1:1200] as w from w)
select item_id, md5(array_to_string(list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))), '|')) as shingles,
  md5(array_to_string(list_sort(list_distinct(list_filter(every, lambda x: length(x) >= 4)[1:900])), '|')) as words from s
""")
def word_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda x: F.md5(F.array_join(F.array_sort(x), "|"))
    return A.table(spark, sf_dir, "benchmark").select("item_id", digest(X.word_shingles(F.col("text"))).alias("shingles"), digest(X.text_tokens(F.col("text"))).alias("words"))


def _page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles: titled, by canonical URL, at a time that follows from the page's number."""
    own = A.pages(spark, sf_dir).where("title is not null")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 600)
    return own.select(F.lpad(F.col("page_id").cast("string"), 10, "0").alias("article_id"), "canonical_url", "url", "title", at.alias("published_at"), at.alias("retrieved_at"), F.col("domain").alias("outlet_id"), "domain", F.lit(None).cast("string").alias("summary"))


_NAMES = "list_distinct(list_transform(regexp_extract_all(title || '. ', '\\p{Lu}[\\pL\\pM''’-]*(?:\\s+\\p{Lu}[\\pL\\pM''’-]*){0,3}'), lambda x: lower(x)))"
_SHARE = "len(list_intersect(l.{0}, r.{0})) / (len(l.{0}) + len(r.{0}) - len(list_intersect(l.{0}, r.{0})))"
_SAID = "case when {0} >= {1} then '{2}' || printf('%.2f', floor({0} * 100 + 0.5) / 100) || '{3}' end"


@query("with" + _TITLE + f""",
pt as (select lpad(page_id::varchar, 10, '0') as id, page_id * 600 / 3600.0 as h, {_TOKENS} as t, {_NAMES} as n from tl where title is not null),
parts as (
  select l.id as a, r.id as b, case when len(l.t) + len(r.t) = 0 then 0.0 else {_SHARE.format("t")} end as title, case when len(l.n) > 0 and len(r.n) > 0 then {_SHARE.format("n")} end as entities, exp(-abs(l.h - r.h) / 36) as near
  from pt l join pt r on l.id < r.id),
scored as (select *, (title * 0.38 + coalesce(entities * 0.23, 0) + near * 0.14) / (0.38 + 0.14 + case when entities is null then 0 else 0.23 end) as score from parts)
select a, b, round(score, 6) as score, coalesce(nullif(concat_ws('; ', {_SAID.format("title", 0.45, "title token overlap ", "")}, {_SAID.format("entities", 0.35, "named-entity overlap ", "")}, {_SAID.format("near", 0.7, "publication times are close (", ")")}), ''), 'weighted similarity ' || printf('%.2f', floor(score * 100 + 0.5) / 100)) as reasons
from scored where score >= 0.5
""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = clustering.scored_pairs(_page_articles(spark, sf_dir))
    return own.select("a", "b", N.rounded(F.col("score"), 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


# One article after another, each with its scores with all before it; the groups so far are a list.
@query("with recursive" + _TITLE + "," + _CANONICAL + f""",
pt as (select lpad(page_id::varchar, 10, '0') as id, page_id * 600 / 3600.0 as h, {_TOKENS} as t, {_NAMES} as n from tl join cu using (page_id) where title is not null qualify row_number() over (partition by canonical_url order by page_id) = 1),
od as (select *, row_number() over (order by h, id) as i from pt),
parts as (
  select l.i as j, r.i as i, case when len(l.t) + len(r.t) = 0 then 0.0 else {_SHARE.format("t")} end as title, case when len(l.n) > 0 and len(r.n) > 0 then {_SHARE.format("n")} end as entities, exp(-abs(l.h - r.h) / 36) as near
  from od l join od r on l.i < r.i),
sc as materialized (select j, i, round((title * 0.38 + coalesce(entities * 0.23, 0) + near * 0.14) / (0.38 + 0.14 + case when entities is null then 0 else 0.23 end), 12) as score from parts),
rows as materialized (select i, list(score order by j) as s from sc group by i),
g as (
  select 1::bigint as i, [1::bigint] as grp, [1.0::double] as conf, [null::bigint] as matched, [null::double] as mean
  union all
  select i, list_append(grp, coalesce(best.k, list_max(grp) + 1)), list_append(conf, coalesce(best.top, 1.0)), list_append(matched, best.at), list_append(mean, best.mean)
  from (
    select rows.i, grp, conf, matched, mean,
      list_sort(list_filter(list_transform(list_distinct(list_filter(grp, lambda k, p: s[p] >= 0.5)), lambda k: {{
        'low': -list_max(list_filter(s, lambda x, p: grp[p] = k)), 'k': k, 'top': list_max(list_filter(s, lambda x, p: grp[p] = k)), 'mean': list_avg(list_filter(s, lambda x, p: grp[p] = k)),
        'at': list_min(list_filter(range(1, len(grp) + 1), lambda p: grp[p] = k and s[p] = list_max(list_filter(s, lambda x, q: grp[q] = k))))}}), lambda c: c.top >= 0.5 and round(c.mean, 11) >= 0.42))[1] as best
    from g join rows on rows.i = g.i + 1)),
fin as (select unnest(range(1, len(grp) + 1)) as i, unnest(grp) as grp, unnest(conf) as conf, unnest(matched) as matched, unnest(mean) as mean from (select * from g order by i desc limit 1)),
mem as (select fin.*, od.id, row_number() over (partition by grp order by fin.i) - 1 as position from fin join od on od.i = fin.i),
oth as (select a.i, coalesce(round(avg(score), 11), 1.0) as own from mem a left join mem b on a.grp = b.grp and a.i <> b.i left join sc on sc.i = greatest(a.i, b.i) and sc.j = least(a.i, b.i) group by a.i),
can as (select grp, arg_min(id, (-own, position)) as canonical from mem join oth using (i) group by grp),
ids as (select grp, string_agg(id, '|' order by id) as every from mem group by grp)
select 'cluster_' || {_FNV.format("every")} as cluster_id, mem.id as article_id, position::int as position, round(conf, 6) as confidence, m.id as matched_article_id, round(mean, 6) as average, mem.id = canonical as is_canonical
from mem join ids using (grp) join can using (grp) left join od m on m.i = mem.matched
""")
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters_of(_page_articles(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("confidence", "average")})


_MERGED = GATED + """,
top as (select event_id, arg_min(title, (-confidence, -epoch_us(mention_time), document_id)) as title from ar group by all),
allkeys as (select event_id, 'l' || title || '|' || region as k from top join ev using (event_id) union select t.event_id, 'd' || t.title || '|' || a.document_id from top t join ar a on t.event_id = a.event_id),
link as (select distinct a.event_id as u, b.event_id as v from allkeys a join allkeys b using (k)),
lab as (with recursive r(u, v) as (select u, v from link union select r.u, link.v from r join link on r.v = link.u) select u as cluster_id, min(v) as merged_id from r group by u)
"""


@query(_MERGED + "select cluster_id, merged_id from lab")
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(settle(_articles(spark, sf_dir)), _regions(spark, sf_dir)).select("cluster_id", "merged_id")


def _headers(articles: DataFrame) -> DataFrame:
    order = F.struct((-F.col("confidence")).alias("a"), (-F.unix_micros(F.col("mention_time").cast("timestamp"))).alias("b"), F.col("document_id").alias("c"))
    return articles.groupBy("cluster_id").agg(F.min_by("title", order).alias("title"), F.min("mention_time").alias("first_observed_at"), F.max("mention_time").alias("last_observed_at"))


def _merged(own: DataFrame, regions: DataFrame) -> DataFrame:
    return merge.merged_ids(_headers(own), own.select("cluster_id", F.col("document_id").cast("string").alias("canonical_url")), regions.withColumnRenamed("region", "location_key"))


def _half(spark: SparkSession, sf_dir: str, every: DataFrame, old: bool) -> snapshot.Snapshot:
    """The stories of events before a day, or from it on, as a snapshot."""
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    dated = A.events(spark, sf_dir).where(F.col("date_added") < cut if old else F.col("date_added") >= cut).select(F.col("event_id").alias("cluster_id"))
    own = settle(every.join(dated, "cluster_id", "left_semi"))
    name = F.col("document_id").cast("string")
    articles = own.select("cluster_id", name.alias("article_id"), name.alias("canonical_url"), "outlet_id", F.col("confidence").alias("provider_score"), F.col("mention_time").alias("published_at"))
    places = _regions(spark, sf_dir).join(own.select("cluster_id").distinct(), "cluster_id", "left_semi")
    locations = places.select("cluster_id", F.col("region").alias("location_id"), F.col("region").alias("location_key"), F.col("region").alias("country"), F.lit(None).cast("string").alias("admin1"), F.lit(1.0).alias("confidence"), F.array(F.struct(F.lit("place").alias("quote"))).alias("evidence"))
    return snapshot.Snapshot(_headers(own), articles, locations, prominence.regional_prominence(own, places), spark.range(1))


@query(_MERGED + """,
art as (select merged_id as cluster_id, document_id, arg_min(outlet_id, (-confidence, event_id)) as outlet_id from ar join lab on lab.cluster_id = event_id group by all),
hd as (select merged_id as cluster_id, max(mention_time) as last_observed_at from ar join lab on lab.cluster_id = event_id group by all),
kept as (select cluster_id from art join hd using (cluster_id) group by cluster_id order by count(distinct outlet_id) desc, count(*) desc, any_value(last_observed_at) desc, cluster_id limit 300),
rg as (select distinct merged_id as cluster_id, region from ev join lab on lab.cluster_id = event_id),
co as (select region, cluster_id, outlet_id, count(*) as n from art join rg using (cluster_id) where cluster_id in (select cluster_id from kept) group by all),
ot as (select region, outlet_id, sum(n) as total from co group by all),
rt as (select region, sum(total) as regional_articles, count(*) as regional_outlets from ot group by all),
sh as (select co.region, cluster_id, sum(n)::bigint as article_count, count(*) as outlet_count, sum(n / total) as own from co join ot using (region, outlet_id) group by all)
select cluster_id, region, article_count, outlet_count, round((article_count / regional_articles + own / regional_outlets) / 2, 9) as score from sh join rt using (region)
""")
def compose_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = settle(_articles(spark, sf_dir))
    both = snapshot.composed([_half(spark, sf_dir, own, True), _half(spark, sf_dir, own, False)], 300)
    return both.prominence.select("cluster_id", "region", "article_count", "outlet_count", F.round("score", 9).alias("score"))


@query(_MERGED + """,
m as (select ar.*, merged_id as cluster_id, case when outlet_id % 2 = 0 then ['even', 'surely'] else ['odd'] end as reasons from ar join lab on lab.cluster_id = event_id),
cl as (select merged_id as cluster_id, l_partkey as claim, l_returnflag as polarity, round(1 - l_discount, 6) as confidence, l_suppkey from lineitem join lab on lab.cluster_id = l_orderkey)
select 'header' as kind, cluster_id, arg_min(title, event_id) as item, null::double as value, count(*)::varchar as detail from (
  select merged_id as cluster_id, top.title, event_id from top join lab on lab.cluster_id = event_id) group by cluster_id
union all select 'article', cluster_id, document_id::varchar, max(confidence), arg_min(outlet_id, (-confidence, event_id))::varchar from m group by cluster_id, document_id
union all select 'membership', cluster_id, document_id::varchar, max(confidence), min(outlet_id) || ':' || case when count(*) > 1 then array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') else array_to_string(any_value(reasons), ',') end from m group by cluster_id, document_id
union all select 'location', merged_id, region, 1.0, '1' from (select distinct merged_id, region from ev join lab on lab.cluster_id = event_id)
union all select 'claim', cluster_id, claim || polarity, max(confidence), count(distinct l_suppkey)::varchar from cl group by cluster_id, claim, polarity
""")
def merge_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = settle(_articles(spark, sf_dir))
    ids = settle(_merged(own, _regions(spark, sf_dir)).select("cluster_id", "merged_id"))
    name = F.col("document_id").cast("string")
    none = F.lit(None).cast("double")
    headers = merge.merged_headers(_headers(own), ids).select(F.lit("header").alias("kind"), "cluster_id", F.col("title").alias("item"), none.alias("value"), F.col("merged_from").cast("string").alias("detail"))
    articles = own.select("cluster_id", name.alias("article_id"), name.alias("canonical_url"), "outlet_id", F.col("confidence").alias("provider_score"), F.col("mention_time").alias("published_at"))
    articles = merge.merged_articles(articles, ids).select(F.lit("article"), "cluster_id", "article_id", "provider_score", F.col("outlet_id").cast("string"))
    reasons = F.when(F.col("outlet_id") % 2 == 0, F.array(F.lit("even"), F.lit("surely"))).otherwise(F.array(F.lit("odd")))
    members = own.select("cluster_id", name.alias("article_id"), "confidence", F.col("outlet_id").alias("matched_article_id"), F.lit(0.8).alias("threshold"), F.lit("c").alias("components"), reasons.alias("reasons"))
    members = merge.merged_memberships(members, ids).select(F.lit("membership"), "cluster_id", "article_id", "confidence", F.concat_ws(":", "matched_article_id", F.array_join("reasons", ",")))
    places = _regions(spark, sf_dir).select("cluster_id", F.col("region").alias("location_key"), F.lit(1.0).alias("confidence"), F.array(F.lit("place")).alias("evidence"))
    places = merge.merged_locations(places, ids).select(F.lit("location"), "cluster_id", "location_key", "confidence", F.size("evidence").cast("string"))
    claims = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").cast("string").alias("claim_id"), F.lit("t").alias("text"), F.col("l_returnflag").alias("polarity"), F.round(1 - F.col("l_discount"), 6).alias("confidence"), F.array("l_suppkey").alias("evidence"))
    claims = merge.merged_claims(claims, ids).select(F.lit("claim"), "cluster_id", F.concat("claim_id", "polarity"), "confidence", F.size("evidence").cast("string"))
    return headers.unionAll(articles).unionAll(members).unionAll(places).unionAll(claims)


def _line(fields: dict[int, Column], width: int) -> Column:
    """A row of tab-separated text with these fields, the others empty."""
    return F.concat_ws("\t", *[F.coalesce(fields[i].cast("string"), F.lit("")) if i in fields else F.lit("") for i in range(width)])


@query("""
select 'event' as kind, o_orderkey::varchar as id, case when o_orderkey % 11 <> 0 then o_orderdate end as at,
  case when o_custkey * 37 % 200 - 100 between -90 and 90 and o_custkey % 4 <> 0 then 'Place ' || o_custkey end as name, o_orderkey % 11 <> 0 as valid from orders
union all select 'mention', l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || l_partkey, l_shipdate, case when l_linenumber % 3 <> 2 then (l_linenumber % 3 = 1)::varchar end,
  l_linenumber % 3 <> 2 and l_quantity * 3 <= 100 and l_partkey % 9 <> 0 from lineitem
union all select 'document', p_partkey::varchar, timestamp '2024-01-02 03:04:05', case when p_partkey % 5 <> 0 then p_name || ' & more – live' end, p_partkey % 7 <> 0 from part
""")
def batch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    url = lambda c, good: F.concat(F.when(good, "https").otherwise("ftp"), F.lit("://wire.example/"), c)
    orders = A.table(spark, sf_dir, "orders")
    place = {51: F.lit(4), 52: F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("Place "), "o_custkey")), 56: F.col("o_custkey") * 37 % 200 - 100, 57: F.lit(12.5), 58: F.lit("f")}
    lines = orders.select(F.monotonically_increasing_id().alias("ord"), _line({0: F.col("o_orderkey"), **place, 59: F.when(F.col("o_orderkey") % 11 != 0, stamp("o_orderdate")).otherwise("2024"), 60: F.lit("https://wire.example/x")}, 61).alias("value"))
    events = batch.parsed_events(lines).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("date_added").cast("timestamp_ntz").alias("at"), F.col("geo.full_name").alias("name"), "valid")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    raw = F.when(F.col("l_linenumber") % 3 == 2, "x").otherwise((F.col("l_linenumber") % 3).cast("string"))
    lines = A.table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("ord"), _line({0: key, 1: stamp("l_shipdate"), 2: stamp("l_shipdate"), 3: F.lit(1), 4: F.lit("wire"), 5: url(key, F.col("l_partkey") % 9 != 0), 6: F.lit(1), 10: raw, 11: F.col("l_quantity") * 3}, 15).alias("value"))
    mentions = batch.parsed_mentions(lines).select(F.lit("mention"), "event_id", F.col("mention_time").cast("timestamp_ntz"), F.col("in_raw_text").cast("string"), "valid")
    title = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("<PAGE_TITLE>"), "p_name", F.lit(" &amp;  more &#x2013; live</PAGE_TITLE>")))
    lines = A.table(spark, sf_dir, "part").select(F.monotonically_increasing_id().alias("ord"), _line({0: F.col("p_partkey"), 1: F.lit("20240102030405"), 2: F.col("p_size"), 3: F.lit("wire"), 4: url(F.col("p_partkey").cast("string"), F.col("p_partkey") % 7 != 0), 26: title}, 27).alias("value"))
    documents = batch.parsed_documents(lines).select(F.lit("document"), "record_id", F.col("published_at").cast("timestamp_ntz"), "title", "valid")
    return events.unionAll(mentions).unionAll(documents)


@query("""
with s as (select s_suppkey as k, s_nationkey as n, s_acctbal as a from supplier),
i as (
  select k, unnest(list_filter([
    case when a / 9000 < 0 or a / 9000 > 1 then 'locations.confidence invalid_confidence' end, case when abs(k * 37 % 200 - 100) > 90 then 'locations.latitude invalid_latitude' end,
    case when abs(k * 53 % 400 - 200) > 180 then 'locations.longitude invalid_longitude' end, case when k % 5 = 0 then 'locations.evidence missing_location_evidence' end,
    case when k % 5 <> 0 and k % 7 = 0 then 'locations.evidence.url invalid_url' end, case when k % 5 <> 0 and k % 11 = 0 then 'locations.evidence.quote empty_quote' end,
    case when k % 5 <> 0 and k % 13 = 0 then 'locations.evidence.method invalid_event_location_evidence_method' end, case when k % 5 <> 0 and n > 19 then 'locations.evidence.article_id unknown_evidence_article' end,
    case when a / 9000 < 0 or a / 9000 > 1 then 'claims.confidence invalid_confidence' end, case when k % 5 = 0 then 'claims.evidence missing_claim_evidence' end,
    case when k % 5 <> 0 and k % 7 = 0 then 'claims.evidence.url invalid_url' end, case when k % 5 <> 0 and k % 11 = 0 then 'claims.evidence.quote empty_quote' end,
    case when k % 5 <> 0 and n > 19 then 'claims.evidence.article_id unknown_evidence_article' end,
    case when n < 3 then 'prominence.raw invalid_raw_prominence' end, case when k % 17 = 0 then 'prominence.basis invalid_prominence_basis' end, case when a / 9000 < 0 or a / 9000 > 1 then 'prominence.score invalid_confidence' end,
    case when k % 17 = 0 then 'region invalid_region' end, case when k % 17 <> 0 and k % 7 = 0 then 'region.code missing_region_code' end, case when k % 17 <> 0 and k % 11 = 0 then 'region.label missing_region_label' end,
    case when k % 17 <> 0 and abs(k * 37 % 200 - 100) > 90 then 'region.latitude invalid_latitude' end, case when k % 17 <> 0 and (k % 3 = 0 or abs(k * 53 % 400 - 200) > 180) then 'region.longitude invalid_longitude' end,
    case when n > 12 then 'health.successful_source_count invalid_health_counts' end,
    case when k % 4 = 1 and a < 0 then 'tone.confidence invalid_confidence' end, case when k % 4 = 1 and k % 7 = 0 then 'tone.value invalid_tone' end, case when k % 4 = 1 and k % 5 = 0 then 'tone.evidence missing_assessment_evidence' end,
    case when k % 4 = 0 and k % 11 = 0 then 'tone.reason missing_unknown_reason' end, case when k % 4 = 2 then 'tone.status invalid_assessment_status' end, case when k % 4 = 3 then 'tone missing_assessment' end
  ], lambda x: x is not null)) as issue from s)
select issue, count(*) as n from i group by issue
""")
def validation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, a = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    own = A.table(spark, sf_dir, "supplier").withColumn("cluster_id", k)
    lat, lon = (k * 37 % 200 - 100).cast("double"), (k * 53 % 400 - 200).cast("double")
    item = F.struct(n.alias("article_id"), F.when(k % 7 == 0, "ftp://h/x").otherwise("https://h.example/x").alias("url"), F.when(k % 11 == 0, " ").otherwise("q").alias("quote"), F.when(k % 13 == 0, "guess").otherwise("article_text").alias("method"))
    evidence = F.when(k % 5 != 0, F.array(item)).alias("evidence")
    articles = own.where(n <= 19).select("cluster_id", n.alias("article_id"))
    places = own.select("cluster_id", (a / 9000).alias("confidence"), lat.alias("latitude"), lon.alias("longitude"), evidence)
    found = validate.location_issues(places, articles).unionAll(validate.claim_issues(places.select("cluster_id", "confidence", "evidence"), articles))
    shares = own.select("cluster_id", (n - 3).alias("article_count"), n.alias("outlet_count"), (a / 9000).alias("score"), *[F.lit(0.5).alias(c) for c in ("article_share", "outlet_share", "source_normalized_share")], F.when(k % 17 == 0, "market").otherwise("event_location").alias("basis"))
    found = found.unionAll(validate.prominence_issues(shares))
    there = k % 3 != 0
    region = F.when(k % 17 != 0, F.struct(F.when(k % 7 != 0, "C").alias("code"), F.when(k % 11 != 0, "L").alias("label"), lat.alias("latitude"), F.when(there, lon).alias("longitude")))
    found = found.unionAll(validate.issues_of(own.withColumn("r", region), validate.region_rules(F.col("r"), "region")))
    found = found.unionAll(validate.health_issues(own.select("cluster_id", n.alias("successful_source_count"), F.lit(12).alias("source_count"))))
    text = lambda x: x.cast("string")
    kind = F.array(F.struct(F.lit("k").alias("kind")))
    observed = F.struct(F.lit("observed").alias("status"), F.when(k % 7 == 0, "wild").otherwise("neutral").alias("value"), F.when(a < 0, -1.0).otherwise(0.5).alias("confidence"), F.lit("model_analysis").alias("method"), text(F.lit(None)).alias("reason"), F.when(k % 5 != 0, kind).alias("evidence"))
    unknown = F.struct(F.lit("unknown").alias("status"), text(F.lit(None)).alias("value"), F.lit(None).cast("double").alias("confidence"), F.lit("unavailable").alias("method"), F.when(k % 11 != 0, "why").alias("reason"), kind_none(kind).alias("evidence"))
    odd = F.struct(F.lit("odd").alias("status"), text(F.lit(None)).alias("value"), F.lit(None).cast("double").alias("confidence"), F.lit("x").alias("method"), text(F.lit(None)).alias("reason"), kind_none(kind).alias("evidence"))
    tone = F.when(k % 4 == 0, unknown).when(k % 4 == 1, observed).when(k % 4 == 2, odd)
    found = found.unionAll(validate.issues_of(own.withColumn("t", tone), validate.assessment_rules("tone", F.col("t"), True)))
    return found.groupBy(F.concat_ws(" ", "path", "code").alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def kind_none(kind: Column) -> Column:
    """No evidence, of the same type."""
    return F.filter(kind, lambda x: F.lit(False))


_NAMED_PLACES = (("with", 1, "city"), ("and", 2, "country"), ("der", 3, "admin1"), ("le", 4, "point"), ("con", 5, "city"), ("con", 6, "city"), ("of the", 7, "city"), ("in the and of", 8, "country"), ("the", 9, "point"))


def _named(alias: str) -> str:
    """Whether a document's text, in lower case, has these words with white space between them."""
    inside = r"\pL\pN\pM''’.-"
    return rf"regexp_matches(t, '(^|[^{inside}]){alias.replace(' ', r'\s+')}($|[^{inside}]|[''’.-]+($|[^{inside}]))')"


@query(f"""
with places as (select * from (values {", ".join(map(str, _NAMED_PLACES))}) p(alias, place_id, kind)),
docs as (select doc_id, source, lower(text) as t from documents),
named as ({" union all ".join(f"select doc_id, source, '{a}' as alias from docs where {_named(a)}" for a in dict.fromkeys(a for a, *_ in _NAMED_PLACES))}),
amb as (select alias, count(*) as a from places group by all),
hit as (select place_id, doc_id, source, greatest(0, least(1, 0.58 + case kind when 'city' then 0.1 when 'admin1' then 0.07 when 'country' then 0.04 else 0.02 end - least(0.28, greatest(0, (a - 1) * 0.08))))::double as c from named join places using (alias) join amb using (alias))
select place_id, count(distinct doc_id) as articles, count(distinct source) as outlets, round(least(1.0, max(c) + (count(distinct doc_id) - 1) * 0.06 + (count(distinct source) - 1) * 0.04), 6) as confidence from hit group by place_id
""")
def gazetteer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(list(_NAMED_PLACES), "alias string, place_id long, kind string")
    texts = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("outlet_id"), F.lit("").alias("url"), F.lit("summary").alias("field"), "text")
    found = geocode.gazetteer_matches(texts, aliases, longest=4)
    own = geocode.event_locations(geocode.place_evidence(geocode.located_matches(found)))
    return own.select("place_id", "articles", "outlets", F.round("confidence", 6).alias("confidence"))


@query("""
with rg as (select * from (values ('src0', 'FR', 'market-fr', 0.9), ('src1', 'DE', 'market-de', 0.8), ('src7', 'US', 'market-us', 0.7)) r(domain, origin_code, market_code, market_confidence))
select source, origin_code, market_code, market_confidence, count(*) as n from documents left join rg on source = domain group by all
""")
def registry_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("src0", "FR", "market-fr", 0.9), ("src1", "DE", "market-de", 0.8), ("src7", "US", "market-us", 0.7)]
    profiles = spark.createDataFrame(rows, "registry_domain string, origin_code string, market_code string, market_confidence double")
    own = registry.with_profile(A.table(spark, sf_dir, "documents"), profiles, "source")
    return own.groupBy("source", "origin_code", "market_code", "market_confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""
with i as (
  select l_orderkey as cluster_id, 'invalid_confidence' as code from lineitem where not (l_quantity / 40 between 0 and 1)
  union all select l_orderkey, 'unknown_evidence_article' from lineitem where l_partkey not in (select p_partkey from part where p_size <= 40)
  union all select o_orderkey, 'empty_cluster' from orders where o_orderkey not in (select l_orderkey from lineitem)
  union all select l_orderkey, 'duplicate_article_id' from (select l_orderkey, row_number() over (partition by l_orderkey, l_partkey) as r from lineitem) where r > 1)
select code, count(*) as n, count(distinct cluster_id) as clusters from i group by code
""")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("article_id"), (F.col("l_quantity") / 40).alias("confidence"))
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cluster_id"), F.lit("t").alias("title"), F.col("o_orderdate").alias("first_observed_at"), F.col("o_orderdate").alias("last_observed_at"))
    url = F.lit("https://outlet.example/a")
    articles = lines.select("cluster_id", "article_id", url.alias("url"), F.concat(url, F.monotonically_increasing_id()).alias("canonical_url"), F.lit(NOW).alias("retrieved_at"))
    header = validate.cluster_issues(orders, articles, lines).where("code <> 'invalid_confidence'")
    known = A.table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("article_id"))
    sure = validate.issues_of(lines, [("invalid_confidence", "confidence", ~F.col("confidence").between(0, 1))])
    unknown = lines.join(known, "article_id", "left_anti").select("cluster_id", F.lit("unknown_evidence_article").alias("code"), F.lit("article_id").alias("path"))
    return header.unionAll(sure).unionAll(unknown).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster_id").alias("clusters"))


_POINTS = [("north", 60.0, 10.0), ("south", -30.0, 20.0), ("west", 10.0, -100.0), ("east", 20.0, 120.0)]


@query("""
with p as (select s_suppkey, (s_suppkey * 37 % 180 - 90)::double as latitude, (s_suppkey * 53 % 360 - 180)::double as longitude from supplier),
r as (select * from (values ('north', 60.0, 10.0), ('south', -30.0, 20.0), ('west', 10.0, -100.0), ('east', 20.0, 120.0)) r(region, y, x))
select s_suppkey, arg_min(region, (sqrt((latitude - y) * (latitude - y) + (longitude - x) * (longitude - x)), region)) filter (sqrt((latitude - y) * (latitude - y) + (longitude - x) * (longitude - x)) < 24) as region from p cross join r group by s_suppkey
""")
def nearest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast(s_suppkey * 37 % 180 - 90 as double) as latitude", "cast(s_suppkey * 53 % 360 - 180 as double) as longitude")
    regions = spark.createDataFrame(_POINTS, "region string, region_latitude double, region_longitude double")
    return geocode.nearest_region(own, regions).select("s_suppkey", "region")


@query("select source, count(*) as n, round(greatest(0.05, least(1.0, log2(count(*) + 1) / 6)), 9) as raw_weight, round(greatest(0.05, least(1.0, count(*) / (select count(*) from documents))), 9) as share_weight from documents group by source")
def heat_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.table(spark, sf_dir, "documents")
    per = own.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    every = own.agg(F.count(F.lit(1)).alias("total"))  # one row
    return per.crossJoin(every).withColumn("s", F.col("n") / F.col("total")).select("source", "n", F.round(N.heat_weight(F.col("n"), True), 9).alias("raw_weight"), F.round(N.heat_weight(F.col("s"), False), 9).alias("share_weight"))


@query("select time_bucket(interval 60 minutes, ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n from events group by all")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = micro_batch.rolling_counts(A.table(spark, sf_dir, "events"), "ts", ["event_type"], "60 minutes", "60 minutes")
    return own.select(F.col("window.start").alias("window_start"), "event_type", "n")


# Word ends are written out, as \b knows only ASCII letters in the SQL's regular expressions.
_YIELD = "regexp_matches(title, '{0}')"


def _bounded(pattern: str) -> str:
    return pattern.replace(r"\b(", r"(?:^|[^\pL\pN_])(").replace(r")\b", r")(?:$|[^\pL\pN_])")


@query("with" + _TITLE + f"""
select page_id, case when {_YIELD.format(_bounded(X.HIGH_YIELD))} then 100 else 0 end + least(30, len({_TOKENS})) + least(10, 2 * n) - case when {_YIELD.format(_bounded(X.LOW_YIELD))} then 100 else 0 end as priority
from (select *, count(*) over (partition by title) as n from tl where title is not null)
""")
def search_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.pages(spark, sf_dir).where("title is not null")
    counts = own.groupBy("title").agg(F.count(F.lit(1)).alias("article_count"))
    return own.join(counts, "title").select("page_id", enrich.priority(F.col("title"), F.col("article_count")).cast("long").alias("priority"))


@query(r"""
with w as (select lang, source, regexp_extract(text, '[\pL]+') as first, regexp_extract(text, '([\pL]+)[^\pL]*$', 1) as last from documents),
every as (select lang, source, first as word from w union all select lang, source, last from w)
select lang, source, count(distinct word) as n, first(word order by word collate en, word) as least, first(word order by word collate en desc, word desc) as most from every where word <> '' group by lang, source
""")
def collation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.table(spark, sf_dir, "documents")
    words = F.array(F.regexp_extract("text", r"\p{L}+", 0), F.regexp_extract("text", r"(\p{L}+)[^\p{L}]*$", 1))
    every = own.select("lang", "source", F.explode(words).alias("word")).where("word <> ''")
    order = F.struct(X.collated(F.col("word")).alias("order"), F.col("word").alias("plain"))
    return every.groupBy("lang", "source").agg(F.countDistinct("word").alias("n"), F.min_by("word", order).alias("least"), F.max_by("word", order).alias("most"))


_STORAGE = {
    "pipeline_runs": constraints.SERVING["pipeline_runs"], "story_clusters": constraints.SERVING["story_clusters"], "articles": constraints.SERVING["articles"], "story_locations": constraints.SERVING["story_locations"],
}


@query("""
with runs as (select c_custkey as run_id, case when c_nationkey % 5 = 4 then 'odd' else 'running' end as status, c_acctbal as seen from customer where c_custkey % 10 <> 0),
cl as (select o_orderkey as cluster_id, o_custkey as run_id, case when o_orderkey % 7 <> 0 then 't' end as title, o_totalprice / 300000 as confidence from orders),
ar as (select l_orderkey || ':' || l_linenumber as article_id, l_orderkey as cluster_id, l_partkey as url, l_discount * 11 as confidence from lineitem),
lo as (select s_suppkey % 90 as location_id, s_suppkey as cluster_id, s_suppkey * 37 % 200 - 100 as latitude, case when s_nationkey > 20 then 'orbit' else 'city' end as granularity, s_suppkey || ':1' as article from supplier),
v as (
  select 'pipeline_runs' as t, 'check status' as c, 1 as n from runs where status = 'odd' union all select 'pipeline_runs', 'check records_seen', 1 from runs where seen < 0
  union all select 'story_clusters', 'not null canonical_title', 1 from cl where title is null union all select 'story_clusters', 'check cluster_confidence', 1 from cl where not confidence between 0 and 1
  union all select 'story_clusters', 'foreign key ingestion_run_id', 1 from cl where run_id not in (select run_id from runs)
  union all select 'articles', 'check membership_confidence', 1 from ar where not confidence between 0 and 1 union all select 'articles', 'foreign key cluster_id', 1 from ar where cluster_id not in (select cluster_id from cl)
  union all select 'articles', 'unique article_id', count(*) - 1 from ar group by article_id having count(*) > 1 union all select 'articles', 'unique cluster_id,canonical_url', count(*) - 1 from ar group by cluster_id, url having count(*) > 1
  union all select 'story_locations', 'unique location_id', count(*) - 1 from lo group by location_id having count(*) > 1 union all select 'story_locations', 'check latitude', 1 from lo where not latitude between -90 and 90
  union all select 'story_locations', 'check location_granularity', 1 from lo where granularity = 'orbit' union all select 'story_locations', 'foreign key cluster_id', 1 from lo where cluster_id not in (select cluster_id from cl)
  union all select 'story_locations', 'foreign key evidence_article_id', 1 from lo where article not in (select article_id from ar))
select t as "table", c as "constraint", count(*) as issues, sum(n)::bigint as n from v group by t, c
""")
def storage_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = F.lit("x")
    full = lambda df, name: df.withColumns({c: there for c in constraints.SERVING[name].required if c not in df.columns})
    runs = A.table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_nationkey") % 5 == 4, "odd").otherwise("running").alias("status"), F.col("c_acctbal").alias("records_seen"), F.lit(0).alias("records_upserted"), F.lit(0).alias("retryable"))
    clusters = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cluster_id"), F.col("o_custkey").alias("ingestion_run_id"), F.when(F.col("o_orderkey") % 7 != 0, "t").alias("canonical_title"), (F.col("o_totalprice") / 300000).alias("cluster_confidence"),
        *[F.lit(1).alias(c) for c in ("raw_article_count", "unique_publisher_count", "normalized_prominence")],
    )
    lines = A.table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("long").alias("ingestion_run_id")
    articles = lines.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("article_id"), F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("canonical_url"), (F.col("l_discount") * 11).alias("membership_confidence"), none)
    k = F.col("s_suppkey")
    places = A.table(spark, sf_dir, "supplier").select(
        (k % 90).alias("location_id"), k.alias("cluster_id"), F.lit("event").alias("location_type"), F.when(F.col("s_nationkey") > 20, "orbit").otherwise("city").alias("location_granularity"), (k * 37 % 200 - 100).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(1.0).alias("confidence"),
        F.concat(k.cast("string"), F.lit(":1")).alias("evidence_article_id"), none,
    )
    tables = {"pipeline_runs": full(runs, "pipeline_runs"), "story_clusters": full(clusters, "story_clusters"), "articles": full(articles, "articles"), "story_locations": full(places, "story_locations")}
    found = constraints.violations(tables, _STORAGE).where("constraint <> 'not null ingestion_run_id'")
    return found.groupBy("table", "constraint").agg(F.count(F.lit(1)).alias("issues"), F.sum("n").alias("n"))


@query("""
with cl as (select o_custkey as snapshot_id, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders),
ar as (select cl.snapshot_id, i, l_quantity, l_discount, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_discount) - 1 as j from cl join lineitem on l_orderkey = o_orderkey)
select snapshot_id, 'invalid_confidence' as code, 'clusters[' || i || '].confidence' as path from cl where o_totalprice > 400000
union all select snapshot_id, 'invalid_url', 'clusters[' || i || '].articles[' || j || '].url' from ar where l_quantity > 49
union all select snapshot_id, 'invalid_article', 'clusters[' || i || '].articles[' || j || ']' from ar where l_quantity > 48 and l_discount > 0.08
""")
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount")))).alias("articles")
    )
    orders = A.table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    documents = orders.groupBy(F.col("o_custkey").alias("snapshot_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").alias("price"), "articles"))).alias("clusters"))
    rules = {
        "clusters[]": [("invalid_confidence", "confidence", lambda x: x["price"] > 400000)],
        "clusters[].articles[]": [("invalid_url", "url", lambda x: x["quantity"] > 49), ("invalid_article", "", lambda x: (x["quantity"] > 48) & (x["discount"] > 0.08))],
    }
    return constraints.nested_issues(documents, {"clusters": F.col("clusters")}, rules, ["snapshot_id"])


_REASON = {name: enrich.REASONS[i] for i, name in enumerate(("cluster", "score", "record", "text", "url", "network", "story"))}


# One result after another, with the URLs and networks that each story has so far.
@query(f"""
with recursive base as (
  select s_suppkey as k, s_nationkey as n, n_regionkey as c, case when s_suppkey % 29 <> 0 then round((s_acctbal + 1000) / 11000, 3) end as score, 'https://outlet' || (s_suppkey * 7 % 61) || '.example/' || (s_suppkey % 45) as url,
    'outlet' || (s_suppkey * 7 % 61) || '.example' as network from supplier join nation on s_nationkey = n_nationkey),
texts as (select distinct url from base where k % 6 <> 0),
rows as materialized (
  select base.*, case when n % 8 = 7 then '{_REASON["cluster"]}' when score is null or score < 0.4 then '{_REASON["score"]}' when k % 23 = 0 then '{_REASON["record"]}' when url not in (select url from texts) then '{_REASON["text"]}' end as early,
    row_number() over (order by n, score desc nulls last, url, k) as i from base),
g as (
  select 0::bigint as i, list_transform(range(0, 5), lambda c: c || '|https://old.example/' || c) as urls, list_transform(range(0, 5), lambda c: c || '|old.example') as networks, -1 as n, 0 as given, 0 as total, null::varchar as reason
  union all
  select i, case when reason is null then list_append(urls, c || '|' || url) else urls end, case when reason is null then list_append(networks, c || '|' || network) else networks end, n, given + (reason is null)::int, total + (reason is null)::int, reason
  from (
    select rows.i, urls, networks, rows.n, c, url, network, case when rows.n = g.n then given else 0 end as given, total,
      case when total >= 60 then '{enrich.ALL_FULL}' when early = '{_REASON["cluster"]}' then early when rows.n = g.n and given >= 4 then '{enrich.SEARCH_FULL}' when early is not null then early
        when list_contains(urls, c || '|' || url) then '{_REASON["url"]}' when list_contains(networks, c || '|' || network) then '{_REASON["network"]}' when score < 0.5 then '{_REASON["story"]}' end as reason
    from g join rows on rows.i = g.i + 1))
select k as result, coalesce(reason, 'joined') as outcome, case when reason is null then round(least(0.95, 0.75 + score * 0.25), 6) end as confidence from g join rows using (i)
""")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, title = F.col("s_suppkey"), F.format_string("Quake Number%d shakes towers of Region%d", F.col("n_regionkey"), F.col("n_regionkey"))
    nations = A.table(spark, sf_dir, "nation")
    own = A.table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    at, name = F.lit(NOW), lambda c: F.col(c).cast("string")
    asked = F.when(F.col("n_nationkey") % 8 == 7, F.lit("nothing of the kind")).otherwise(title)
    searches = nations.select(F.lpad(name("n_nationkey"), 4, "0").alias("search_id"), asked.alias("query"), F.col("n_nationkey").alias("ord"))
    url = F.concat(F.lit("https://outlet"), (k * 7 % 61).cast("string"), F.lit(".example/"), (k % 45).cast("string"))
    said = F.when(F.col("n_nationkey") % 8 == 7, F.lit("other things")).otherwise(F.when(k % 23 == 0, F.lit("")).otherwise(title))
    results = own.select(F.lpad(name("s_nationkey"), 4, "0").alias("search_id"), F.lpad(name("s_suppkey"), 10, "0").alias("article_id"), url.alias("url"), said.alias("title"), F.lit(None).cast("string").alias("summary"), F.when(k % 29 != 0, F.round((F.col("s_acctbal") + 1000) / 11000, 3)).alias("score"), at.alias("at"))
    regions = nations.select("n_regionkey").distinct()
    clusters = regions.select(name("n_regionkey").alias("cluster_id"), title.alias("title"), F.col("n_regionkey").alias("ord"))
    articles = regions.select(name("n_regionkey").alias("cluster_id"), F.concat(F.lit("a"), name("n_regionkey")).alias("article_id"), title.alias("title"), F.lit(None).cast("string").alias("summary"), at.alias("at"), F.col("n_regionkey").alias("ord"), F.concat(F.lit("https://old.example/"), name("n_regionkey")).alias("canonical_url"), F.lit("old.example").alias("domain"))
    contents = own.where(k % 6 != 0).select(url.alias("url"), F.repeat(F.lit("x"), 600).alias("raw_content"))
    accepted, rejected = enrich.enriched(searches, results, clusters, articles, contents, 4, 60)
    both = accepted.select("article_id", F.lit("joined").alias("outcome"), F.round("confidence", 6).alias("confidence")).unionAll(rejected.select("article_id", "reason", F.lit(None).cast("double")))
    return both.select(F.col("article_id").cast("long").alias("result"), "outcome", "confidence")


@query("""
select o_orderkey, case o_orderkey % 6 when 0 then o_orderdate when 1 then o_orderdate when 2 then o_orderdate when 3 then o_orderdate - interval 2 hours end as seen,
  case o_orderkey % 6 when 2 then o_orderdate when 3 then o_orderdate - interval 2 hours when 4 then o_orderdate + interval 1410 minutes end as strict, o_orderkey % 6 = 2 as iso, case when o_orderkey % 6 = 5 then null when o_orderkey % 5 <> 0 then o_orderdate end as stamped
from orders
""")
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    form = lambda f: F.date_format(at, f)
    compact, plain = form("yyyyMMdd'T'HHmmss"), form("yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k % 6 == 0, F.concat(compact, F.lit("Z"))).when(k % 6 == 1, compact).when(k % 6 == 2, F.concat(plain, F.lit("Z"))).when(k % 6 == 3, F.concat(plain, F.lit("+02:00"))).when(k % 6 == 4, F.concat(plain, F.lit("-23:30"))).otherwise("soon")
    stamp = F.when(k % 6 == 5, "2024").otherwise(F.when(k % 5 == 0, F.lit("20240231000000")).otherwise(form("yyyyMMddHHmmss")))
    own = A.table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"), stamp.alias("stamp"))
    zone = lambda c: c.cast("timestamp_ntz")
    return own.select("o_orderkey", zone(D.seen_date(F.col("said"))).alias("seen"), zone(D.rfc3339(F.col("said"))).alias("strict"), D.is_iso_utc(F.col("said")).alias("iso"), zone(D.batch_timestamp(F.col("stamp"))).alias("stamped"))


@query(r"""
select p_partkey, p_name as asked, case when p_partkey % 3 = 0 then 'fra' end as language, case when p_partkey % 4 = 0 then 'Unknown upstream failure.' else 'failed: [redacted] and [redacted] of ' || p_name end as message,
  case when p_partkey % 5 = 0 then 'NULL' else '''it''''s ' || p_name || '''' end as literal, p_partkey % 2 = 0 as same, '…' || trim(substr(p_name, 3, 8)) || case when length(p_name) > 10 then '…' else '' end as quote,
  trim(regexp_replace(lower(p_name), '[^\pL\pN]+', ' ', 'g')) as headline, 'city|FR||' || trim(regexp_replace(lower(p_name), '[^\pL\pN]+', ' ', 'g')) || '|' || printf('%.5f', p_size / 8) || '|-7.00000' as place
from part
""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    lit = F.lit
    message = F.when(k % 4 == 0, lit("  ")).otherwise(F.concat(lit("failed: tvly-abc-1 and Bearer x.y of "), name))
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", X.search_query(F.concat(lit("BREAKING NEWS: "), name, lit(" | The Daily Site"))).alias("asked"), X.language_tag(F.when(k % 3 == 0, lit("a:b; srclc:FRA;x")).otherwise("none")).alias("language"), X.redacted_error(message).alias("message"),
        X.sql_literal(F.when(k % 5 != 0, F.concat(lit("it's "), name))).alias("literal"), X.same_ignoring_case(F.when(k % 2 == 0, F.upper(name)).otherwise(F.concat(name, lit("é"))), F.when(k % 2 == 0, name).otherwise(F.concat(name, lit("e")))).alias("same"),
        X.quote_window(name, lit(4), lit(8), 2).alias("quote"), X.headline_key(name).alias("headline"), X.location_key(lit("city"), lit("fr"), lit(None).cast("string"), name, F.col("p_size") / 8, lit(-7.0)).alias("place"),
    )


@query("with" + _CANONICAL + """,
found as (
  select canonical_url, 'T' || page_id as title, null as summary, 'documents' as provider, timestamp '2024-01-01' + to_seconds(page_id * 600) as published_at, page_id * 2 as ord from pages join cu using (page_id) where page_id % 11 <> 0
  union all select canonical_url, 'N' || page_id, case when page_id % 6 = 0 then 'Summary of ' || page_id end, 'news', timestamp '2024-01-02' + to_seconds(page_id * 600), page_id * 2 + 1 from pages join cu using (page_id) where page_id % 3 = 0)
select canonical_url, title, summary, provider, published_at from found qualify row_number() over (partition by canonical_url order by length(coalesce(summary, '')) desc, ord) = 1
""")
def search_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, k, none = A.table(spark, sf_dir, "pages"), F.col("page_id"), F.lit(None).cast("string")
    at = lambda first: F.timestamp_seconds(F.lit(first) + k * 600)
    record = F.struct("url", F.when(k % 11 != 0, F.concat(F.lit("T"), k)).alias("title"), F.date_format(at(1704067200), "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), none.alias("domain"), F.lit("English").alias("language"), none.alias("sourcecountry"))
    found = search_sources.document_articles(pages.select("page_id", F.array(record).alias("articles")), F.lit(NOW), carry=("page_id",)).withColumn("ord", k * 2).drop("origin_country")
    record = F.struct(F.concat(F.lit("N"), k).alias("title"), "url", F.when(k % 6 == 0, F.concat(F.lit("Summary of "), k)).alias("content"), F.date_format(at(1704153600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_date"), F.lit(0.5).alias("score"))
    news = search_sources.news_articles(pages.where(k % 3 == 0).select("page_id", F.array(record).alias("results")), F.lit(NOW), carry=("page_id",)).withColumn("ord", k * 2 + 1)
    return search_sources.unique_articles(found.unionByName(news)).select("canonical_url", "title", "summary", "provider", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("""
select case when count(*) filter (n_nationkey % 4 <> 0) = 0 then 'unavailable' when count(*) filter (n_nationkey % 4 = 0) > 0 then 'degraded' else 'healthy' end as status, count(*) as sources, count(*) filter (n_nationkey % 4 <> 0) as good,
  (select array_to_string(list_sort(list(w)), ',') from (select n_name || ': http — HTTP ' || (500 + n_nationkey) as w from nation where n_nationkey % 4 = 0 union all select n_name || ' omitted some' from nation where n_nationkey % 4 <> 0 and n_nationkey % 5 = 0)) as warnings
from nation
""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    own = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("provider"), (n % 4 != 0).alias("ok"), F.lit("http").alias("kind"), F.concat(F.lit("HTTP "), 500 + n).alias("message"), F.when(n % 5 == 0, F.array(F.concat("n_name", F.lit(" omitted some")))).alias("warnings"))
    return search_sources.source_health(own, F.lit(7)).select("status", F.col("source_count").alias("sources"), F.col("successful_source_count").alias("good"), F.array_join("warnings", ",").alias("warnings"))


@query("""
with s as (select s_suppkey, s_name, n_name, n_regionkey, s_suppkey % 7 as shared from supplier join nation on s_nationkey = n_nationkey)
select s_suppkey, contains(lower(n_name), 'tion_1') or contains(s_name, '7') or contains(n_name, '7') as found, n_regionkey in (1, 2) as inside, (select count(*) - count(distinct shared) from s) as repeated from s where contains(lower(n_name), 'tion_1') or contains(s_name, '7') or contains(n_name, '7') or n_regionkey in (1, 2)
""")
def story_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.table(spark, sf_dir, "supplier").join(A.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    none = F.array().cast("array<string>")
    stories = settle(own.select("s_suppkey", (F.col("s_suppkey") % 7).alias("cluster_id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("summary"), F.array("n_name").alias("labels"), none.alias("publishers"), none.alias("domains"), F.array("n_regionkey").alias("regions")))
    found = serving.search(stories, " Tion_1 ").unionAll(serving.search(stories, "7")).select("s_suppkey", F.lit(True).alias("found")).distinct()
    inside = serving.within_region(stories, 1).unionAll(serving.within_region(stories, 2)).select("s_suppkey", F.lit(True).alias("inside"))
    both = found.join(inside, "s_suppkey", "full").select("s_suppkey", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("found", "inside")])
    return both.crossJoin(serving.duplicate_rows(stories).withColumnRenamed("duplicates", "repeated"))  # one row


@query("""
with o as (select c_custkey as run_id, 'f' || c_nationkey as fingerprint, 'running' as status from customer where c_custkey % 2 = 0),
n as (select c_custkey as run_id, case when c_custkey % 9 = 0 then 'other' else 'f' || c_nationkey end as fingerprint, case when c_custkey % 5 = 0 then 'running' else 'succeeded' end as status from customer where c_custkey % 3 = 0)
select run_id, case when n.run_id is null then 'kept' when o.run_id is null then 'inserted' when o.fingerprint <> n.fingerprint then 'conflict' when o.status = n.status then 'replayed' else 'updated' end as outcome,
  case when o.run_id is null or (n.run_id is not null and o.fingerprint = n.fingerprint) then n.status else o.status end as status from o full join n using (run_id)
""")
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    fields = [x.split(" ") for x in schemas.RUNS.split(", ")]

    def runs(own: DataFrame, fingerprint: Column, status: Column) -> DataFrame:
        known = {"run_id": k.cast("string"), "input_fingerprint": fingerprint, "status": status, "source": F.lit("batch"), "started_at": F.lit(NOW)}
        return own.select(*[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])

    customers, own = A.table(spark, sf_dir, "customer"), F.concat(F.lit("f"), "c_nationkey")
    merged = sinks.upserted_runs(runs(customers.where(k % 2 == 0), own, F.lit("running")), runs(customers.where(k % 3 == 0), F.when(k % 9 == 0, "other").otherwise(own), F.when(k % 5 == 0, "running").otherwise("succeeded")))
    return merged.select(F.col("run_id").cast("long").alias("run_id"), "outcome", "status")


@query("""
select 'DELETE FROM suppliers WHERE run_id = ''batch:1'';' as value
union all select 'INSERT INTO suppliers (run_id, supplier_id, name, note, held) VALUES (''batch:1'', ' || s_suppkey || ', ''' || s_name || ''', ' || case when s_suppkey % 3 = 0 then 'NULL' else '''it''''s ' || s_nationkey || '''' end || ', ' || (s_nationkey > 9)::int || ');' from supplier
""")
def sql_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.table(spark, sf_dir, "supplier").select(F.lit("batch:1").alias("run_id"), F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("it's "), "s_nationkey")).alias("note"), (F.col("s_nationkey") > 9).alias("held"))
    return sinks.sql_script(own, "suppliers", "batch:1", ["supplier_id"])


@query("with n as (select count(distinct url) as n from pages) select b::bigint as batch, least(20, n - b * 20)::bigint as urls from n, range(0, (select ceil(n / 20)::bigint from n)) r(b)")
def url_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.url_batches(A.table(spark, sf_dir, "pages"), 20).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("urls"))


@query("""
with per as (select l_orderkey as cluster_id, count(distinct l_suppkey) as outlets, count(*) filter (l_shipdate between timestamp '1996-01-01' and timestamp '1998-01-01') as inside from lineitem group by l_orderkey)
select code, count(*) as n from (
  select 'insufficient_independent_outlets' as code from orders left join per on o_orderkey = cluster_id where coalesce(outlets, 0) < 2 union all select 'missing_event_location' from orders where o_custkey % 4 = 0
  union all select 'outside_window' from orders left join per on o_orderkey = cluster_id where coalesce(inside, 0) = 0) group by code
""")
def slice_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders")
    articles = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("outlet_id"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.col("l_shipdate").alias("retrieved_at"))
    places = orders.where("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("cluster_id"))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    found = validate.slice_issues(orders.select(F.col("o_orderkey").alias("cluster_id")), articles, places, day("1996-01-01"), day("1998-01-01"))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""
with c as (select c_custkey as k from customer),
i as (select unnest(list_filter([
  case when k % 10 = 1 then ' invalid_receipt' end, case when k % 10 = 2 then 'agent missing_agent' end, case when k % 10 = 3 then 'commit invalid_commit' end, case when k % 10 = 4 then 'tests invalid_list' end, case when k % 10 = 5 then 'integrations[1].status invalid_status' end,
  case when k % 10 = 6 then 'integrations[0].usage inconsistent_usage' end, case when k % 10 = 7 then 'integrations invalid_integrations' end, case when k % 10 = 8 then 'integrations[0].provider missing_provider' end], lambda x: x is not null)) as issue from c)
select issue, count(*) as n from i group by issue
""")
def receipt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 10
    item = lambda status, delta, provider: F.concat(F.lit('{"provider":"'), provider, F.lit('","capability":"search","observed_at":"2026-08-27T01:00:00Z","status":"'), status, F.lit('","usage":{"unit":"credits","before":5,"after":3.5,"delta":'), delta, F.lit("}}"))
    right = item(F.lit("succeeded"), F.lit("-1.5"), F.lit("p"))
    items = F.concat(F.lit("["), item(F.lit("failed"), F.when(k == 6, "2").otherwise("-1.5"), F.when(k == 8, "").otherwise("p")), F.lit(","), F.when(k == 5, item(F.lit("odd"), F.lit("-1.5"), F.lit("p"))).otherwise(right), F.lit("]"))
    text = F.concat(F.lit('{"agent":"'), F.when(k == 2, " ").otherwise("a"), F.lit('","task_id":"t","commit":'), F.when(k == 3, '"XYZ"').otherwise('"abcdef0"'), F.lit(',"tests":'), F.when(k == 4, '["x",1]').otherwise('["x"]'), F.lit(',"integrations":'), F.when(k == 7, "3").otherwise(items), F.lit("}"))
    own = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.when(k == 1, "[1]").when(k == 9, F.lit(None).cast("string")).otherwise(text).alias("receipt"))
    return receipts.receipt_issues(own).groupBy(F.concat_ws(" ", "path", "code").alias("issue")).agg(F.count(F.lit(1)).alias("n"))


@query("with" + _PLACES + ", pl as (select *, row_number() over (partition by cluster_id order by confidence desc, evidence_count desc, location_id) = 1 as is_primary from lo) select location_id as region, is_primary, count(*) as n from pl where cluster_id % 5 <> 0 group by all")
def shown_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = F.when(F.col("cluster_id") % 5 == 0, "mentioned").otherwise("event")
    own = _places(spark, sf_dir).withColumns({"location_type": kind, "granularity": F.lit("country"), "region_code": none, "country_code": none, "evidence_article_id": F.lit("a")})
    return serving.shown_locations(own).groupBy("region", "is_primary").agg(F.count(F.lit(1)).alias("n"))


@query("""
with l as (select (s_suppkey - 1) // 3 as b, (s_suppkey - 1) % 3 as kind from supplier where s_suppkey % 7 <> 0)
select strftime(timestamp '2024-01-01' + to_minutes(15 * b), '%Y%m%d%H%M%S') as batch_id, timestamp '2024-01-01' + to_minutes(15 * b) as batch_time from l where b between 12 and 19 group by b having count(*) = 3
""")
def complete_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.floor((F.col("s_suppkey") - 1) / 3)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + b * 900), "yyyyMMddHHmmss")
    end = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(batch.SUFFIXES.values()) for x in (i, s)]), ((F.col("s_suppkey") - 1) % 3).cast("int"))
    line = F.concat((F.col("s_suppkey") * 100).cast("string"), F.lit(" "), F.md5("s_name"), F.lit(" http://data.example/v2/"), stamp, end)
    lines = A.table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(line.alias("value"))
    noise = lines.limit(0).unionAll(spark.createDataFrame([("not a line",), (f"0 {'a' * 32} http://data.example/x.export.CSV.zip",)], "value string"))
    found = batch.complete_batches(batch.manifest_rows(lines.unionAll(noise)), "20240101050000")
    return found.select("batch_id", F.col("batch_time").cast("timestamp_ntz").alias("batch_time"))


@query("""
with c as (select s_suppkey as k, n_regionkey as r, s_suppkey % 60 as hours, round((s_acctbal + 1000) / 11000, 3) as score, (s_suppkey % 10) / 10.0 as overlap from supplier join nation on s_nationkey = n_nationkey),
p as (select *, 0.45 + 0.35 + exp(-hours / 36.0) * 0.2 as match from c)
select k, round(least(0.95, match * 0.45 + overlap * 0.3 + score * 0.25), 6) as confidence, round(exp(-hours / 36.0), 6) as time_overlap from p where score >= 0.5 and overlap >= 0.35 and exp(-hours / 36.0) >= 0.35 and match * 0.45 + overlap * 0.3 + score * 0.25 >= 0.35
""")
def story_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, title = F.col("s_suppkey"), F.format_string("Quake Number%d shakes towers of Region%d", F.col("n_regionkey"), F.col("n_regionkey"))
    nations = A.table(spark, sf_dir, "nation")
    own = A.table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    none, score = F.lit(None).cast("string").alias("summary"), F.round((F.col("s_acctbal") + 1000) / 11000, 3)
    candidates = own.select(F.col("n_regionkey").alias("cluster_id"), k.alias("article_id"), title.alias("title"), none, F.timestamp_seconds(F.lit(1704067200) + k % 60 * 3600).alias("at"), score.alias("search_score"), (k % 10 / 10).alias("query_overlap"))
    regions = nations.select("n_regionkey").distinct()
    articles = regions.select(F.col("n_regionkey").alias("cluster_id"), F.lit(-1).cast("long").alias("article_id"), title.alias("title"), none, F.timestamp_seconds(F.lit(1704067200)).alias("at"), F.lit(0).alias("ord"))
    return enrich.memberships(candidates, articles).select(F.col("article_id").alias("k"), F.round("confidence", 6).alias("confidence"), F.round("time_overlap", 6).alias("time_overlap"))


@query("select case l_returnflag when 'A' then 'supports' when 'R' then 'disputes' else 'unclear' end as stance, count(*) as n from lineitem where l_suppkey % 6 <> 0 group by 1")
def stances_without_retired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    polarity = F.when(F.col("l_returnflag") == "A", "asserts").when(F.col("l_returnflag") == "R", "denies")
    own = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("batch:"), (F.col("l_suppkey") % 6).cast("string")).alias("run_id"), polarity.alias("polarity"))
    return signals.with_stance(sinks.without_runs(own, ["batch:0"], "batch:1")).groupBy("stance").agg(F.count(F.lit(1)).alias("n"))


@query("""
select s_suppkey as article_id, case when s_suppkey % 3 = 0 and s_nationkey % 2 = 0 then 'disputes' when s_nationkey % 2 = 0 then 'straight_report' end as framing, case when s_suppkey % 3 = 0 and s_nationkey % 2 = 0 then 'negative' when s_nationkey % 2 = 0 then 'neutral' end as tone from supplier
""")
def cited_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("article_id"), F.concat(F.lit("outlet"), "s_nationkey").alias("domain"), F.when(F.col("s_suppkey") % 3 == 0, "Opinion: no").otherwise("News").alias("title"))
    even = A.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("outlet"), "n_nationkey").alias("domain"))
    rules = even.selectExpr("domain", "'^Opinion' as title_pattern", "'disputes' as framing", "'negative' as tone", "0 as priority").unionAll(even.selectExpr("domain", "cast(null as string)", "'straight_report'", "'neutral'", "1"))
    return enrich.framed(articles, rules).select("article_id", "framing", "tone")


@query("""
with c as (select c_custkey as k, n_regionkey as r from customer join nation on c_nationkey = n_nationkey)
select code, path, count(*) as n from (
  select 'missing_same_story_context' as code, 'same_story' as path from c where k % 7 = 0 union all select 'invalid_same_story_context', 'same_story' from c where k % 7 = 1
  union all select 'invalid_coordinates', 'same_story.editorialMarket.value.coordinates' from c where k % 7 in (2, 3)) group by code, path
""")
def stored_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    market = lambda c: F.concat(F.lit('{"editorialMarket":{"status":"observed","value":{"regionCode":"R","coordinates":'), c, F.lit("}}}"))
    text = F.when(k == 1, F.lit('"text"')).when(k == 2, market(F.lit("[1,2]"))).when(k == 3, market(F.lit("7"))).when(k == 4, F.lit("{}")).when(k != 0, market(F.lit('{"latitude":1,"longitude":2}')))
    own = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cluster_id"), text.alias("same_story_json"))
    return validate.context_issues(own).groupBy("code", "path").agg(F.count(F.lit(1)).alias("n"))
