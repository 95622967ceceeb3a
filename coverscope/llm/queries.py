"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope.llm import alignment, bpe, centroids, chat, decontamination, langid, lm, minhash, secrets, simhash, toxicity, url_filter, wrappers
from coverscope.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.document_fingerprints(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Entries of the URL list that don't come from hosts: key, action, date.
LISTED = (
    ("spam-farm.example.org", "block", "2024-01-10"),
    ("casino-win.example.com", "block", "2024-01-15"),
    ("cheap-pills.example.com", "block", "2024-02-01"),
    ("cheap-pills.example.com", "clear", "2024-03-10"),
    ("example.net", "block", "2024-03-20"),
)


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of pages, as there is no table of one: some are blocked on a day, some of them cleared later, and
    for some a part of the site is allowed."""
    hosts = pages.select(url_filter.url_host(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("x", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    day = lambda n: f"timestampadd(DAY, {n}, timestamp_ntz'2024-01-05')"
    parts = [
        hosts.where("x % 4 = 0").selectExpr("host as key", "'block' as action", f"{day('x % 60')} as dated"),
        hosts.where("x % 8 = 0").selectExpr("host as key", "'clear' as action", f"{day('x % 60 + 10 + x % 20')} as dated"),
        hosts.where("x % 12 = 0").selectExpr("concat(host, '/en') as key", "'allow' as action", f"{day('x % 45')} as dated"),
        pages.sparkSession.sql("select key, action, cast(dated as timestamp_ntz) as dated from values " + ", ".join(map(str, LISTED)) + " as v(key, action, dated)"),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.selectExpr("page_id", "url", "timestampadd(SECOND, page_id * 7919 % (90 * 86400), timestamp_ntz'2024-01-01') as fetched_at")
    return url_filter.filtered(captures, dated_list(pages)).select("page_id", "url", "fetched_at", "verdict", "rule", "since")


OP4_SQL = """
with captures as (
  select page_id, url, timestamp '2024-01-01' + to_seconds(page_id * 7919 % (90 * 86400)) as fetched_at,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\\.$', ''), '^www\\.', '') as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as path
  from pages),
hosts as (select distinct host, ('0x' || substr(md5(host), 1, 4))::int as x from captures where host <> ''),
listed as (
  select host as key, 'block' as action, timestamp '2024-01-05' + to_days(x % 60) as dated from hosts where x % 4 = 0
  union all select host, 'clear', timestamp '2024-01-05' + to_days(x % 60 + 10 + x % 20) from hosts where x % 8 = 0
  union all select host || '/en', 'allow', timestamp '2024-01-05' + to_days(x % 45) from hosts where x % 12 = 0
  union all select * from (values LISTED) v(key, action, dated)),
intervals as (
  select key, action, dated as valid_from, lead(dated) over (partition by key order by dated) as valid_to
  from (select lower(key) as key, dated, max(action) as action from listed group by all)),
keys as (
  select distinct url, fetched_at, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(path) + 1), lambda i: host || '/' || array_to_string(path[1:i], '/')))) as key
  from captures where host <> '' and fetched_at is not null),
active as (
  select url, fetched_at, k.key, action, valid_from, row_number() over (partition by url, fetched_at order by length(k.key) desc, k.key desc) as r
  from keys k join intervals i on k.key = i.key and fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)
  where action in ('block', 'allow'))
select c.page_id, c.url, c.fetched_at, case action when 'block' then 'blocked' when 'allow' then 'allowed' else 'none' end as verdict, key as rule, valid_from as since
from captures c left join active a on c.url = a.url and c.fetched_at = a.fetched_at and r = 1
""".replace("LISTED", ", ".join(f"('{k}', '{a}', timestamp '{d}')" for k, a, d in LISTED))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    scores = toxicity.toxicity_scores(docs, model)
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


OP9_SQL = f"""
with own as (
  select *, md5(role || chr(10) || body) as h, floor(turn / {chat.SEGMENT}.0) as seg
  from (select distinct conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as body from conversations)),
counted as (select *, count(*) over (partition by conv_id, turn) as n_turn, count(*) over (partition by conv_id, seg) as n_seg from own),
placed as (
  select *, case when n_seg > {chat.CROWD} then turn end as t,
    case when n_seg > {chat.CROWD} then floor(('0x' || substr(h, 1, 4))::int * ceil(n_turn / {chat.CROWD}.0) / 65536) else 0 end as b
  from counted),
speakers as (select distinct conv_id, role as perspective from own where role <> '{chat.SYSTEM}'),
pieces as (
  select o.*, perspective, body || '{chat.STOP}' as said,
    '{chat.START}' || case when role = perspective then 'assistant' when role = '{chat.SYSTEM}' then role else 'user name=' || replace(role, '<|', '< |') end || chr(10) as head
  from placed o join speakers s on o.conv_id is not distinct from s.conv_id),
ordered as (
  select *, (sum(length(head) + length(said) + 1) over (partition by conv_id, perspective order by turn nulls first, h))::bigint as after,
    dense_rank() over (partition by conv_id, perspective order by seg nulls first, t nulls first, b) - 1 as part
  from pieces)
select conv_id, perspective, part, min(after - length(head) - length(said) - 1) as start, string_agg(head || said || chr(10), '' order by turn nulls first, h) as text,
  coalesce(string_agg(case when role = perspective then (after - 1 - length(said)) || ':' || (after - 1) end, ',' order by turn nulls first, h), '') as train_spans,
  count(*) as n_messages
from ordered group by conv_id, perspective, part
"""


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op11_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> str:
    """Every vector against every centroid, round by round."""
    steps = [
        f"""kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
  from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim})""",
        f"""c0 as materialized (
  select row_number() over (order by h, v) - 1 as k, v as c from (select sha256('2:' || vec_id) as h, v from kept order by h, v limit {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
  select r, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': d, 'k': k}}) as near
  from (select r, vec_id, v, k, list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint as d from kept, c{i}) group by r)""")
        if i < rounds:
            steps.append(f"""s{i} as (
  select near.k as k, i, sum(v[i])::bigint as s, count(*) as n from a{i}, range(1, {dim + 1}) as t(i) group by 1, 2),
c{i + 1} as materialized (
  select c.k, coalesce(m.c, c.c) as c from c{i} c left join (select k, list((s - ((s % n) + n) % n) // n order by i) as c from s{i} group by k) m using (k))""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, near.k::int as cluster, near.d as distance, (sum(near.d) over (partition by near.k))::bigint as cluster_inertia, (sum(near.d) over ())::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} on near.k = c{rounds}.k"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_minhash_fingerprints": op2_minhash_fingerprints,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_html_extraction": op6_html_extraction,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_chat_rotation": op9_chat_rotation,
    "op10_lm_scores": op10_lm_scores,
    "op11_language_spans": op11_language_spans,
    "op12_token_alignment": op12_token_alignment,
    "op13_dual_tree_lloyd": op13_dual_tree_lloyd,
}
ORACLES: dict[str, str] = {"op4_url_filter": OP4_SQL, "op9_chat_rotation": OP9_SQL, "op13_dual_tree_lloyd": op13_sql()}
