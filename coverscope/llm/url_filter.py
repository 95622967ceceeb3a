"""URL filters: dated list entries become validity intervals; an as-of join judges each capture by the entries active when it was fetched.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.runtime import settle

#: Seconds of a bucket of time, and places that the captures of one key and bucket are dealt to.
BUCKET, SALTS = 86_400, 16


def url_host(url: Column) -> Column:
    """The host in lower case, without user, port, final dot and "www."; empty where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")


def url_keys(url: Column) -> Column:
    """What an entry may name of a URL: its host and each domain above, and its host with each part of the path from the left."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    paths = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.concat_ws("/", host, F.array_join(F.slice(path, F.lit(1), i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.when(F.size(path) > 0, paths).otherwise(F.array().cast("array<string>")))))


def validity(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to): entries (key, action, dated) as intervals; an interval ends when the key's next begins, or never (null).

    Of entries of one key at one time the one of the greatest action holds. Rows with a null are dropped. A key's entries are ordered within
    buckets of time; what ends the last of a bucket is the first of the key's next one, so that a much-changed key isn't a single task's work.
    """
    one = _entries(entries).withColumn("bucket", _bucket(_micros(F.col("dated"), _plain(entries, "dated"))))
    firsts = one.groupBy("key", "bucket").agg(F.min("dated").alias("first"))
    after = firsts.select("key", "bucket", F.lead("first").over(Window.partitionBy("key").orderBy("bucket")).alias("after"))
    following = F.lead("dated").over(Window.partitionBy("key", "bucket").orderBy("dated"))
    ended = one.withColumn("following", following).join(after, ["key", "bucket"])
    return ended.select("key", "action", F.col("dated").alias("valid_from"), F.coalesce("following", "after").alias("valid_to"))


def _plain(df: DataFrame, column: str) -> bool:
    """Whether a time has no zone."""
    return dict(df.select(column).dtypes)[column] != "timestamp"


def _micros(c: Column, plain: bool) -> Column:
    """Microseconds of a time without a zone as it is written, and of one with a zone since the epoch."""
    if not plain:
        return F.unix_micros(c.cast("timestamp"))
    c = c.cast("timestamp_ntz")
    seconds = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def _time(micros: Column, plain: bool) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr("timestamp_ntz'1970-01-01 00:00:00'")) if plain else F.timestamp_micros(micros)


def _bucket(t: Column) -> Column:
    return F.floor(t / F.lit(BUCKET * 1_000_000))


def _entries(entries: DataFrame) -> DataFrame:
    named = entries.select(F.lower("key").alias("key"), "action", "dated").dropna()
    return named.groupBy("key", "dated").agg(F.max("action").alias("action"))


def judged(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(url, fetched_at, verdict, rule, since) of each distinct pair of URL and time.

    entries: key (a domain, which covers those below it, or host/path), action ("block", "allow", or "clear", which ends what
    was before), dated. Of a capture's keys the longest whose interval at that time says block or allow decides; verdict is "blocked", "allowed",
    or "none". A capture with a null time or without a host has "none".

    Times without a zone are compared as they are written, whatever the session's zone is, and times with one as instants; if only one side has a zone, its times are taken as the session's zone writes them. since is of
    the kind that was compared.

    As-of join of captures with validity's intervals: of a key the one that begins last until then, if it hasn't ended. Time is cut into buckets. Within a bucket captures and intervals are sorted
    together by their begin, each key's captures dealt to SALTS places with its intervals of the bucket; across buckets the interval
    that reaches out of a key's last one is carried forward, a row for each bucket. So neither a hot host nor a much-changed entry gathers in one task, and nothing is
    compared with all entries.
    """
    pairs = captures.select(F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at")).distinct()
    plain = _plain(captures, time_col) or _plain(entries, "dated")
    micros = lambda c: _micros(c, plain)
    until = lambda c: F.when(c.isNotNull(), micros(c))
    listed = settle(validity(entries)).select("key", "action", micros(F.col("valid_from")).alias("t"), until(F.col("valid_to")).alias("until")).withColumn("bucket", _bucket(F.col("t")))
    asked = pairs.where(F.col("fetched_at").isNotNull()).select("url", "fetched_at", F.explode(url_keys(F.col("url"))).alias("key"))
    asked = asked.join(listed.select("key").distinct(), "key", "left_semi").withColumn("t", micros(F.col("fetched_at"))).withColumn("bucket", _bucket(F.col("t")))
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("url", "t"), F.lit(SALTS)).cast("int"))
    # Within a bucket.
    every = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    state = F.struct(F.col("t").alias("since"), "until", "action")
    both = every.select("key", "bucket", "salt", "t", F.lit(0).alias("order"), state.alias("state"), F.lit(None).cast("string").alias("url"), F.lit(None).cast(pairs.schema["fetched_at"].dataType).alias("fetched_at"))
    both = both.unionAll(salted.select("key", "bucket", "salt", "t", F.lit(1).alias("order"), F.lit(None).cast("struct<since:bigint,until:bigint,action:string>").alias("state"), "url", "fetched_at"))
    inside = Window.partitionBy("key", "bucket", "salt").orderBy("t", "order").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("state", F.last("state", ignorenulls=True).over(inside)).where("order = 1").select("url", "fetched_at", "key", "bucket", "salt", "state")
    # Across buckets: the last state before each.
    ends = listed.groupBy("key", "bucket").agg(F.max(state).alias("state"))
    marks = ends.unionAll(asked.select("key", "bucket", F.lit(None).cast("struct<since:bigint,until:bigint,action:string>").alias("state"))).groupBy("key", "bucket").agg(F.max("state").alias("state"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("key", "bucket", F.last("state", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    carried = carried.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    states = within.join(carried, ["key", "bucket", "salt"], "left").select("url", "fetched_at", "key", F.coalesce("state", "carried").alias("state"), micros(F.col("fetched_at")).alias("t"))
    active = states.where("state.action in ('block', 'allow') and (state.until is null or t < state.until)").groupBy("url", "fetched_at").agg(F.max(F.struct(F.length("key").alias("n"), "key", "state")).alias("best"))
    active = active.select("url", "fetched_at", F.when(F.col("best.state.action") == "block", "blocked").otherwise("allowed").alias("verdict"), F.col("best.key").alias("rule"), _time(F.col("best.state.since"), plain).alias("since"))
    same = F.col("p.url").eqNullSafe(F.col("a.url")) & F.col("p.fetched_at").eqNullSafe(F.col("a.fetched_at"))
    return pairs.alias("p").join(active.alias("a"), same, "left").select("p.url", "p.fetched_at", F.coalesce("a.verdict", F.lit("none")).alias("verdict"), "a.rule", "a.since")


def filtered(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Every row of captures, with verdict, rule and since; repeated rows each come back, columns of those names are replaced, and others may have any name.

    A URL is judged by its whole length. Empty tables: no captures give no rows, and without entries every verdict is "none".
    """
    own = captures.drop("verdict", "rule", "since")
    same = F.col(f"o.{url_col}").eqNullSafe(F.col("v.url")) & F.col(f"o.{time_col}").eqNullSafe(F.col("v.fetched_at"))
    return own.alias("o").join(judged(captures, entries, url_col, time_col).alias("v"), same, "left").select("o.*", "v.verdict", "v.rule", "v.since")
