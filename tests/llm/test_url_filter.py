import random
from datetime import datetime, timedelta

from coverscope.llm import url_filter as U
from coverscope.llm.queries import ORACLES, QUERIES
from tests.oracle import same

T0 = datetime(2024, 1, 1)


def plain(url, at, entries):
    """The longest of a URL's keys whose last entry until then blocks or allows."""
    host = url.split("//")[1].split("/")[0].lower().removeprefix("www.")
    parts = [p for p in url.split("//")[1].split("?")[0].split("/")[1:] if p]
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))}
    best = None
    for k in keys:
        own = [(d, a) for key, a, d in entries if key == k and d <= at]
        if own and max(own)[1] in ("block", "allow") and (best is None or (len(k), k) > best[0]):
            best = ((len(k), k), max(own)[1])
    return "none" if best is None else {"block": "blocked", "allow": "allowed"}[best[1]]


def test_as_of_join_against_every_entry(spark, monkeypatch):
    monkeypatch.setattr(U, "BUCKET", 3600)
    random.seed(4)
    hosts = ["a.example", "www.b.a.example", "c.test"]
    urls = [f"https://{h}{p}" for h in hosts for p in ("", "/", "/x", "/x/y?q=1")]
    keys = ["a.example", "b.a.example", "example", "c.test/x", "c.test", "b.a.example/x/y"]
    entries = [(random.choice(keys), random.choice(["block", "allow", "clear"]), T0 + timedelta(minutes=random.randrange(6000))) for _ in range(60)]
    captures = [(i, random.choice(urls), T0 + timedelta(minutes=random.randrange(7000))) for i in range(200)] + [(200, urls[0], entries[0][2])]
    got = U.filtered(spark.createDataFrame(captures, "id int, url string, fetched_at timestamp_ntz"), spark.createDataFrame(entries, "key string, action string, dated timestamp_ntz")).collect()
    assert {r["id"]: r["verdict"] for r in got} == {i: plain(u, t, entries) for i, u, t in captures}


def test_nulls_repeats_and_empty_tables(spark):
    captures = spark.createDataFrame([(1, None, T0), (2, "https://a.example/", None), (3, "no url", T0), (4, "https://a.example", T0), (4, "https://a.example", T0)], "id int, url string, fetched_at timestamp_ntz")
    entries = spark.createDataFrame([("a.example", "block", T0), (None, "block", T0), ("A.EXAMPLE", "allow", T0)], "key string, action string, dated timestamp_ntz")
    got = sorted((r["id"], r["verdict"]) for r in U.filtered(captures, entries).collect())
    assert got == [(1, "none"), (2, "none"), (3, "none"), (4, "blocked"), (4, "blocked")]
    assert U.filtered(captures.where("false"), entries).count() == 0
    assert {r["verdict"] for r in U.filtered(captures, entries.where("false")).collect()} == {"none"}


def test_columns_of_any_name(spark):
    captures = spark.createDataFrame([(1, "https://a.example/", T0, "u", "t", "old")], "key int, url string, fetched_at timestamp_ntz, _u string, _t string, verdict string")
    entries = spark.createDataFrame([("a.example", "block", T0)], "key string, action string, dated timestamp_ntz")
    got = U.filtered(captures, entries)
    assert got.columns == ["key", "url", "fetched_at", "_u", "_t", "verdict", "rule", "since"] and [tuple(r)[3:7] for r in got.collect()] == [("u", "t", "blocked", "a.example")]


def test_a_capture_after_the_end_of_an_interval_is_not_judged_by_it(spark, monkeypatch):
    whole = U.validity
    # Intervals decide: with ends brought forward by a day, what was fetched between has no entry.
    monkeypatch.setattr(U, "validity", lambda e: whole(e).selectExpr("key", "action", "valid_from", "valid_to - interval 1 day as valid_to"))
    entries = spark.createDataFrame([("a.example", "block", T0), ("a.example", "clear", T0 + timedelta(days=5))], "key string, action string, dated timestamp_ntz")
    captures = spark.createDataFrame([(i, "https://a.example/", T0 + timedelta(days=i)) for i in range(7)], "id int, url string, fetched_at timestamp_ntz")
    assert {r["id"] for r in U.filtered(captures, entries).where("verdict = 'blocked'").collect()} == {0, 1, 2, 3}


def test_intervals(spark):
    entries = spark.createDataFrame([("k", "block", T0), ("k", "clear", T0 + timedelta(days=1))], "key string, action string, dated timestamp_ntz")
    got = {r["action"]: (r["valid_from"], r["valid_to"]) for r in U.validity(entries).collect()}
    assert got == {"block": (T0, T0 + timedelta(days=1)), "clear": (T0 + timedelta(days=1), None)}
    times = [T0 + timedelta(hours=7 * i * i % 500) for i in range(40)]
    many = spark.createDataFrame([("k", "block", t) for t in times], "key string, action string, dated timestamp_ntz")
    own = sorted(set(times))
    assert sorted((r["valid_from"], r["valid_to"] or T0) for r in U.validity(many).collect()) == list(zip(own, [*own[1:], T0], strict=True))


def test_query_is_as_its_sql(spark):
    same(spark, "/root/testdata/sf0.001", QUERIES["op4_url_filter"], ORACLES["op4_url_filter"])


def test_the_zone_of_the_session_does_not_matter(spark):
    rows = spark.sql("select 'https://a.example/' as url, timestamp_ntz'2024-03-31 02:30:00' as fetched_at union all select 'https://a.example/', timestamp_ntz'2024-03-31 03:00:00'")
    listed = spark.sql("select 'a.example' as key, 'block' as action, timestamp_ntz'2024-03-31 03:00:00' as dated")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = U.filtered(rows, listed)
            assert [(r["verdict"], str(r["since"])) for r in got.orderBy("fetched_at").collect()] == [("none", "None"), ("blocked", "2024-03-31 03:00:00")]
            assert got.schema["since"].dataType.simpleString() == "timestamp_ntz"
            # Instants an hour apart that are written alike.
            both = spark.sql("select 'https://a.example/' as url, timestamp_seconds(1729989000 + id * 3600) as fetched_at from range(2)")
            dated = spark.sql("select 'a.example' as key, 'block' as action, timestamp_seconds(1729991000) as dated")
            got = U.filtered(both, dated)
            assert [r["verdict"] for r in got.orderBy("fetched_at").collect()] == ["none", "blocked"] and got.schema["since"].dataType.simpleString() == "timestamp"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
