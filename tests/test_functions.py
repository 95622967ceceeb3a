from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from coverscope.functions import dates as D
from coverscope.functions import numbers as N
from coverscope.functions import text as X
from coverscope.functions import urls as U


def values(spark, data, *columns):
    return [tuple(r) for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in data], "x string" if not isinstance(data[0], tuple) else "x string, y string").select(*columns).collect()]


def fnv(text):
    h = 0x811C9DC5
    data = text.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def test_stable_id_counts_utf16_units(spark):
    texts = ["", "a", "https://wire.example/world", "é–ü", "😀 news"]
    got = values(spark, texts, X.stable_id("article", F.col("x")))
    assert got == [(f"article_{fnv(t)}",) for t in texts]


def test_title_tokens_and_jaccard(spark):
    a, b = X.title_tokens(F.col("x")), X.title_tokens(F.col("y"))
    data = [("The quake in Tokyo", "Tokyo quake update"), ("", ""), ("the of", "a")]
    assert values(spark, data, F.round(N.jaccard(a, b), 6)) == [(0.666667,), (0.0,), (0.0,)]


def test_canonical_url(spark):
    data = {
        "HTTPS://WWW.Wire.example:443/a/b/?utm_source=x&b=2&a=1#top": "https://www.wire.example/a/b?a=1&b=2",
        "http://wire.example": "http://wire.example/",
        "http://wire.example:8080/?fbclid=1": "http://wire.example:8080/",
        "not a url": None,
    }
    assert values(spark, list(data), U.canonical_url(F.col("x"))) == [(v,) for v in data.values()]
    assert values(spark, ["https://www.Wire.example/x", "nothing"], U.domain(F.col("x"))) == [("wire.example",), (None,)]


def test_page_title_is_decoded(spark):
    data = ["<x><PAGE_TITLE>Tokyo leaders\n meet &#x2013; live &amp; late</PAGE_TITLE>", "none", "<page_title> </page_title>"]
    assert values(spark, data, X.page_title(F.col("x"))) == [("Tokyo leaders meet – live & late",), (None,), (None,)]


def test_entities_language_queries(spark):
    assert values(spark, ["Tokyo Bay quake. Said Anna"], X.entities(F.col("x")))[0][0] == ["tokyo bay", "said anna"]
    assert values(spark, ["srclc:jpn; eng:GT-JPN", "eng:x", None], X.language_tag(F.col("x"))) == [("jpn",), (None,), (None,)]
    assert values(spark, ["BREAKING NEWS: Quake hits | The Wire"], X.search_query(F.col("x"))) == [("Quake hits",)]


def test_quote_window(spark):
    got = values(spark, ["a" * 100 + "Tokyo" + "b" * 100], X.quote_window(F.col("x"), F.lit(100), F.lit(105), 5))
    assert got == [("…" + "a" * 5 + "Tokyo" + "b" * 5 + "…",)]


def test_network(spark):
    data = [("wire.example", "(AP) text"), ("hot.iheart.com", ""), ("bbc.co.uk", None), ("own.example", "words")]
    assert values(spark, data, X.network(F.col("x"), F.col("y"))) == [("associated-press",), ("iheart",), ("bbc",), ("own.example",)]


def test_numbers(spark):
    data = ["5", "5.5", "NaN", "Infinity", "", None, "x"]
    assert values(spark, data, N.integer(F.col("x")), N.finite_number(F.col("x"))) == [(5, 5.0), (None, 5.5)] + [(None, None)] * 5


def test_weighted_score_leaves_missing_parts_out(spark):
    parts = {"title": F.lit(1.0), "entities": F.lit(None).cast("double"), "time": F.lit(0.5)}
    assert values(spark, ["x"], F.round(N.weighted_score(parts), 6)) == [(round((0.38 + 0.07) / 0.52, 6),)]


def test_dates(spark):
    assert values(spark, ["20260827060000", "20261301000000", "x"], D.batch_timestamp(F.col("x")).isNotNull()) == [(True,), (False,), (False,)]
    data = ["2026-08-27T01:00:00Z", "2026-02-30T01:00:00Z", "2026-08-27", "2026-08-27T01:00:00+02:00"]
    assert values(spark, data, D.rfc3339(F.col("x")).isNotNull()) == [(True,), (False,), (False,), (True,)]
    now = datetime(2026, 8, 26, 12, tzinfo=timezone.utc)
    assert D.window_start("7d", now) == datetime(2026, 8, 19, 12, tzinfo=timezone.utc)
    assert D.retry_after("7", now) == 7 and D.retry_after("x", now) is None
    with pytest.raises(ValueError):
        D.request_window(now, 200)


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_errors_without_keys(spark):
    said = ["bad key tvly-AbC_1.2-z here", "Authorization: Bearer  abc.DEF-1", "an early-stage failure of a family-owned server", "  ", None, "sk-live_1 and TVLY-x"]
    assert one(spark, [(x,) for x in said], "x string", X.redacted_error(F.col("x"))) == [
        "bad key [redacted] here", "Authorization: [redacted]", "an early-stage failure of a family-owned server", "Unknown upstream failure.", "Unknown upstream failure.", "sk-live_1 and [redacted]",
    ]
    assert one(spark, [("sk-live_1",)], "x string", X.redacted_error(F.col("x"), ("sk-",))) == ["[redacted]"]


def test_seen_dates_with_and_without_z(spark):
    got = one(spark, [("20260827T010203Z",), ("20260827T010203",), ("2026-08-27T01:02:03Z",), ("20261327T010203",), ("x",)], "x string", F.date_format(D.seen_date(F.col("x")), "yyyyMMddHHmmss"))
    assert got == ["20260827010203"] * 3 + [None, None]


def test_strict_times(spark):
    times = ["2026-08-27T06:00:00Z", "2026-08-27T06:00:00.123Z", "2026-08-27T06:00:00.1Z", "2026-08-27T06:00:00.12Z", "2026-08-27T06:00:00+00:00", "2026-02-30T06:00:00Z", "2026-08-27", None]
    assert one(spark, [(x,) for x in times], "x string", D.is_iso_utc(F.col("x"))) == [True, True, False, False, False, False, False, False]
    offsets = ["2026-08-27T06:00:00+23:59", "2026-08-27t06:00:00.5-18:30", "2026-08-27T06:00:00+24:00", "2026-08-27T06:00:00+01:60", "2024-02-29T00:00:00z", "2023-02-29T00:00:00Z"]
    got = one(spark, [(x,) for x in offsets], "x string", F.date_format(D.rfc3339(F.col("x")), "yyyy-MM-dd HH:mm:ss.S"))
    assert got == ["2026-08-26 06:01:00.0", "2026-08-28 00:30:00.5", None, None, "2024-02-29 00:00:00.0", None]


def test_titles_are_composed(spark):
    rows = [("Ｑｕａｋｅ Ｔｏｋｙｏ",), ("Quake Tokyo",), ("Cafe\u0301 fire",), ("Café fire",), (None,)]
    assert one(spark, rows, "x string", X.headline_key(F.col("x"))) == ["quake tokyo", "quake tokyo", "café fire", "café fire", None]
    assert one(spark, rows[:4], "x string", F.array_join(X.title_tokens(F.col("x")), " ")) == ["quake tokyo", "quake tokyo", "café fire", "café fire"]
    assert one(spark, rows[:4], "x string", F.array_join(X.entities(F.col("x")), "|")) == ["quake tokyo", "quake tokyo", "café", "café"]
