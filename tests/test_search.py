import json
import threading
import time
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from coverscope.sources import articles, search

START, END = datetime(2026, 8, 27, 1, tzinfo=UTC), datetime(2026, 8, 28, 2, 3, 4, tzinfo=UTC)
SEEN, WAITS = [], {}


class Service(BaseHTTPRequestHandler):
    """Answers by what the query says."""

    def do_GET(self):
        self.reply("articles", self.path)

    def do_POST(self):
        self.reply("results", self.rfile.read(int(self.headers["Content-Length"])).decode())

    def reply(self, key, asked):
        SEEN.append((self.command, asked, self.headers.get("Authorization")))
        code, more, body = 200, {}, json.dumps({key: [{"url": "https://a.example/1", "title": "Quake", "seendate": "20260827T010000Z", "published_date": "2026-08-27T01:10:00Z", "score": 0.9, "content": "c"}, {"url": "bad"}]})
        if "missing" in asked:
            code, body = 404, "{}"
        elif "twice" in asked:
            WAITS[asked] = WAITS.get(asked, 0) + 1
            code, more = (429, {"Retry-After": "0.2"}) if WAITS[asked] < 2 else (200, {})
        elif "limited" in asked:
            code, more = 429, {"Retry-After": "7"}
        elif "huge" in asked:
            body = json.dumps({key: ["x" * 3_000_000]})
        elif "broken" in asked:
            body = "{"
        elif "shapeless" in asked:
            body = json.dumps({key: 1})
        elif "refused" in asked:
            code = 401
        elif "slow" in asked:
            time.sleep(3)
        self.send_response(code)
        for k, v in more.items():
            self.send_header(k, v)
        self.end_headers()
        try:
            self.wfile.write(body.encode())
        except OSError:  # who asked has gone
            pass

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/search"
    server.shutdown()


def asked(*texts, most=999):
    return [search.query(t, START, END, most) for t in texts]


@pytest.mark.parametrize("kind", ["documents", "news"])
def test_each_query_has_its_answer_or_its_failure(spark, endpoint, kind):
    texts = ["fine", "missing", "limited", "huge", "broken", "shapeless", "refused", "slow", "fine"]
    found = search.answers(spark, kind, endpoint, asked(*texts), "the-token", timeout=1.0, most_bytes=1_000_000).cache()
    rows = found.orderBy("n").collect()
    assert [r["query"] for r in rows] == texts
    assert [r["kind"] for r in rows] == [None, "http", "rate_limited", "invalid_response", "invalid_response", "invalid_response", "auth" if kind == "news" else "http", "timeout", None]
    assert [r["retry_after_seconds"] for r in rows if r["kind"] == "rate_limited"] == [7.0] and all(r["started_at"] <= r["finished_at"] for r in rows)
    assert "larger than 1000000" in rows[3]["message"] and rows[1]["message"] == "HTTP 404"
    got = search.articles_of(found, kind).collect()
    assert [(r["n"], r["title"], r["canonical_url"]) for r in sorted(got, key=lambda r: r["n"])] == [(0, "Quake", "https://a.example/1"), (8, "Quake", "https://a.example/1")]
    assert all(r["published_at"] is not None and r["retrieved_at"] == rows[r["n"]]["finished_at"] for r in got)
    states = search.statuses(found, kind)
    assert sorted(tuple(r["warnings"]) for r in states.where("ok").collect()) == [(f"1 malformed {kind} records were omitted.",)] * 2
    from pyspark.sql import functions as F

    health = articles.source_health(states, F.lit(2)).first()
    assert (health["status"], health["source_count"], health["successful_source_count"]) == ("degraded", 9, 2)


def test_a_service_that_limits_is_asked_again(spark, endpoint):
    row = search.answers(spark, "news", endpoint, asked("twice"), "t", attempts=3, base_wait=0.1).first()
    assert row["ok"] and row["records"] == 2
    row = search.answers(spark, "news", endpoint, asked("limited"), "t", attempts=2, most_wait=0.1).first()
    assert row["kind"] == "rate_limited"


def test_what_is_asked(spark, endpoint):
    SEEN.clear()
    search.answers(spark, "documents", endpoint, asked("a b", most=9999)).collect()
    search.answers(spark, "news", endpoint, asked("a b", most=0), "tok").collect()
    get, post = SEEN
    assert "maxrecords=250" in get[1] and "startdatetime=20260827010000&enddatetime=20260828020304" in get[1] and "query=a+b" in get[1]
    assert json.loads(post[1]) == {"query": "a b", "topic": "news", "search_depth": "advanced", "max_results": 1, "start_date": "2026-08-27", "end_date": "2026-08-28", "include_raw_content": False} and post[2] == "Bearer tok"


def test_without_a_key_or_a_service(spark, endpoint):
    SEEN.clear()
    assert search.answers(spark, "news", endpoint, asked("fine"), " ").first()["kind"] == "missing_key" and not SEEN
    assert search.answers(spark, "documents", "http://127.0.0.1:9/none", asked("x")).first()["kind"] == "network"
    assert search.answers(spark, "documents", endpoint, []).count() == 0
    with pytest.raises(Exception, match="kind must be one of"):
        search.answers(spark, "other", endpoint, asked("x")).collect()


def test_waits():
    now = datetime(2026, 8, 27, 1, tzinfo=UTC)
    assert [search.wait_asked_for(x, now) for x in (None, "5", "-1", "soon", "Thu, 27 Aug 2026 01:00:30 GMT", "Thu, 27 Aug 2026 00:00:00 GMT", "inf")] == [None, 5.0, None, None, 30.0, 0.0, None]
