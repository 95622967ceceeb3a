"""Search services as a data source: a request for each query, made by the tasks, with its answer or its failure as a row."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from coverscope import schemas
from coverscope.functions import text as X
from coverscope.sources import articles

FORMAT = "news_search"
ANSWERS = "provider string, n int, query string, ok boolean, kind string, message string, retry_after_seconds double, started_at timestamp, finished_at timestamp, records int, body string"
#: Bytes of an answer at most, and seconds that a request may take; seconds that a service can make us wait.
MOST_BYTES, TIMEOUT, MOST_WAIT = 16 << 20, 20.0, 30.0
_BLOCK = 1 << 16
#: Where the records of an answer are, and how many may be asked for.
RECORDS = {"documents": ("articles", articles.MOST_DOCUMENTS), "news": ("results", articles.MOST_NEWS)}


def query(text: str, start: datetime, end: datetime, most: int) -> dict:
    """A query of a window of time, for `answers`."""
    return {"query": text, "from": start.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "to": end.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "most": most}


def request(kind: str, endpoint: str, asked: dict, token: str | None) -> urllib.request.Request:
    """The request of a query: a GET for documents, a POST with a bearer token for news."""
    most = max(1, min(RECORDS[kind][1], int(asked["most"])))
    if kind == "documents":
        stamp = lambda x: "".join(c for c in x if c.isdigit())[:14]
        params = {"query": asked["query"], "mode": "ArtList", "format": "json", "maxrecords": most, "startdatetime": stamp(asked["from"]), "enddatetime": stamp(asked["to"]), "sort": "DateDesc"}
        return urllib.request.Request(f"{endpoint}?{urllib.parse.urlencode(params)}", headers={"Accept": "application/json"})
    body = {"query": asked["query"], "topic": "news", "search_depth": "advanced", "max_results": most, "start_date": asked["from"][:10], "end_date": asked["to"][:10], "include_raw_content": False}
    headers = {"Accept": "application/json", "Content-Type": "application/json", "Authorization": f"Bearer {token}"}
    return urllib.request.Request(endpoint, json.dumps(body).encode(), headers, method="POST")


def wait_asked_for(value: str | None, now: datetime) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or a date that is to come."""
    from email.utils import parsedate_to_datetime

    if value is None:
        return None
    try:
        seconds = float(value)
        return seconds if 0 <= seconds < float("inf") else None
    except ValueError:
        pass
    try:
        at = parsedate_to_datetime(value)
    except ValueError:
        return None
    return float(max(0, -int(-(at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() // 1 + now.timestamp() // 1)))


class Failed(Exception):
    """A failure of a request, of one of schemas.FAILURES."""

    def __init__(self, kind: str, message: str, wait: float | None = None) -> None:
        super().__init__(message)
        self.kind, self.message, self.wait = kind, message, wait


def body_of(asked: urllib.request.Request, kind: str, timeout: float, most_bytes: int) -> tuple[str, int]:
    """(body, number of records) of an answer, read in blocks and no further than most_bytes; raises Failed."""
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as response:  # noqa: S310  the endpoint is the caller's
            parts, size = [], 0
            while block := response.read(_BLOCK):
                size += len(block)
                if size > most_bytes:
                    raise Failed("invalid_response", f"The answer is larger than {most_bytes} bytes.")
                parts.append(block)
        body = b"".join(parts).decode("utf-8", "replace")
        answer = json.loads(body)
    except urllib.error.HTTPError as e:
        wait = wait_asked_for(e.headers.get("Retry-After") if e.headers else None, datetime.now(UTC))
        if e.code == 429:
            raise Failed("rate_limited", "The service limits how often it is asked.", wait) from e
        if e.code in (401, 403) and kind == "news":
            raise Failed("auth", "The service refused the credential.") from e
        raise Failed("http", f"HTTP {e.code}") from e
    except TimeoutError as e:
        raise Failed("timeout", "The request took too long.") from e
    except (urllib.error.URLError, OSError) as e:
        late = isinstance(getattr(e, "reason", None), TimeoutError)
        raise Failed("timeout" if late else "network", "The request took too long." if late else str(getattr(e, "reason", e))) from e
    except ValueError as e:
        raise Failed("invalid_response", "The answer isn't JSON.") from e
    records = answer.get(RECORDS[kind][0]) if isinstance(answer, dict) else None
    if not isinstance(records, list):
        raise Failed("invalid_response", f"The answer has no array {RECORDS[kind][0]}.")
    return body, len(records)


class Queries(InputPartition):
    def __init__(self, asked: list[tuple[int, dict]]) -> None:
        self.asked = asked


class SearchReader(DataSourceReader):
    """Deals queries out to partitions and makes their requests there. A failed request is a row, and so doesn't fail the job; a lost task asks again."""

    def __init__(self, options: dict[str, str]) -> None:
        self.kind, self.endpoint, self.token = options["kind"], options["endpoint"], (options.get("token") or "").strip() or None
        self.asked = json.loads(options["queries"])
        self.at_once = int(options.get("at_once", 8))
        self.attempts, self.timeout, self.most_bytes = int(options.get("attempts", 1)), float(options.get("timeout", TIMEOUT)), int(options.get("most_bytes", MOST_BYTES))
        self.base_wait, self.most_wait = float(options.get("base_wait", 5.0)), float(options.get("most_wait", MOST_WAIT))
        if self.kind not in RECORDS:
            raise ValueError(f"kind must be one of {', '.join(RECORDS)}")

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.at_once, len(self.asked)))
        return [Queries(list(enumerate(self.asked))[i::n]) for i in range(n)]

    def read(self, partition: Queries) -> Iterator[tuple]:
        for n, asked in partition.asked:
            began = datetime.now(UTC)
            try:
                body, records = self.answer(asked)
                yield self.kind, n, asked["query"], True, None, None, None, began, datetime.now(UTC), records, body
            except Failed as e:
                yield self.kind, n, asked["query"], False, e.kind, e.message, e.wait, began, datetime.now(UTC), None, None

    def answer(self, asked: dict) -> tuple[str, int]:
        if self.kind == "news" and self.token is None:
            raise Failed("missing_key", "The service is left out, as no key was given.")
        for attempt in range(self.attempts):
            try:
                return body_of(request(self.kind, self.endpoint, asked, self.token), self.kind, self.timeout, self.most_bytes)
            except Failed as e:
                if e.kind != "rate_limited" or attempt + 1 == self.attempts:
                    raise
                time.sleep(min(self.most_wait, e.wait) if e.wait else self.base_wait * (attempt + 1))
        raise ValueError("attempts must be 1 or more")


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema) -> SearchReader:  # noqa: ANN001
        return SearchReader(dict(self.options))


def answers(spark: SparkSession, kind: str, endpoint: str, queries: list[dict], token: str | None = None, **options: float) -> DataFrame:
    """(provider, n, query, ok, kind, message, retry_after_seconds, started_at, finished_at, records, body): a row for each query, numbered from 0, asked anew whenever the result is computed; settle or write it.

    kind: documents (GET) or news (POST, with a token). options: at_once, how many partitions ask at the same time; attempts, how often a service that limits requests is asked (it is waited for as long as its Retry-After
    says, most_wait seconds at most, else base_wait times the attempt); timeout; most_bytes.
    """
    spark.dataSource.register(SearchSource)
    return spark.read.format(FORMAT).options(kind=kind, endpoint=endpoint, queries=json.dumps(queries), token=token or "", **{k: str(v) for k, v in options.items()}).load()


def _records(found: DataFrame, kind: str) -> DataFrame:
    fields = schemas.SEARCH_RESULTS if kind == "documents" else schemas.NEWS_RESULTS
    return found.where(F.col("ok") & (F.col("provider") == kind)).select("n", "query", "finished_at", F.from_json("body", fields).alias("a")).select("n", "query", "finished_at", "a.*")


def articles_of(found: DataFrame, kind: str) -> DataFrame:
    """The articles of the answers of a kind, retrieved when their answer was whole, with the query and its number."""
    of: Callable[..., DataFrame] = articles.document_articles if kind == "documents" else articles.news_articles
    return of(_records(found, kind), F.col("finished_at"), carry=("n", "query", "finished_at"))


def statuses(found: DataFrame, kind: str) -> DataFrame:
    """(provider, query, ok, kind, message, warnings): what sources.articles.source_health sums up. Records that aren't articles are warned of; messages have no keys."""
    good = articles_of(found, kind).groupBy("n").agg(F.count(F.lit(1)).alias("good"))
    own = found.where(F.col("provider") == kind).join(good, "n", "left").withColumn("bad", F.col("records") - F.coalesce("good", F.lit(0)))
    warnings = F.when(F.col("bad") > 0, F.array(F.concat(F.col("bad").cast("string"), F.lit(" malformed "), F.col("provider"), F.lit(" records were omitted.")))).otherwise(F.array().cast("array<string>"))
    return own.select("provider", "query", "ok", "kind", F.when(~F.col("ok"), X.redacted_error(F.col("message"))).alias("message"), warnings.alias("warnings"))


def retry_at(found: DataFrame) -> Column:
    """When a service that limited a request may be asked again."""
    return F.timestamp_micros(F.unix_micros("finished_at") + (F.col("retry_after_seconds") * 1_000_000).cast("long"))
