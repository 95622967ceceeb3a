"""Batches of three files: their manifests, archives and tables of tab-separated text."""

from __future__ import annotations

import hashlib
import re
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverscope.functions import dates as D
from coverscope.functions import numbers as N
from coverscope.functions import text as X
from coverscope.functions.urls import is_http_url

# How file names end, by kind.
SUFFIXES = {"events": ".export.CSV.zip", "mentions": ".mentions.CSV.zip", "documents": ".gkg.csv.zip"}
STEP = timedelta(minutes=15)
MOST_FALLBACKS = 8
#: Bytes of a table that come out of an archive at once.
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class ManifestEntry:
    kind: str
    compressed_bytes: int
    md5: str
    url: str
    batch_id: str


@dataclass(frozen=True)
class FetchPolicy:
    timeout: float = 20.0
    attempts: int = 3
    base_delay: float = 0.25
    most_delay: float = 5.0


class SourceError(Exception):
    """A failure of a source, of one of schemas.FAILURES."""

    def __init__(self, kind: str, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.kind, self.status = kind, status


def parse_line(line: str, host: str) -> ManifestEntry:
    """A row of a manifest: bytes, MD5, URL of the given host."""
    m = re.fullmatch(r"(\d+)\s+([a-fA-F0-9]{32})\s+(https?://\S+)", line.strip())
    if not m or int(m[1]) <= 0:
        raise ValueError("a manifest row must hold bytes, MD5 and a URL")
    parts = urlsplit(m[3])
    if (parts.hostname or "").lower() != host:
        raise ValueError("a manifest URL has an unexpected host")
    kind = next((k for k, s in SUFFIXES.items() if parts.path.endswith(s)), None)
    stamp = re.match(r"(\d{14})\.", parts.path.rsplit("/", 1)[-1])
    if kind is None or stamp is None:
        raise ValueError("a manifest URL has an unexpected name")
    batch_time(stamp[1])
    port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    return ManifestEntry(kind, int(m[1]), m[2].lower(), f"https://{host}{port}{parts.path}" + (f"?{parts.query}" if parts.query else ""), stamp[1])


def batch_time(batch_id: str) -> datetime:
    return datetime.strptime(batch_id, "%Y%m%d%H%M%S")


def parse_latest(text: str, host: str) -> dict[str, ManifestEntry]:
    """The three files of the latest batch, by kind."""
    entries = [parse_line(x, host) for x in text.splitlines() if x.strip()]
    if len(entries) != 3 or {e.kind for e in entries} != set(SUFFIXES) or len({e.batch_id for e in entries}) != 1:
        raise ValueError("the latest manifest must hold one file of each kind, of one batch")
    return {e.kind: e for e in entries}


def parse_tail(text: str, before: str, host: str, most: int = MOST_FALLBACKS) -> list[dict[str, ManifestEntry]]:
    """Whole earlier batches of the end of a master list, newest first, up to `most` steps before. Only the first line may be cut."""
    if not 1 <= most <= MOST_FALLBACKS:
        raise ValueError(f"fallbacks must be from 1 to {MOST_FALLBACKS}")
    limit = batch_time(before)
    batches: dict[str, dict[str, ManifestEntry]] = {}
    for i, line in enumerate(text.split("\n")):
        if not line.strip():
            continue
        try:
            entry = parse_line(line, host)
        except ValueError:
            if i == 0:
                continue
            raise
        age = limit - batch_time(entry.batch_id)
        if timedelta(0) < age <= most * STEP and age % STEP == timedelta(0):
            if entry.kind in (own := batches.setdefault(entry.batch_id, {})):
                raise ValueError("the master list repeats a file of a batch")
            own[entry.kind] = entry
    return [b for _, b in sorted(batches.items(), reverse=True) if len(b) == len(SUFFIXES)]


def manifest_rows(lines: DataFrame) -> DataFrame:
    """The same of a table of lines (value), for long master lists: compressed_bytes, md5, url, kind, batch_id; rows that are none are left out."""
    part = lambda i: F.regexp_extract("value", r"^\s*(\d+)\s+([a-fA-F0-9]{32})\s+(https?://\S+)\s*$", i)
    own = lines.select(part(1).try_cast("long").alias("compressed_bytes"), F.lower(part(2)).alias("md5"), F.regexp_replace(part(3), r"^http://", "https://").alias("url"))
    kind = F.when(F.lit(False), "")
    for k, s in SUFFIXES.items():
        kind = kind.when(F.col("url").endswith(s), k)
    own = own.withColumn("kind", kind).withColumn("batch_id", F.regexp_extract("url", r"/(\d{14})\.[^/]*$", 1))
    return own.where((F.col("compressed_bytes") > 0) & F.col("kind").isNotNull() & D.batch_timestamp(F.col("batch_id")).isNotNull())


def complete_batches(rows: DataFrame, before: str, most: int = MOST_FALLBACKS) -> DataFrame:
    """(batch_id, batch_time) of whole batches up to `most` steps before, newest first."""
    at = D.batch_timestamp(F.col("batch_id"))
    age = (F.unix_timestamp(F.lit(batch_time(before))) - F.unix_timestamp(at)).cast("long")
    own = rows.withColumn("batch_time", at).where((age > 0) & (age <= int(most * STEP.total_seconds())) & (age % int(STEP.total_seconds()) == 0))
    whole = own.groupBy("batch_id", "batch_time").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("k")).where("n = 3 and k = 3")
    return whole.select("batch_id", "batch_time").orderBy(F.col("batch_id").desc())


def fetch(url: str, most_bytes: int, policy: FetchPolicy = FetchPolicy(), opener=urllib.request.urlopen, sleep=time.sleep) -> bytes:  # noqa: ANN001
    """The body of a URL, of most_bytes at most; tries again, later each time, where that may help. A landing step of the driver."""
    for attempt in range(policy.attempts):
        wait = min(policy.most_delay, policy.base_delay * 2**attempt)
        try:
            with opener(url, timeout=policy.timeout) as response:
                body = response.read(most_bytes + 1)
            if len(body) > most_bytes:
                raise SourceError("invalid_response", "the body is larger than allowed")
            return body
        except urllib.error.HTTPError as e:
            kind = "rate_limited" if e.code == 429 else "auth" if e.code in (401, 403) else "http"
            error = SourceError(kind, f"HTTP {e.code}", e.code)
            if e.code not in (408, 425, 429) and e.code < 500:
                raise error from e
            asked = D.retry_after(e.headers.get("Retry-After") if e.headers else None, datetime.now().astimezone())
            wait = min(policy.most_delay, asked) if asked is not None else wait
        except TimeoutError as e:
            error = SourceError("timeout", str(e))
        except urllib.error.URLError as e:
            error = SourceError("network", str(e.reason))
        if attempt + 1 < policy.attempts:
            sleep(wait)
    raise error


def verify(data: bytes, entry: ManifestEntry) -> None:
    """Raises unless the bytes are those of the manifest."""
    if len(data) != entry.compressed_bytes or hashlib.md5(data).hexdigest() != entry.md5:
        raise SourceError("invalid_response", "the archive isn't the one of the manifest")


def unzipped(data, most_bytes: int) -> Iterator[bytes]:  # noqa: ANN001
    """The bytes of an archive's only table, a block at a time; nothing else may be in it, nor a path that leads out of it. data: bytes or a buffer of them.

    The size is capped as the archive states it, and again as it comes out.
    """
    with zipfile.ZipFile(pa.BufferReader(data)) as z:
        files = [f for f in z.infolist() if not f.is_dir()]
        if len(files) != 1 or not files[0].filename.lower().endswith(".csv") or ".." in files[0].filename.split("/") or files[0].filename.startswith("/"):
            raise SourceError("invalid_response", "an archive must hold one table")
        if files[0].file_size > most_bytes:
            raise SourceError("invalid_response", "the table is larger than allowed")
        size = 0
        with z.open(files[0]) as f:
            while block := f.read(BLOCK_BYTES):
                size += len(block)
                if size > most_bytes:
                    raise SourceError("invalid_response", "the table is larger than allowed")
                yield block


def unzip_one(data: bytes, most_bytes: int) -> str:
    """The text of an archive's only table, whole (unzipped)."""
    return b"".join(unzipped(data, most_bytes)).decode("utf-8", "replace")


def lines_of(blocks: Iterator[bytes]) -> Iterator[list[str]]:
    """The lines of a text that comes in blocks, without those that are empty, some at a time. A line ends with \\n or \\r\\n; bytes that are no UTF-8 are U+FFFD."""
    rest: list[bytes] = []
    for block in blocks:
        head, found, tail = block.rpartition(b"\n")
        if not found:
            rest.append(block)
            continue
        whole = b"".join([*rest, head])
        rest = [tail]
        yield [x for line in whole.split(b"\n") if (x := line.removesuffix(b"\r").decode("utf-8", "replace"))]
    yield [x] if (x := b"".join(rest).decode("utf-8", "replace")) else []


def archives(spark: SparkSession, path: str, most_bytes: int = 256 << 20) -> DataFrame:
    """(path, bytes, md5, content) of landed archives. Files of over most_bytes aren't read: their content is null."""
    files = spark.read.format("binaryFile").load(path)
    small, large = files.where(F.col("length") <= most_bytes), files.where(F.col("length") > most_bytes)  # both conditions reach the reader
    own = small.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), "content")
    return own.unionAll(large.select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("md5"), F.lit(None).cast("binary").alias("content")))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Archives that are as the manifest says."""
    return files.join(manifest.select(F.col("compressed_bytes").alias("bytes"), "md5", "kind", "batch_id"), ["bytes", "md5"])


def archive_lines(files: DataFrame, most_bytes: int = 512 << 20) -> DataFrame:
    """(path, ord, value): the lines of archives' tables, in order, without empty ones. A task holds an archive as it is landed, and of its table a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not content.is_valid:
                    raise SourceError("invalid_response", "the archive is larger than allowed")
                at = 0
                for some in lines_of(unzipped(content.as_buffer(), most_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.string())], names=["path", "ord", "value"])
                    at += len(some)

    return files.select("path", "content").mapInArrow(run, "path string, ord long, value string")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, value) of landed tables of plain text, without blank lines; ord numbers a file's lines from 0.

    Files are read in blocks. A line's number is its place in its block, by ids that follow each other in a task, and the lines of the file's blocks before,
    from one row for each block.
    """
    own = spark.read.text(path).where(F.length(F.rtrim("value")) > 0)
    own = own.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("value"))
    blocks = own.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("path", "block", "first", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    return own.join(blocks, ["path", "block"]).select("path", (F.col("id") - F.col("first") + F.col("before")).alias("ord"), "value")


def first_rows(lines: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """The first `most` lines of each file in order, valid or not (a batch's cap is on what it reads), and the condition of a further one."""
    return lines.where(F.col("ord") < most), F.col("ord") >= most


def _fields(lines: DataFrame, least: int) -> DataFrame:
    return lines.select("ord", F.split("value", "\t").alias("f")).withColumn("enough", F.size("f") >= least)


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def parsed_events(lines: DataFrame) -> DataFrame:
    """Events of lines, with valid: columns as schemas.EVENTS. A place counts whole or not at all."""
    kind, lat, lon, name = N.integer(_at(51)), N.finite_number(_at(56)), N.finite_number(_at(57)), X.optional(_at(52))
    place = kind.isNotNull() & name.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)
    geo = F.when(
        place,
        F.struct(
            kind.cast("int").alias("type"), name.alias("full_name"), X.optional(_at(53)).alias("country_code"), X.optional(_at(54)).alias("adm1_code"), X.optional(_at(55)).alias("adm2_code"),
            lat.alias("latitude"), lon.alias("longitude"), X.optional(_at(58)).alias("feature_id"),
        ),
    )
    url = X.optional(_at(60))
    own = _fields(lines, 61).select(X.optional(_at(0)).alias("event_id"), "ord", D.batch_timestamp(F.trim(_at(59))).alias("date_added"), F.when(is_http_url(url), url).alias("source_url"), geo.alias("geo"), "enough")
    return own.withColumn("valid", F.col("enough") & F.col("event_id").isNotNull() & F.col("date_added").isNotNull()).drop("enough")


def parsed_mentions(lines: DataFrame) -> DataFrame:
    """Mentions of lines, with valid: columns as schemas.MENTIONS."""
    raw = F.trim(_at(10))
    own = _fields(lines, 15).select(
        X.optional(_at(0)).alias("event_id"), "ord", D.batch_timestamp(F.trim(_at(1))).alias("event_time"), D.batch_timestamp(F.trim(_at(2))).alias("mention_time"), N.integer(_at(3)).cast("int").alias("mention_type"),
        X.optional(_at(4)).alias("source_name"), X.optional(_at(5)).alias("identifier"), N.integer(_at(6)).cast("int").alias("sentence_id"), F.when(raw.isin("0", "1"), raw == "1").alias("in_raw_text"),
        N.finite_number(_at(11)).alias("confidence"), X.optional(_at(14)).alias("translation"), "enough",
    )
    need = [F.col(c).isNotNull() for c in ("event_id", "event_time", "mention_time", "mention_type", "source_name", "in_raw_text")]
    valid = F.col("enough") & is_http_url(F.col("identifier")) & F.col("confidence").between(0, 100)
    for x in need:
        valid = valid & x
    return own.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("enough")


def parsed_documents(lines: DataFrame) -> DataFrame:
    """Documents of lines, with valid: columns as schemas.DOCUMENTS."""
    own = _fields(lines, 27).select(
        X.optional(_at(0)).alias("record_id"), "ord", D.batch_timestamp(F.trim(_at(1))).alias("published_at"), N.integer(_at(2)).cast("int").alias("collection"), X.optional(_at(3)).alias("common_name"),
        X.optional(_at(4)).alias("document_id"), X.optional(_at(25)).alias("translation"), X.page_title(_at(26)).alias("title"), "enough",
    )
    valid = F.col("enough") & is_http_url(F.col("document_id"))
    for c in ("record_id", "published_at", "collection", "common_name"):
        valid = valid & F.col(c).isNotNull()
    return own.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("enough")


def diagnostics(parsed: DataFrame, capped: bool = False) -> DataFrame:
    """One row: rows seen, accepted, malformed, and whether the cap was met."""
    return parsed.agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if("valid").alias("rows_accepted"), F.count_if(~F.col("valid")).alias("rows_malformed"), F.lit(capped).alias("hit_row_cap"))


def summed_diagnostics(all_of: DataFrame) -> DataFrame:
    return all_of.agg(F.sum("rows_seen").alias("rows_seen"), F.sum("rows_accepted").alias("rows_accepted"), F.sum("rows_malformed").alias("rows_malformed"), F.bool_or("hit_row_cap").alias("hit_row_cap"))


def first_loadable(candidates: list, load, fallbacks: int = 4):  # noqa: ANN001, ANN201
    """(what load gives of the first candidate that has its files, how many were passed over). Only a missing file (404) passes to the next; other failures end it."""
    if not 0 <= fallbacks <= MOST_FALLBACKS:
        raise ValueError(f"fallbacks must be from 0 to {MOST_FALLBACKS}")
    for i, candidate in enumerate(candidates[: fallbacks + 1]):
        try:
            return load(candidate), i
        except SourceError as e:
            if e.status != 404 or i == min(len(candidates), fallbacks + 1) - 1:
                raise
    raise SourceError("http", "no batch could be read", 404)
