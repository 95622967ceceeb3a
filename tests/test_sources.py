import hashlib
import io
import os
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coverscope import schemas
from coverscope.plans import pipeline, snapshot
from coverscope.sources import articles as A
from coverscope.sources import batch as B
from coverscope.sources import sinks
from coverscope.streaming import micro_batch

HOST = "data.feed.example"
NOW = datetime(2026, 8, 27, 6, 5)


def line(batch, kind, host=HOST):
    return f"100 {'a' * 32} http://user:pw@{host}/v2/{batch}{B.SUFFIXES[kind]}"


def manifest(batch):
    return "\n".join(line(batch, k) for k in B.SUFFIXES)


def test_latest_manifest():
    got = B.parse_latest(manifest("20260827060000"), HOST)
    assert set(got) == set(B.SUFFIXES) and got["events"].url == f"https://{HOST}/v2/20260827060000.export.CSV.zip"
    for bad in (manifest("20260827060000").split("\n", 1)[1], manifest("20260827060000").replace(HOST, "other.example"), manifest("20261327060000")):
        with pytest.raises(ValueError):
            B.parse_latest(bad, HOST)


def test_tail_gives_whole_batches_newest_first(spark):
    text = "cut off\n" + "\n".join([manifest("20260827053000"), manifest("20260827054500"), line("20260827051500", "events"), manifest("20260827060000")])
    assert [b["events"].batch_id for b in B.parse_tail(text, "20260827060000", HOST)] == ["20260827054500", "20260827053000"]
    with pytest.raises(ValueError):
        B.parse_tail("a\nb", "20260827060000", HOST)
    rows = B.manifest_rows(spark.createDataFrame([(x.replace("user:pw@", ""),) for x in text.split("\n")], "value string"))
    assert [r["batch_id"] for r in B.complete_batches(rows, "20260827060000").collect()] == ["20260827054500", "20260827053000"]


def zipped(text, name="a.csv"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, text)
    return out.getvalue()


def test_archives():
    data = zipped("x\ty")
    entry = B.ManifestEntry("events", len(data), hashlib.md5(data).hexdigest(), "https://h/x", "20260827060000")
    B.verify(data, entry)
    assert B.unzip_one(data, 10) == "x\ty"
    for call in (lambda: B.verify(data + b"x", entry), lambda: B.unzip_one(data, 2), lambda: B.unzip_one(zipped("x", "../a.csv"), 10), lambda: B.unzip_one(zipped("x", "a.txt"), 10)):
        with pytest.raises(B.SourceError):
            call()


def test_archives_come_out_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 7)
    tables = {"a": "x\ty\r\n\r\nlonger than a block é\n\n\nlast", "b": "", "c": "one\n", "d": "ü" * 40 + "\n" + "z" * 50}
    for name, text in tables.items():
        (tmp_path / f"{name}.zip").write_bytes(zipped(text))
    found = B.archive_lines(B.archives(spark, str(tmp_path / "*.zip"))).collect()
    assert sorted((r["path"][-5], r["ord"], r["value"]) for r in found) == sorted((k, i, x) for k, t in tables.items() for i, x in enumerate(y for y in t.replace("\r\n", "\n").split("\n") if y))
    for bad in (zipped("x", "../a.csv"), zipped("x" * 99)):
        (tmp_path / "e.zip").write_bytes(bad)
        with pytest.raises(Exception, match="an archive must hold one table|larger than allowed"):
            B.archive_lines(B.archives(spark, str(tmp_path / "e.zip")), 90).collect()
    large = B.archives(spark, str(tmp_path / "*.zip"), 150)
    assert {r["path"][-5]: r["content"] is None for r in large.collect()} == {k: (tmp_path / f"{k}.zip").stat().st_size > 150 for k in "abcde"}
    with pytest.raises(Exception, match="the archive is larger than allowed"):
        B.archive_lines(B.archives(spark, str(tmp_path / "*.zip"), 10)).collect()


def test_a_table_of_any_size_takes_a_block_of_memory(tmp_path):
    import subprocess
    import sys

    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("t.csv", "w", force_zip64=True) as f:
        block = b"".join(b"%d\tsome text of a line\n" % i for i in range(40_000))
        for _ in range(6 * 10**8 // len(block)):
            f.write(block)
    code = "import resource, sys; from coverscope.sources import batch as B; print(sum(len(x) for x in B.lines_of(B.unzipped(open(sys.argv[1], 'rb').read(), 10**9))), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    lines, kilobytes = map(int, subprocess.run([sys.executable, "-c", code, str(tmp_path / "big.zip")], capture_output=True, text=True, check=True, timeout=300, cwd=root).stdout.split())
    assert lines == 6 * 10**8 // len(block) * 40_000 and kilobytes < 300_000


def test_fallback_only_for_missing_files():
    def load(x):
        if x < 2:
            raise B.SourceError("http", "missing", 404)
        return x

    assert B.first_loadable([0, 1, 2], load) == (2, 2)
    with pytest.raises(B.SourceError):
        B.first_loadable([0, 1, 2], load, fallbacks=1)

    def broken(x):
        raise B.SourceError("invalid_response", "checksum")

    with pytest.raises(B.SourceError, match="checksum"):
        B.first_loadable([0, 1], broken)


def event_line(i, lat="35.6762"):
    f = [""] * 61
    f[0], f[59], f[60] = i, "20260827060000", "https://wire.example/world/tokyo"
    f[51:59] = ["4", "Tokyo, Tokyo, Japan", "JA", "JA40", "", lat, "139.6503", "-246227"]
    return "\t".join(f)


def mention_line(i, url, confidence="92"):
    f = [""] * 15
    f[0], f[1], f[2], f[3], f[4], f[5], f[6], f[10], f[11], f[14] = i, "20260827060000", "20260827060000", "1", "wire.example", url, "1", "1", confidence, "srclc:jpn; eng:GT-JPN"
    return "\t".join(f)


def document_line(i, url, title="Tokyo leaders meet &#x2013; live"):
    f = [""] * 27
    f[0], f[1], f[2], f[3], f[4], f[26] = i, "20260827060000", "1", "wire.example", url, f"<PAGE_TITLE>{title}</PAGE_TITLE>" if title else ""
    return "\t".join(f)


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "ord long, value string")


def test_batch_to_serving_tables(spark, tmp_path):
    a, b = "https://wire.example/world/tokyo", "https://other.example/tokyo?utm_source=x"
    events = B.parsed_events(lines(spark, [event_line("1"), event_line("2"), event_line("3", "95"), "short"]))
    mentions = B.parsed_mentions(lines(spark, [mention_line("1", a), mention_line("2", a), mention_line("1", b), mention_line("3", a), mention_line("1", "https://none.example/x"), mention_line("1", a, "101")]))
    documents = B.parsed_documents(lines(spark, [document_line("d1", a), document_line("d2", b)]))
    assert tuple(B.diagnostics(events).first()) == (4, 3, 1, False)
    assert tuple(B.diagnostics(mentions).first()) == (6, 5, 1, False)
    own = snapshot.build(*(x.where("valid").drop("valid") for x in (events, mentions, documents)), F.lit(NOW))
    stats = own.statistics.first().asDict()
    assert (stats["eligible"], stats["joined"], stats["without_document"], stats["clusters_provisional"], stats["clusters_emitted"]) == (4, 3, 1, 2, 1)
    cluster = own.clusters.first()
    assert (cluster["cluster_id"], cluster["title"], cluster["article_count"], cluster["outlet_count"]) == ("event_1", "Tokyo leaders meet – live", 2, 2)
    assert {r["language"] for r in own.articles.collect()} == {"jpn"}
    tables = snapshot.serving_tables(own, "batch:20260827060000")
    assert tables["story_clusters"].first()["primary_region_code"] == "JA"
    assert tables["story_location_evidence"].count() == 2
    path = str(tmp_path / "clusters")
    for _ in range(2):
        sinks.write_run(tables["story_clusters"], path)
    sinks.write_run(tables["story_clusters"].withColumn("run_id", F.lit("batch:other")), path)
    stored = sinks.read_serving(spark, path)
    assert stored.count() == 2
    assert sinks.without_runs(stored, ["batch:other"], "batch:20260827060000").count() == 1
    with pytest.raises(ValueError):
        sinks.without_runs(stored, ["batch:20260827060000"], "batch:20260827060000")
    script = [r["value"] for r in sinks.sql_script(tables["story_clusters"], "story_clusters", "batch:1", ["cluster_id"]).collect()]
    assert script[0].startswith("DELETE") and "Tokyo leaders" in script[1]
    both = snapshot.composed([own, own], 200)
    assert both.clusters.count() == 1


def test_search_answers_to_a_truth_slice(spark):
    answer = spark.createDataFrame([([("https://a.example/1?utm_source=x", "Tokyo quake shakes towers", "20260827T010000Z", "a.example", "English", "Japan"), ("bad", "x", None, None, None, None)],)], schemas.SEARCH_RESULTS)
    news = spark.createDataFrame([([("Quake shakes Tokyo towers", "https://b.example/2", "In Tokyo the towers shook.", "2026-08-27T01:10:00Z", 0.9), ("Tokyo quake shakes towers", "https://a.example/1", "A longer summary", None, 0.5)],)], schemas.NEWS_RESULTS)
    found = A.document_articles(answer, F.lit(NOW)).drop("origin_country").withColumn("ord", F.lit(0)).unionByName(A.news_articles(news, F.lit(NOW)).withColumn("ord", F.lit(1)))
    assert found.count() == 3 and A.unique_articles(found).count() == 2
    aliases = spark.createDataFrame([("tokyo", "tyo", "Tokyo", "city", "JP", None, 35.7, 139.7)], "alias string, place_id string, name string, kind string, country string, admin1 string, latitude double, longitude double")
    result = pipeline.run(found, aliases)
    assert result.clusters.first()["outlet_count"] == 2
    got = pipeline.truth_slice(result, F.lit("2026-08-26").cast("timestamp"), F.lit("2026-08-28").cast("timestamp")).first()
    assert got["outcome"] == "ok"
    assert pipeline.truth_slice(result, F.lit("2020-01-01").cast("timestamp"), F.lit("2020-01-02").cast("timestamp")).first()["outcome"] == "no_current_cluster"
    statuses = spark.createDataFrame([("documents", True, None, None, []), ("news", False, "timeout", "slow", None)], "provider string, ok boolean, kind string, message string, warnings array<string>")
    health = A.source_health(statuses, F.lit(2)).first()
    assert (health["status"], health["warnings"]) == ("degraded", ["news: timeout — slow"])


def test_upserts(spark):
    run = lambda i, status, fingerprint: (i, "batch", status, fingerprint, NOW, None, None, 1, 1, None, None, False, None, NOW)
    stored = spark.createDataFrame([run("a", "running", "f"), run("b", "succeeded", "f"), run("c", "running", "f"), run("k", "running", "f")], schemas.RUNS)
    incoming = spark.createDataFrame([run("a", "succeeded", "f"), run("b", "succeeded", "f"), run("c", "succeeded", "g"), run("d", "running", "f")], schemas.RUNS)
    got = {r["run_id"]: (r["outcome"], r["status"]) for r in sinks.upserted_runs(stored, incoming).collect()}
    assert got == {"a": ("updated", "succeeded"), "b": ("replayed", "succeeded"), "c": ("conflict", "running"), "d": ("inserted", "running"), "k": ("kept", "running")}


def test_streamed_batches_can_be_replayed(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("r1", NOW, 1), ("r2", NOW, 2)], "run_id string, ts timestamp, n int")
    df.write.parquet(source)
    for checkpoint in ("c1", "c2"):  # the second knows nothing of the first
        stream = micro_batch.read_stream(spark, source, df.schema)
        micro_batch.run_available(stream, str(tmp_path / checkpoint), micro_batch.idempotent_write(sink)).awaitTermination()
    assert spark.read.parquet(sink).count() == 2
    counts = micro_batch.rolling_counts(micro_batch.read_stream(spark, source, df.schema), "ts", ["run_id"], "1 hour", "1 hour")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").count() == 2


def test_fetch_tries_again_and_caps():
    calls = []

    class Body:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self, n):
            return b"x" * min(n, 5)

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 2:
            raise TimeoutError("slow")
        return Body()

    assert B.fetch("https://h/x", 10, opener=opener, sleep=lambda s: None) == b"xxxxx"
    with pytest.raises(B.SourceError):
        B.fetch("https://h/x", 3, opener=opener, sleep=lambda s: None)


def test_first_rows_of_each_file(spark, tmp_path):
    for name, n in (("a", 5), ("b", 2000)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name}{i}\r\n" + "\n" * (i % 3 == 0) for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # several blocks a file
    try:
        own = B.text_lines(spark, str(tmp_path / "*.csv"))
        assert sorted((r["path"][-5], r["ord"], r["value"]) for r in own.collect()) == [("a", i, f"a{i}") for i in range(5)] + [("b", i, f"b{i}") for i in range(2000)]
        kept, more = B.first_rows(own, 3)
        assert sorted(r["value"] for r in kept.collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"] and own.where(more).count() == 1999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_batches_are_passed_on_when_they_are_whole(spark, tmp_path):
    source, folder, seen = tmp_path / "in", tmp_path / "folder", []
    schema = "batch_id string, kind string, run_id string, n int"
    handle = micro_batch.coherent(lambda df, n: seen.append((n, sorted((r["batch_id"], r["kind"], r["n"]) for r in df.collect()))), str(folder), keep=2)
    b1, b2, b3 = "20260827060000", "20260827061500", "20260827063000"
    triggers = [
        [(b1, "events", "r1", 1), (b2, "events", "r2", 5)], [(b1, "mentions", "r1", 2)], [(b1, "documents", "r1", 3), (b3, "events", "r3", 9)],
        [(b1, "documents", "r1", 4)],  # the second half of a kind
        [(b2, "mentions", "r2", 6)], [(b2, "documents", "r2", 7)], [(b3, "mentions", "r3", 9)], [(b1, "events", "r1", 8)],  # too late
    ]
    for rows in triggers:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = micro_batch.read_stream(spark, str(source), spark.createDataFrame([], schema).schema, 1)
        micro_batch.run_available(stream, str(tmp_path / "c"), handle).awaitTermination()
    whole = [(b1, "documents", 3), (b1, "events", 1), (b1, "mentions", 2)]
    assert seen == [(2, whole), (3, sorted([*whole, (b1, "documents", 4)])), (5, [(b2, "documents", 7), (b2, "events", 5), (b2, "mentions", 6)])]
    assert sorted(x.name for x in (folder / "pending").glob("batch_id=*")) == [f"batch_id={b2}", f"batch_id={b3}"]
    assert [r["n"] for r in spark.read.parquet(str(folder / "late")).collect()] == [8]
    # A trigger that is done again passes on the same.
    handle(spark.createDataFrame(triggers[5], schema), 5)
    assert seen[-1] == seen[-2]


def test_windows_are_put_together_from_panes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(NOW + timedelta(seconds=rng.randrange(9 * 86400)), rng.choice("ab"), rng.choice("xyz")) for _ in range(3000)] + [(NOW + timedelta(minutes=15 * i), "a", "edge") for i in range(900)] + [(None, "a", "x")]
    events = spark.createDataFrame(rows, "at timestamp, kind string, outlet string")
    add = micro_batch.add_to_panes(str(tmp_path / "panes"), "at", ["kind"], "outlet")
    parts = events.randomSplit([1.0, 1.0, 1.0], 5)
    for n, part in enumerate(parts):
        add(part, n)
        here = parts[0] if n == 0 else here.unionAll(part)  # noqa: F821
        stored = spark.read.parquet(str(tmp_path / "panes"))
        for hours, off in ((6, 0), (24, 7), (168, 899)):
            end = NOW + timedelta(days=8, seconds=off)
            got = micro_batch.window_of(stored, here, "at", ["kind"], "outlet", F.lit(end), f"{hours} hours")
            want = here.where(F.col("at").between(F.lit(end - timedelta(hours=hours)), F.lit(end))).groupBy("kind").agg(F.count(F.lit(1)), F.countDistinct("outlet"), F.min("at"), F.max("at"))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    add(parts[1], 1)  # a replay
    micro_batch.compacted_panes(spark, str(tmp_path / "panes"), str(tmp_path / "whole"), ["kind"], "outlet")
    got, want = spark.read.parquet(str(tmp_path / "whole")).drop("day"), micro_batch.panes(events, "at", ["kind"], "outlet")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_requests_are_decided_as_they_come(spark, tmp_path):
    spark.conf.set(*micro_batch.STATE_STORE)
    rng = random.Random(3)
    portions = [[(rng.choice("abc"), NOW + timedelta(seconds=rng.randrange(60 * k, 60 * k + 400))) for _ in range(150)] for k in range(4)]
    portions += [[("a", NOW + timedelta(hours=6))], [("a", NOW + timedelta(seconds=5)), ("b", NOW + timedelta(hours=6, seconds=1))]]
    for k, rows in enumerate(portions):
        spark.createDataFrame(rows, "user string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema("user string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = micro_batch.decided(stream, "user", "ts", limit=10)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    in_time = spark.createDataFrame([r for rows in portions for r in rows if r != ("a", NOW + timedelta(seconds=5))], "user string, ts timestamp")
    want = {(r["window_start"], r["user"]): (r["requests"], r["over"]) for r in micro_batch.limited(in_time, "user", "ts", limit=10).collect()}
    found = got.where("not late").groupBy("window_start", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("limited").alias("over")).collect()
    assert {(r["window_start"], r["source"]): (r["n"], r["over"]) for r in found} == want and any(over for _, over in want.values())
    assert got.where("late and at > '2026-09-01'").count() == 0 and got.where("not late and (remaining < 0 or retry_after_seconds not between 1 and 60)").count() == 0
    state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "counts").load()
    assert state.count() == 2  # windows of hours ago are gone


def test_scripts_and_approved_inputs(spark, tmp_path):
    seed = "PRAGMA foreign_keys = ON;\n-- run: batch:2\nINSERT INTO t (a) VALUES (1);\n"
    out = sinks.refreshed_script(seed, ["batch:1", "batch:0"])
    assert out.endswith("DELETE FROM pipeline_runs WHERE run_id = 'batch:0';\nDELETE FROM pipeline_runs WHERE run_id = 'batch:1';\n") and out.startswith(seed.rstrip())
    for bad, retired in ((seed.replace("PRAGMA", "--"), ["batch:1"]), (seed, ["batch:2"]), (seed, []), (seed, ["x; y"]), ("PRAGMA foreign_keys = ON;", ["batch:1"])):
        with pytest.raises(ValueError):
            sinks.refreshed_script(bad, retired)
    (tmp_path / "in.json").write_bytes(b"{}")
    assert sinks.pinned(spark, str(tmp_path / "in.json"), hashlib.sha256(b"{}").hexdigest().upper()) == b"{}"
    with pytest.raises(ValueError):
        sinks.pinned(spark, str(tmp_path / "in.json"), "0" * 64)
    rows = spark.createDataFrame([(1, "it's", 0.5, None, True)], "a int, b string, c double, d double, e boolean")
    assert [r["value"] for r in sinks.sql_script(rows, "t", "batch:2", ["a"]).collect()][1] == "INSERT INTO t (a, b, c, d, e) VALUES (1, 'it''s', 0.5, NULL, 1);"
    for value in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="isn't finite"):
            sinks.sql_script(spark.createDataFrame([(1, value)], "a int, c double"), "t", "batch:2", ["a"]).collect()


def test_run_record(spark):
    clusters = spark.createDataFrame([("c2",), ("c1",)], "cluster_id string")
    tables = {"story_clusters": clusters, "articles": spark.range(5), "regional_prominence": spark.range(0)}
    record = lambda df: snapshot.run_record(spark, "batch:1", "20260827060000", {"events": "a", "mentions": "b"}, df, tables, F.lit(NOW), F.lit(NOW), {"events": 3, "mentions": 4})
    row = record(clusters).first()
    assert (row["records_seen"], row["records_upserted"], row["status"], str(row["source_watermark_at"])) == (7, 7, "succeeded", "2026-08-27 06:00:00")
    assert row["input_fingerprint"].startswith("20260827060000:snapshot_") and row["input_fingerprint"] == record(clusters.orderBy("cluster_id")).first()["input_fingerprint"] != record(clusters.limit(1)).first()["input_fingerprint"]
    assert sinks.upserted_runs(spark.createDataFrame([], schemas.RUNS), record(clusters)).first()["outcome"] == "inserted"
