import itertools
import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coverscope.operators import clustering, components, enrich, gates, geocode, merge, prominence, receipts, registry, serving, signals, validate
from coverscope.operators.components import connected_components
from coverscope.runtime import counted_so_far
from coverscope.schemas import Limits

T0 = datetime(2026, 8, 27, 1)


def test_gates_and_counters(spark):
    events = spark.createDataFrame([("e", 0, "old"), ("e", 1, "x"), ("n", 2, None)], "event_id string, ord int, geo string")
    rows = [("e", "u1", 1, True, 92.0, T0, 0), ("e", "u1", 1, True, 92.0, T0 + timedelta(hours=1), 1), ("e", "u2", 1, True, 80.0, T0, 2), ("e", "u3", 2, True, 99.0, T0, 3), ("e", "u4", 1, False, 99.0, T0, 4), ("e", "u5", 1, True, 79.0, T0, 5), ("n", "u6", 1, True, 99.0, T0, 6)]
    mentions = spark.createDataFrame(rows, "event_id string, identifier string, mention_type int, in_raw_text boolean, confidence double, mention_time timestamp, ord int")
    eligible = gates.eligible_mentions(mentions, events)
    assert {(r["identifier"], r["ord"], r["key_ord"]) for r in eligible.collect()} == {("u1", 1, 0), ("u2", 2, 2)}
    documents = spark.createDataFrame([("u1", "title")], "document_id string, title string")
    assert tuple(gates.gate_counters(gates.joined_documents(eligible, documents)).first()) == (2, 1, 1, 0)


def test_documents_fold_in_order(spark):
    rows = [("d", 0, T0, None), ("d", 1, T0, "a"), ("d", 2, T0 + timedelta(hours=1), None), ("x", 0, T0, "k"), ("x", 1, T0, "later, but not newer")]
    got = gates.folded_documents(spark.createDataFrame(rows, "document_id string, ord int, published_at timestamp, title string")).collect()
    assert {(r["document_id"], r["title"]) for r in got} == {("d", None), ("x", "k")}


def test_prominence_counts_an_outlet_once(spark):
    articles = spark.createDataFrame([("a", "big")] * 3 + [("b", "small")], "cluster_id string, outlet_id string")
    regions = spark.createDataFrame([("a", "JP"), ("b", "JP"), ("a", "JP")], "cluster_id string, region string")
    got = {r["cluster_id"]: r for r in prominence.regional_prominence(articles, regions).collect()}
    assert (got["a"]["article_share"], got["a"]["source_normalized_share"], got["b"]["source_normalized_share"]) == (0.75, 0.5, 0.5)
    assert prominence.regional_prominence(articles, regions.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_merge_needs_more_than_a_title(spark):
    clusters = spark.createDataFrame([("c1", "Quake  hits!"), ("c2", "quake hits"), ("c3", "Quake hits"), ("c4", "Quake hits"), ("c5", "Other")], "cluster_id string, title string")
    articles = spark.createDataFrame([("c1", "u1"), ("c2", "u2"), ("c3", "u2"), ("c4", "u4"), ("c5", "u1")], "cluster_id string, canonical_url string")
    places = spark.createDataFrame([("c1", "p"), ("c2", "p"), ("c3", "q"), ("c4", "r"), ("c5", "p")], "cluster_id string, location_key string")
    got = dict(tuple(r) for r in merge.merged_ids(clusters, articles, places).collect())
    assert got == {"c1": "c1", "c2": "c1", "c3": "c1", "c4": "c4", "c5": "c5"}


def test_merge_links_places_not_clusters(spark, monkeypatch):
    clusters = spark.createDataFrame([(f"c{i:03}", "Quake hits") for i in range(200)], "cluster_id string, title string")
    articles = spark.createDataFrame([(f"c{i:03}", f"u{i // 2}") for i in range(200)], "cluster_id string, canonical_url string")
    places = spark.createDataFrame([(f"c{i:03}", f"p{i % 2}") for i in range(200)], "cluster_id string, location_key string")
    links = []

    def counted(edges, local=0):
        links.append(edges.distinct().count())
        return connected_components(edges, local)

    monkeypatch.setattr(merge, "connected_components", counted)
    assert {r["merged_id"] for r in merge.merged_ids(clusters, articles, places).collect()} == {"c000"}
    assert links == [1]  # of two places that share documents, not of 200 clusters


def test_merge_is_as_every_link_has_it(spark):
    rng = random.Random(5)
    titles = {i: f"T{rng.randrange(6)}" for i in range(150)}
    placed = [(i, f"p{rng.randrange(60)}") for i in range(150) for _ in range(rng.choice((0, 1, 1, 2)))]
    written = [(i, f"u{rng.randrange(150)}") for i in range(150) for _ in range(rng.choice((0, 1, 2)))]
    above = {i: i for i in range(150)}

    def top(x):
        return x if above[x] == x else top(above[x])

    for kind in (placed, written):
        first = {}
        for i, k in kind:
            a, b = sorted((top(i), top(first.setdefault((titles[i], k), i))))
            above[b] = a
    clusters = spark.createDataFrame(list(titles.items()), "cluster_id long, title string")
    got = merge.merged_ids(clusters, spark.createDataFrame(written, "cluster_id long, canonical_url string"), spark.createDataFrame(placed, "cluster_id long, location_key string"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, top(i)) for i in range(150)]


def article(i, title, minutes, outlet="o"):
    at = T0 + timedelta(minutes=minutes)
    return (i, f"https://{outlet}.example/{i}", f"https://{outlet}.example/{i}", title, None, outlet, f"{outlet}.example", outlet, "en", at, at, "news", i, 0.9)


def articles_of(spark, rows):
    from coverscope import schemas

    return spark.createDataFrame(rows, schemas.ARTICLES)


def test_clustering_joins_like_titles_whatever_their_order(spark):
    rows = [article("t1", "Tokyo quake shakes city towers", 0, "a"), article("t2", "Quake shakes Tokyo city towers", 25, "b"), article("p1", "Paris museum opens hall", 5, "a"), article("p2", "Paris museum opens large hall", 9, "c")]
    one = clustering.clusters_of(articles_of(spark, rows)).collect()
    two = clustering.clusters_of(articles_of(spark, rows[::-1])).collect()
    groups = lambda x: {frozenset(r["article_id"] for r in x if r["cluster_id"] == c) for c in {r["cluster_id"] for r in x}}
    assert groups(one) == {frozenset({"t1", "t2"}), frozenset({"p1", "p2"})}
    assert {r["cluster_id"] for r in one} == {r["cluster_id"] for r in two}


def test_scored_pairs_take_every_copy_of_a_title(spark):
    day = 24 * 60
    rows = [article("a1", "quake shakes city towers", 0), article("a2", "city towers: quake shakes", 20 * day), article("b1", "quake shakes city bridges", 20 * day + 5)]
    got = {(r["a"], r["b"]) for r in clustering.scored_pairs(articles_of(spark, rows)).collect()}
    assert got == {("a1", "a2"), ("a2", "b1")}


def test_candidate_pairs_lose_none(spark):
    import itertools
    import random

    random.seed(3)
    sets = {i: sorted(random.sample("abcdefghij", random.randint(1, 6))) for i in range(60)}
    pairs = {tuple(r) for r in clustering.candidate_pairs(spark.createDataFrame(list(sets.items()), "k int, t array<string>"), "k", "t", 0.5).collect()}
    first = {}
    for i, t in sets.items():
        first.setdefault(tuple(t), i)
    for a, b in itertools.combinations(sorted(first.values()), 2):
        x, y = set(sets[a]), set(sets[b])
        if len(x & y) / len(x | y) >= 0.5:
            assert (a, b) in pairs


def test_geocoding(spark):
    aliases = spark.createDataFrame([("tokyo", "tyo", "city"), ("paris", "par", "city"), ("paris", "ptx", "city"), ("new york", "nyc", "city")], "alias string, place_id string, kind string")
    texts = spark.createDataFrame([("a1", "o1", "u", "title", "Quake in Tokyo."), ("a2", "o2", "u", "title", "TOKYO and Paris"), ("a3", "o2", "u", "summary", "In New York")], "article_id string, outlet_id string, url string, field string, text string")
    matches = geocode.located_matches(geocode.gazetteer_matches(texts, aliases))
    got = {r["place_id"]: round(r["confidence"], 2) for r in geocode.event_locations(geocode.place_evidence(matches)).collect()}
    assert got == {"tyo": 0.94, "par": 0.76, "ptx": 0.76, "nyc": 0.68}
    there = matches.drop("quote", "confidence").join(texts.select("article_id", "text"), "article_id")
    assert {(r["article_id"], r["quote"]) for r in geocode.located_matches(there).collect()} == {(r["article_id"], r["quote"]) for r in matches.collect()}
    assert geocode.located_matches(there.withColumn("start", F.col("start") + 1)).count() == 0


def plain_matches(text, aliases, longest):
    """Every run of words, compared with every alias."""
    import regex

    places = [m.span() for m in regex.finditer(r"[\p{L}\p{N}\p{M}'’.-]*[\p{L}\p{N}\p{M}]", text or "")]
    for i, (a, _) in enumerate(places):
        for _, b in places[i : i + longest]:
            if " ".join(text[a:b].lower().split()) in aliases:
                yield a, b, text[a:b]


@pytest.mark.parametrize("sent", [250_000, 3])
def test_a_trie_finds_every_run_that_is_an_alias(spark, monkeypatch, sent):
    monkeypatch.setattr(geocode, "SENT_ALIASES", sent)
    rng = random.Random(4)
    words = ["new", "york", "st.", "john's", "los", "ångström", "北京", "x-ray", "o’hara", "7"]
    aliases = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"new, york", "york -", "", " new", "los\tnew"}
    texts = [("", None), ("t1", "")] + [(f"x{i}", "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", "  ", "\n", ", ", ". ", " - ", "—"]) for w in rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)]
    texts.append(("long", "new york los " * 7000))
    rows = spark.createDataFrame([(i, t, 1.5) for i, t in texts], "article_id string, text string, more double").repartition(3)
    names = spark.createDataFrame([(a, f"p{k}") for k, a in enumerate(sorted(aliases))] + [("new york", "again")], "alias string, place_id string")
    for longest in (1, 4):
        got = geocode.gazetteer_matches(rows, names, longest)
        assert got.columns == ["article_id", "more", "start", "end", "matched_text", "quote", "place_id", "ambiguity"]
        once = got.dropDuplicates(["article_id", "start", "end"]).collect()
        assert sorted((r["article_id"], r["start"], r["end"], r["matched_text"]) for r in once) == sorted((i, *m) for i, t in texts for m in plain_matches(t, aliases | {"new york"}, longest))
    quoted = {(r["article_id"], r["start"]): r["quote"] for r in once if r["article_id"] == "long"}
    whole = texts[-1][1]
    end = next(r["end"] for r in once if (r["article_id"], r["start"]) == ("long", 1300))
    assert end and quoted["long", 1300].startswith("…") and quoted["long", 1300].endswith("…") and quoted["long", 1300][1:-1] in whole


def test_conflict_needs_two_networks(spark):
    rows = [("c", "k1", "x", "supports", 0.9, "n1"), ("c", "k2", "x", "disputes", 0.8, "n2"), ("c", "k3", "x", "disputes", 0.95, "n1"), ("d", "k4", "x", "supports", 0.9, "n1"), ("d", "k5", "x", "disputes", 0.9, "n1"), ("e", "k6", "x", "supports", 0.7, "n1"), ("e", "k7", "y", "disputes", 0.6, "n2")]
    got = {r["cluster_id"]: (r["status"], r["confidence"], r["dispute_claim"]) for r in signals.conflicts(spark.createDataFrame(rows, "cluster_id string, claim_id string, normalized_claim string, stance string, confidence double, network string")).collect()}
    assert got == {"c": ("detected", 0.8, "k2"), "d": ("not_assessed", None, None), "e": ("not_detected", 0.6, None)}


def test_market_heat_shares(spark):
    rows = [("a1", "o1", "M1", "one", 1.0, 2.0, 0.9), ("a1", "o1", "M2", "two", None, None, 0.8), ("a2", "o1", "M2", "two", 3.0, 4.0, 0.9), ("a3", "o2", "M1", "one", 5.0, 6.0, 0.95)]
    sources = spark.createDataFrame(rows, "article_id string, domain string, market string, label string, latitude double, longitude double, confidence double")
    got = {r["market"]: (r["source_normalized_share"], r["latitude"]) for r in signals.market_heat(sources).collect()}
    assert got == {"M1": (0.75, 5.0), "M2": (0.25, 3.0)}


def test_list_stories_by_evidenced_region(spark):
    clusters = spark.createDataFrame([("a", 3, T0, T0), ("b", 5, T0, T0)], "cluster_id string, raw_article_count int, first_observed_at timestamp, last_observed_at timestamp")
    places = spark.createDataFrame([("a", "l1", "event", "IN", 0.9, 1), ("a", "l2", "event", "CH", 0.9, 3), ("b", "l3", "event", "US", 0.5, 1)], "cluster_id string, location_id string, location_type string, region_code string, confidence double, evidence_count int")
    evidence = spark.createDataFrame([("l1",), ("l2",)], "location_id string")
    got = serving.list_stories(clusters, places, serving.StoryQuery(region="IN"), evidence).collect()
    assert [(r["cluster_id"], r["primary_location_id"]) for r in got] == [("a", "l2")]
    assert serving.list_stories(clusters, places, serving.StoryQuery(region="US"), evidence).count() == 0
    with pytest.raises(ValueError):
        serving.StoryQuery(limit=101)


def test_validation(spark):
    clusters = spark.createDataFrame([("a", "", T0, T0 - timedelta(hours=1)), ("b", "t", T0, T0)], "cluster_id string, title string, first_observed_at timestamp, last_observed_at timestamp")
    articles = spark.createDataFrame([("a", "x", "http://h.example/1", "http://h.example/1", T0), ("a", "x", "ftp://h", "http://h.example/2", T0)], "cluster_id string, article_id string, url string, canonical_url string, retrieved_at timestamp")
    memberships = spark.createDataFrame([("a", "y", 1.5)], "cluster_id string, article_id string, confidence double")
    got = sorted((r["cluster_id"], r["code"]) for r in validate.cluster_issues(clusters, articles, memberships).collect())
    assert got == sorted([("a", "missing_title"), ("a", "inverted_observation_window"), ("b", "empty_cluster"), ("a", "duplicate_article_id"), ("a", "invalid_url"), ("a", "missing_membership"), ("a", "unknown_membership_article"), ("a", "invalid_confidence")])
    with pytest.raises(ValueError):
        validate.assert_none(validate.cluster_issues(clusters, articles, memberships))


def test_assessments(spark):
    schema = "cluster_id string, a struct<status:string,value:string,confidence:double,method:string,reason:string,evidence:array<struct<kind:string>>>"
    rows = [("ok", ("unknown", None, None, "unavailable", "none", [])), ("bad", ("unknown", "x", 0.5, "guess", None, [("k",)])), ("seen", ("observed", "neutral", 0.5, "model_analysis", None, [("k",)])), ("odd", ("observed", "wild", 2.0, "x", "r", []))]
    got = validate.issues_of(spark.createDataFrame(rows, schema), validate.assessment_rules("tone", F.col("a"), True)).groupBy("cluster_id").count()
    assert {tuple(r) for r in got.collect()} == {("bad", 5), ("odd", 5)}


def test_registry_keeps_origin_and_market_apart(spark):
    articles = spark.createDataFrame([("www.AlbuquerqueExpress.com",), ("other.example",)], "domain string")
    got = registry.with_profile(articles, registry.registry(spark)).select("domain", registry.same_story_context().alias("s")).collect()
    known, other = (next(r["s"] for r in got if r["domain"] == d) for d in ("www.AlbuquerqueExpress.com", "other.example"))
    assert (known["publisher_origin"]["value"], known["editorial_market"]["value"]) == ("AU", "US-NM-ABQ")
    assert other["editorial_market"]["status"] == "unknown" and other["publisher_origin"]["value"] is None


def test_independent_pairs(spark):
    text = lambda seed: " ".join(f"{seed}word{i}" for i in range(120))
    rows = [("c", 1, "u1", "one.example", "Alpha beta", text("a")), ("c", 2, "u2", "two.example", "Alpha beta", text("b")), ("c", 3, "u3", "three.example", "Gamma delta", text("a")), ("c", 4, "u4", "four.example", "Omega", text("d")), ("k", 1, "u5", "five.example", "X", text("e"))]
    candidates = spark.createDataFrame(rows, "cluster_id string, rank int, canonical_url string, domain string, title string, raw_content string")
    existing = spark.createDataFrame([("c", "zero.example")], "cluster_id string, network string")
    assert [r["canonical_url"] for r in enrich.independent_pairs(candidates, existing).orderBy("position").collect()] == ["u1", "u4"]


def test_target_cluster(spark):
    searches = spark.createDataFrame([("s", "quake tokyo towers"), ("s", "Towers: Tokyo quake"), ("s", "quake Tokyo towers"), ("n", "nothing alike")] + [("m", "Tokyo")] * 9, "search_id string, text string")
    clusters = spark.createDataFrame([("c1", "Tokyo quake shakes towers", 0), ("c2", "Paris museum", 1)], "cluster_id string, title string, ord int")
    assert [(r["search_id"], r["cluster_id"]) for r in enrich.target_clusters(searches, clusters).collect()] == [("s", "c1")]


def test_limits():
    assert Limits().resolve(clusters=500).clusters == 500
    with pytest.raises(ValueError):
        Limits().resolve(clusters=501)


def test_curation_goes_by_cluster_then_title_then_url(spark):
    stories = spark.createDataFrame([("c1", "Quake"), ("c2", "Flood")], "cluster_id string, title string")
    searches = spark.createDataFrame([("Quake", "https://a.example/1?utm_source=x"), ("Quake", "https://b.example/2"), ("Flood", "https://c.example/3"), ("Other", "https://d.example/4")], "query string, url string")
    contents = spark.createDataFrame([("https://a.example/1", "x"), ("https://c.example/3", "y"), ("https://d.example/4", "z")], "url string, raw_content string")
    kept = enrich.curated(stories, searches, contents, ["c1"])
    assert [sorted(r[0] for r in x.collect()) for x in kept] == [["c1"], ["Quake", "Quake"], ["https://a.example/1"]]
    with pytest.raises(ValueError, match="c9"):
        enrich.curated(stories, searches, contents, ["c1", "c9"])


def test_approved_clusters_need_three_articles(spark):
    clusters = spark.createDataFrame([("a",), ("b",)], "cluster_id string")
    articles = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "cluster_id string")
    enrich.require_approved(clusters, articles, ["a"])
    for wanted in (["a", "b"], ["z"]):
        with pytest.raises(ValueError, match=wanted[-1]):
            enrich.require_approved(clusters, articles, wanted)


def test_url_batches_are_full(spark):
    urls = spark.createDataFrame([(f"https://h.example/{i % 107}",) for i in range(200)], "url string")
    sizes = sorted((r["batch"], r["count"]) for r in enrich.url_batches(urls, 20).groupBy("batch").count().collect())
    assert sizes == [(i, 20) for i in range(5)] + [(5, 7)]


def test_stances_points_and_shown_health(spark):
    claims = spark.createDataFrame([("asserts",), ("denies",), (None,)], "polarity string")
    assert [r["stance"] for r in signals.with_stance(claims).collect()] == ["supports", "disputes", "unclear"]
    markets = spark.createDataFrame([("M1", 1.0, 2.0), ("M2", 3.0, 4.0), ("M3", None, None)], "market string, latitude double, longitude double")
    assert [r["market"] for r in signals.heat_points(markets, spark.createDataFrame([("M1", 1.0, 2.0), ("M2", 9.0, 9.0)], markets.schema)).collect()] == ["M1"]
    row = spark.createDataFrame([("degraded", T0, 9, 2, ["latest story is stale"])], "status string, latest_story_at timestamp, freshness_age_seconds long, active_source_count int, reasons array<string>")
    got = serving.shown_health(row, F.lit(4), F.lit(2), F.lit(0)).first()
    assert (got["status"], got["message"]) == ("degraded", "latest story is stale; 2 cluster(s) omitted without cited event locations")
    assert validate.snapshot_issues("2", ["events"], 1, 2) == [("invalid_snapshot_version", "schema_version"), ("missing_source_files", "source.files"), ("invalid_cluster_count", "statistics.clusters_emitted")]


def test_legacy_prominence_is_left_out(spark):
    rows = spark.createDataFrame([("a", "v2"), ("b", "v1-legacy-components-unavailable"), ("c", None)], "cluster_id string, formula_version string")
    assert sorted(r["cluster_id"] for r in prominence.current_formula(rows).collect()) == ["a", "c"]


def plain_clusters(rows, threshold=0.5):
    """The greedy order over all articles, each compared with every member of every group. rows: (id, at in hours or None, tokens, names, places)."""
    from coverscope.functions.numbers import WEIGHTS as w

    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0

    def score(x, y):
        parts = [(share(x[2], y[2]), w["title"])]
        parts += [(share(x[3], y[3]), w["entities"])] if x[3] and y[3] else []
        parts += [(math.exp(-abs(x[1] - y[1]) / 36), w["time"])] if x[1] is not None and y[1] is not None else []
        parts += [(share(x[4], y[4]), w["location"])] if x[4] and y[4] else []
        return sum(s * v for s, v in parts) / sum(v for _, v in parts)

    groups, out = [], {}
    for row in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        best = None
        for g, group in enumerate(groups):
            scores = [round(score(row, x), 12) for x in group]
            if max(scores) >= threshold and round(sum(scores) / len(scores), 11) >= threshold - 0.08 and (best is None or max(scores) > best[1]):
                best = (g, max(scores), group[scores.index(max(scores))][0])
        if best is None:
            groups.append([row])
            best = (len(groups) - 1, 1.0, None)
        else:
            groups[best[0]].append(row)
        out[row[0]] = best
    canonical = set()
    for group in groups:
        means = [round(sum(score(x, y) for y in group if y is not x) / max(1, len(group) - 1), 11) for x in group]
        canonical.add(group[means.index(max(means))][0])
    return {i: (groups[g][0][0], round(c, 6), m, i in canonical) for i, (g, c, m) in out.items()}


def test_greedy_clusters_are_as_one_after_another(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(14)]
    rows = []
    for i in range(160):
        title = rng.choice(rows)[1] if rows and rng.random() < 0.4 else " ".join(rng.sample(words, rng.randint(2, 5))) + rng.choice(["", " Anna Berg", " Ben"])
        hours = rng.choice([0, 3, 30, 90, 400, 2000]) + rng.randrange(3)
        rows.append((f"a{i:03}", title, hours, rng.choice([[], [], ["p1"], ["p1", "p2"]])))
    at = lambda h: T0 + timedelta(hours=h)
    df = spark.createDataFrame([(i, f"https://h.example/{i}", t, at(h), at(h), p) for i, t, h, p in rows], "article_id string, canonical_url string, title string, published_at timestamp, retrieved_at timestamp, location_ids array<string>")
    got = clustering.clusters_of(df).collect()
    tokens = lambda t: frozenset(w for w in t.lower().split())
    names = lambda t: frozenset([x] if (x := " ".join(w.lower() for w in t.split() if w[0].isupper())) else [])
    want = plain_clusters([(i, h, tokens(t), names(t), frozenset(p)) for i, t, h, p in rows])
    first = {r["cluster_id"]: r["article_id"] for r in got if r["position"] == 0}
    assert {r["article_id"]: (first[r["cluster_id"]], round(r["confidence"], 6), r["matched_article_id"], r["is_canonical"]) for r in got} == want
    assert 10 < len(first) < 120


def test_stored_contexts_are_parsed_or_refused(spark):
    import json

    plain = {"status": "unknown", "value": None, "confidence": None, "method": "unavailable", "evidence": [], "reason": "none"}
    item = {"kind": "outlet_market_documentation", "url": "https://h.example", "quote": "q"}
    market = {"status": "observed", "value": {"regionCode": "R", "label": "L", "coordinates": {"latitude": 1, "longitude": 2}}, "confidence": 0.9, "method": "documented_outlet_market", "evidence": [item], "reason": None}
    whole = {"publisherOrigin": plain, "framing": plain, "tone": plain}
    cases = {
        "ok": {**whole, "editorialMarket": market}, "older": whole, "unknown": {**whole, "editorialMarket": plain},
        "invalid_json": "{", "not_an_object": [1], "invalid_tone": {**whole, "tone": {"status": "odd"}},
        "invalid_editorialMarket": {**whole, "editorialMarket": {**market, "confidence": 2}}, "inconsistent_editorialMarket": {**whole, "editorialMarket": {**market, "method": "language_and_publisher_location"}},
    }
    rows = [(k, v if isinstance(v, str) else json.dumps(v), "FR") for k, v in cases.items()] + [("null", None, "FR"), ("none", json.dumps({**whole, "editorialMarket": None}), "FR")]
    own = registry.parsed_articles(spark.createDataFrame(rows, "article_id string, same_story_json string, audience_region_code string"))
    assert own.columns == ["article_id", "same_story_error", "same_story"]
    got = {r["article_id"]: r for r in own.collect()}
    assert {k: r["same_story_error"] for k, r in got.items()} == {k: None if k in ("ok", "older", "unknown") else k for k in cases} | {"null": "invalid_json", "none": "invalid_editorialMarket"}
    assert got["ok"]["same_story"]["editorialMarket"]["value"]["regionCode"] == "R" and got["older"]["same_story"]["editorialMarket"]["reason"] == registry.LEGACY_REASON and got["not_an_object"]["same_story"] is None


def test_enrichment_takes_independent_results_and_says_why_not(spark):
    clusters = spark.createDataFrame([("c", "Tokyo quake shakes towers", 0)], "cluster_id string, title string, ord int")
    articles = spark.createDataFrame([("c", "a0", "Tokyo quake shakes towers", None, T0, 0, "https://zero.example/0", "zero.example")], "cluster_id string, article_id string, title string, summary string, at timestamp, ord int, canonical_url string, domain string")
    searches = spark.createDataFrame([("s", "Tokyo quake shakes towers"), ("n", "Parrots of Lima")], "search_id string, query string")
    title = "Quake shakes Tokyo towers again"
    found = [("s", "r1", "https://one.example/1", title, 0.9), ("s", "r2", "https://one.example/2", title, 0.8), ("s", "r3", "https://zero.example/0", title, 0.85), ("s", "r4", "https://two.example/4", title, 0.3), ("s", "r5", "nothing", title, 0.9),
             ("s", "r6", "https://six.example/6", title, 0.9), ("s", "r7", "https://seven.example/7", "Parrots", 0.7), ("n", "r8", "https://eight.example/8", "Parrots of Lima", 0.9)]
    results = spark.createDataFrame([(s, i, u, t, None, x, T0) for s, i, u, t, x in found], "search_id string, article_id string, url string, title string, summary string, score double, at timestamp")
    contents = spark.createDataFrame([(u, "x" * 600) for _, i, u, _, _ in found if i != "r6"], "url string, raw_content string")
    accepted, rejected = enrich.enriched(searches, results, clusters, articles, contents)
    assert [(r["article_id"], r["matched_article_id"]) for r in accepted.collect()] == [("r1", "a0")]
    R = enrich.REASONS
    assert {r["article_id"]: r["reason"] for r in rejected.collect()} == {"r2": R[5], "r3": R[4], "r4": R[1], "r5": R[2], "r6": R[3], "r7": R[6], "r8": R[0]}


def plain_enriched(searches, results, clusters, articles, contents, per_search, total):
    """One search after another, one result after another."""
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    words = lambda t: frozenset(w for w in t.lower().split() if len(w) > 1)
    names = lambda t: frozenset([x] if (x := " ".join(w.lower() for w in t.split() if w[0].isupper())) else [])
    have = {c: [(a, t, h, u, d) for k, a, t, h, u, d in articles if k == c] for c, _ in clusters}
    accepted, rejected, R = [], [], enrich.REASONS
    for search, query in searches:
        own = sorted((r for r in results if r[0] == search), key=lambda r: (r[4] is None, -(r[4] or 0), r[2], r[1]))
        score = lambda t: max(share(words(t), words(x)) for x in [query, *(r[3] for r in own)])
        best = max(clusters, key=lambda c: score(c[1]), default=None)
        cluster = best[0] if best and score(best[1]) >= 0.3 else None
        overlap, given = share(words(query), words(best[1])) if cluster else 0.0, 0
        for _, article, url, title, sure, hours in own:
            if len(accepted) >= total:
                rejected.append((article, enrich.ALL_FULL))
                continue
            if cluster is not None and given >= per_search:
                rejected.append((article, enrich.SEARCH_FULL))
                continue
            domain = url.split("/")[2]
            scores = [(share(words(title), words(t)) * 0.45 + share(names(title), names(t)) * (0.35 if names(title) and names(t) else 0) + math.exp(-abs(hours - h) / 36) * 0.2, t, h) for _, t, h, _, _ in have.get(cluster, [])]
            top = max(scores, key=lambda x: x[0], default=None)
            if cluster is None:
                reason = R[0]
            elif sure is None or sure < 0.4:
                reason = R[1]
            elif url not in contents:
                reason = R[3]
            elif url in {u for *_, u, _ in have[cluster]}:
                reason = R[4]
            elif domain in {d for *_, d in have[cluster]}:
                reason = R[5]
            else:
                t, e = share(words(title), words(top[1])), share(names(title), names(top[1])) if names(title) and names(top[1]) else 0.0
                time = math.exp(-abs(hours - top[2]) / 36)
                good = sure >= 0.5 and overlap >= 0.35 and time >= 0.35 and (t >= 0.08 or e >= 0.1) and top[0] * 0.45 + overlap * 0.3 + sure * 0.25 >= 0.35
                reason = None if good else R[6]
            if reason is None:
                accepted.append((cluster, article))
                have[cluster].append((article, title, hours, url, domain))
                given += 1
            else:
                rejected.append((article, reason))
    return accepted, rejected


@pytest.mark.parametrize("per_search,total", [(3, 6), (1, 1000), (2, 17), (100, 0)])
def test_enrichment_is_as_one_result_after_another(spark, per_search, total):
    rng = random.Random(11)
    topics = [[f"{t}{w}" for w in ("quake", "flood", "mayor", "train", "court", "river")] for t in "abcdef"]
    title = lambda t: " ".join(rng.sample(t, rng.randint(3, 6))) + rng.choice(["", " Anna", " Ben"])
    clusters = [(f"c{i}", title(t)) for i, t in enumerate(topics)]
    articles = [(f"c{i}", f"o{i}{k}", title(t), rng.randrange(50), f"https://old{k}.example/{i}", f"old{k}.example") for i, t in enumerate(topics) for k in range(2)]
    searches = [(f"s{i:02}", clusters[i % 6][1] if i % 5 else "nothing of the kind") for i in range(14)]
    results = [(s, f"r{i}{k}", f"https://{rng.choice(['old0', 'old1', 'n1', 'n2', 'n3', 'n4'])}.example/{rng.randrange(60)}", title(topics[i % 6]) if i % 5 else "other things", rng.choice([None, 0.3, 0.45, 0.6, 0.8, 0.9]), rng.randrange(60)) for i, (s, _) in enumerate(searches) for k in range(12)]
    contents = {r[2] for r in results if rng.random() < 0.8}
    at = lambda h: T0 + timedelta(hours=h)
    frames = [
        spark.createDataFrame([(s, q, i) for i, (s, q) in enumerate(searches)], "search_id string, query string, ord int"),
        spark.createDataFrame([(s, a, u, t, None, x, at(h)) for s, a, u, t, x, h in results], "search_id string, article_id string, url string, title string, summary string, score double, at timestamp"),
        spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(clusters)], "cluster_id string, title string, ord int"),
        spark.createDataFrame([(c, a, t, None, at(h), i, u, d) for i, (c, a, t, h, u, d) in enumerate(articles)], "cluster_id string, article_id string, title string, summary string, at timestamp, ord int, canonical_url string, domain string"),
        spark.createDataFrame([(u, "x" * 600) for u in contents], "url string, raw_content string"),
    ]
    accepted, rejected = enrich.enriched(*frames, per_search, total)
    want = plain_enriched(searches, results, clusters, articles, contents, per_search, total)
    assert [(r["cluster_id"], r["article_id"]) for r in accepted.orderBy("position").collect()] == want[0]
    assert sorted((r["article_id"], r["reason"]) for r in rejected.collect()) == sorted(want[1])
    assert len(want[0]) + len(want[1]) == len(results)


def test_prefix_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(500), i, rng.random() < 0.3) for i in range(3000)]
    got = counted_so_far(spark.createDataFrame(rows, "a int, b int, c boolean"), [F.col("a").desc(), F.col("b").asc()], F.col("c"), "n")
    n, want = 0, []
    for a, b, c in sorted(rows, key=lambda r: (-r[0], r[1])):
        n += c
        want.append((a, b, c, n))
    assert sorted(map(tuple, got.select("a", "b", "c", "n").collect())) == sorted(want)
    assert counted_so_far(got.where("false").drop("n"), [F.col("a")], F.col("c"), "n").count() == 0


def test_components_in_one_task_are_those_of_rounds(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame([(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(200)], "u string, v string")
    assert sorted(connected_components(edges, 1000).collect()) == sorted(connected_components(edges).collect())
    assert connected_components(edges.where("false"), 10).count() == 0


def test_constraints_of_stored_tables(spark):
    from coverscope.operators import constraints

    rules = {
        "parents": constraints.Table(("id",), ("name",), {"size": constraints.at_least("size", 0)}),
        "children": constraints.Table(("a", "b"), ("missing",), {"kind": constraints.one_of("kind", "x")}, (("kind", "size"),), {"parent": ("parents", "id"), "other": ("elsewhere", "id")}),
    }
    parents = spark.createDataFrame([(1, "n", 1), (1, None, -1), (None, "n", None), (2, "n", 3)], "id int, name string, size int")
    children = spark.createDataFrame([(1, 1, "x", 1, 1, 9), (1, 1, "y", 1, 3, 9), (1, 2, "x", 1, None, 9), (2, 2, None, None, 2, 9), (2, 3, None, None, 2, 9)], "a int, b int, kind string, size int, parent int, other int")
    got = sorted(map(tuple, constraints.violations({"parents": parents, "children": children}, rules).collect()))
    assert got == sorted(
        [("parents", "not null name", "1", 1), ("parents", "check size", "1", 1), ("parents", "not null id", "null", 1), ("parents", "unique id", "1", 1), ("children", "unique a,b", "1|1", 1), ("children", "unique kind,size", "x|1", 1), ("children", "check kind", "1|1", 1), ("children", "foreign key parent", "1|1", 1)]
        + [("children", "not null missing", k, 1) for k in ("1|1", "1|1", "1|2", "2|2", "2|3")]
    )
    # Every serving table's rules can be evaluated, whatever columns it has.
    assert constraints.violations({n: parents for n in constraints.SERVING}).count() > 0


def test_paths_of_nested_documents(spark):
    from coverscope.operators import constraints

    rows = spark.sql("select 's' as id, array(named_struct('v', 1, 'inner', array(named_struct('w', 1), null, named_struct('w', 5))), null, named_struct('v', 9, 'inner', null)) as outer union all select 'none', null")
    rules = {"outer[]": [("large", "v", lambda x: x["v"] > 5), ("null_item", "", lambda x: x.isNull())], "outer[].inner[]": [("large", "w", lambda x: x["w"] > 3)]}
    got = sorted(tuple(r) for r in constraints.nested_issues(rows, {"outer": F.col("outer")}, rules, ["id"]).collect())
    assert got == [("s", "large", "outer[0].inner[2].w"), ("s", "large", "outer[2].v"), ("s", "null_item", "outer[1]")]
    assert constraints.nested_issues(rows, {"outer": F.col("outer")}, {"outer[].inner[]": rules["outer[].inner[]"]}, ["id"]).count() == 1


def test_contexts_of_odd_shapes(spark):
    import json

    market = lambda c: json.dumps({"editorialMarket": {"status": "observed", "value": {"regionCode": "R", "coordinates": c}}})
    rows = [("none", None), ("text", '"x"'), ("list", "[1]"), ("broken", "{"), ("ok", market({"latitude": 1})), ("absent", "{}"), ("list_of", market([1, 2])), ("number", market(7)), ("unknown", json.dumps({"editorialMarket": {"status": "unknown", "value": {"coordinates": 1}}}))]
    got = sorted((r["cluster_id"], r["code"]) for r in validate.context_issues(spark.createDataFrame(rows, "cluster_id string, same_story_json string")).collect())
    assert got == sorted([("none", "missing_same_story_context"), ("text", "invalid_same_story_context"), ("list", "invalid_same_story_context"), ("broken", "invalid_same_story_context"), ("list_of", "invalid_coordinates"), ("number", "invalid_coordinates")])


def test_ties_go_in_collated_order(spark):
    from coverscope.functions import text as X

    words = ["b", "B", "á", "a", "A", "ab", "a-c", "a/b", "_a", "1", "Z", "é"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r["w"] for r in rows.orderBy(X.collated(F.col("w"))).collect()] == ["_a", "1", "a", "A", "á", "a-c", "a/b", "ab", "b", "B", "é", "Z"]
    ids = spark.createDataFrame([("c1", "m"), ("c2", "m")], "cluster_id string, merged_id string")
    articles = spark.createDataFrame([("c1", "x", "https://h.example/B", "o", 1.0, None), ("c2", "x", "https://h.example/a", "o", 1.0, None)], "cluster_id string, article_id string, canonical_url string, outlet_id string, provider_score double, published_at timestamp")
    assert merge.merged_articles(articles, ids).first()["canonical_url"] == "https://h.example/a"


def plain_collected(clusters, articles, results, contents, target):
    """One cluster after another, one result after another."""
    from coverscope.plans import collect as C

    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    stories, additions, rejected = [], [], []
    for cluster, title, _, _ in sorted(clusters, key=lambda c: (-c[3], -c[2], c[0])):
        domains, networks = {a[2] for a in articles if a[0] == cluster}, {a[2] for a in articles if a[0] == cluster}
        urls, taken, candidates = {a[1] for a in articles if a[0] == cluster}, [], 0
        own = []
        for _, url, said, score, hours in sorted((r for r in results if r[0] == cluster), key=lambda r: (r[3] is None, -(r[3] or 0), r[1])):
            domain, words = url.split("/")[2], said.split()
            text = contents.get(url)
            reason = None
            if score is None or score < 0.5:
                reason = C.LOW
            elif domain == "x.com":
                reason = C.NO_ARTICLE
            elif url in urls:
                reason = C.KNOWN_URL
            elif domain in domains:
                reason = C.KNOWN_DOMAIN
            elif share(title.split(), words) < 0.08:
                reason = C.UNLIKE
            elif abs(hours) > 38:
                reason = C.FAR
            elif candidates == 8:
                reason = C.FULL
            else:
                candidates += 1
                domains.add(domain)
                runs = [tuple(text.split()[i : i + 5]) for i in range(len(text.split()) - 4)] if text else []
                if text is None:
                    reason = C.NO_TEXT
                elif len(taken) == 2:
                    reason = C.ENOUGH
                elif domain in networks | {t[0] for t in taken}:
                    reason = C.KNOWN_NETWORK
                elif any(share(t[1], text.split()) > 0.72 for t in taken):
                    reason = C.SAME_WORDS
                elif any(share(t[2], runs) >= 0.12 for t in taken):
                    reason = C.SAME_RUNS
                elif any(share(t[3], words) > 0.6 for t in taken):
                    reason = C.SAME_TITLE
                else:
                    taken.append((domain, text.split(), runs, words, url))
            if reason:
                own.append((cluster, url, reason))
        good = len(taken) == 2 and len(stories) < target
        own += [] if good else [(cluster, t[4], C.TOO_FEW if len(taken) < 2 else C.NOT_NEEDED) for t in taken]
        rejected += own
        if good:
            additions += [(cluster, i, t[4]) for i, t in enumerate(taken)]
            stories.append(cluster)
    return stories, additions, rejected


@pytest.mark.parametrize("target", [4, 100, 0])
def test_collection_is_as_one_cluster_after_another(spark, target):
    from coverscope.plans import collect

    rng = random.Random(12)
    clusters = [(f"c{i:02}", " ".join(f"k{i}word{j}" for j in range(5)), rng.randint(1, 3), rng.choice([10, 20, 130])) for i in range(14)]
    articles = [(c, f"https://old{k}.example/{c}", f"old{k}.example") for c, *_ in clusters for k in range(2)]
    body = lambda seed: " ".join(f"body{seed}token{k}" for k in range(60))
    results, contents = [], {}
    for i, (c, title, *_) in enumerate(clusters):
        for k in range(25):
            url = f"https://{rng.choice(['old0', 'old1', 'x', *(f'n{q}' for q in range(12))])}.{'com' if rng.random() < 0.05 else 'example'}/{c}{k}"
            said = rng.choice([" ".join(rng.sample(title.split(), 2) + [f"own{k}", f"more{k}", f"yet{k}"]), title, "nothing of it"])
            results.append((c, url.replace("x.example", "x.com"), said, rng.choice([None, 0.3, 0.5, 0.7, 0.9]), rng.choice([0, 5, 20, 60])))
            if rng.random() < 0.8:
                contents[results[-1][1]] = rng.choice([body(f"{i}a"), body(f"{i}{k}b"), body(f"{i}{k}c"), body(f"{i}a") + f" with some more of {k} " + body(k)])
    results += [(clusters[0][0], articles[0][1], clusters[0][1], 0.9, 0)]
    at = lambda h: T0 + timedelta(hours=h)
    got = collect.collected(
        spark.createDataFrame([(c, t, n, p, at(0)) for c, t, n, p in clusters], "cluster_id string, title string, article_count int, priority int, last_observed_at timestamp"),
        spark.createDataFrame([(*a, None) for a in articles], "cluster_id string, canonical_url string, domain string, summary string"),
        spark.createDataFrame([(c, u, t, s, at(h)) for c, u, t, s, h in results], "cluster_id string, url string, title string, score double, published_at timestamp"),
        spark.createDataFrame(list(contents.items()), "url string, raw_content string"), target,
    )
    stories, additions, rejected = plain_collected(clusters, articles, results, contents, target)
    assert [r["cluster_id"] for r in got.stories.orderBy("position").collect()] == stories
    assert sorted((r["cluster_id"], r["position"], r["url"]) for r in got.additions.collect()) == sorted(additions)
    assert sorted(map(tuple, got.rejected.select("cluster_id", "url", "reason").collect())) == sorted(rejected)
    assert len(additions) + len(rejected) == len(results) and (target < 100 or len({r for *_, r in rejected}) > 10)


def test_receipts(spark):
    import json

    from coverscope.operators import receipts

    item = {"provider": "p", "capability": "c", "observed_at": "2026-08-27T01:00:00Z", "status": "succeeded", "external_request_id": None, "usage": {"unit": "credits", "before": 5, "after": 3.5, "delta": -1.5}, "evidence_urls": ["u"]}
    good = {"agent": " a ", "task_id": "t", "commit": "abcdef0", "tests": ["x"], "next": None, "integrations": [item]}
    cases = {
        "good": good, "plain": {"agent": "a", "task_id": "t"}, "list": [1], "agent": {**good, "agent": " "}, "task": {**good, "task_id": 7}, "commit": {**good, "commit": "XYZ"}, "next": {**good, "next": 1}, "tests": {**good, "tests": ["x", 1]}, "urls": {**good, "evidence_urls": "u"},
        "items": {**good, "integrations": 3}, "item": {**good, "integrations": [item, 4]}, "status": {**good, "integrations": [{**item, "status": "odd"}]}, "provider": {**good, "integrations": [{**item, "provider": ""}]}, "time": {**good, "integrations": [{**item, "observed_at": "soon"}]},
        "usage": {**good, "integrations": [item, {**item, "usage": {**item["usage"], "delta": 2}}]}, "usage_text": {**good, "integrations": [{**item, "usage": {**item["usage"], "before": "5"}}]}, "id": {**good, "integrations": [{**item, "external_request_id": 3}]}, "no_usage": {**good, "integrations": [{**item, "usage": None}]},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [("none", None), ("broken", "{")], "run_id string, receipt string")
    got = sorted((r["run_id"], r["code"], r["path"]) for r in receipts.receipt_issues(rows).collect())
    assert got == sorted([
        ("list", "invalid_receipt", ""), ("broken", "invalid_receipt", ""), ("agent", "missing_agent", "agent"), ("task", "missing_task_id", "task_id"), ("commit", "invalid_commit", "commit"), ("next", "invalid_next", "next"), ("tests", "invalid_list", "tests"), ("urls", "invalid_list", "evidence_urls"),
        ("items", "invalid_integrations", "integrations"), ("item", "invalid_integration", "integrations[1]"), ("status", "invalid_status", "integrations[0].status"), ("provider", "missing_provider", "integrations[0].provider"), ("time", "invalid_observed_at", "integrations[0].observed_at"),
        ("usage", "inconsistent_usage", "integrations[1].usage"), ("usage_text", "inconsistent_usage", "integrations[0].usage"), ("id", "invalid_external_request_id", "integrations[0].external_request_id"),
    ])
    own = {r["run_id"]: r for r in receipts.with_receipts(rows).collect()}
    assert (own["good"]["agent"], own["good"]["commit"], own["good"]["integrations"], own["plain"]["integrations"], own["usage"]["agent"]) == ("a", "abcdef0", 1, 0, None)


def test_lists_are_searched_and_counted(spark):
    from coverscope.functions import numbers as N
    from coverscope.sources import batch

    stories = spark.createDataFrame([("a", "Quake", None, ["Tokyo"], ["Wire"], ["w.example"], ["JP"]), ("b", "Flood", "In the north", None, ["Other"], ["o.example"], ["DE", "FR"]), ("b", None, None, [], [], [], None)], "cluster_id string, title string, summary string, labels array<string>, publishers array<string>, domains array<string>, regions array<string>")
    found = lambda t: sorted(r["title"] or "" for r in serving.search(stories, t).collect())
    assert (found(" TOKYO "), found("north"), found("example"), found("q")) == (["Quake"], ["Flood"], ["Flood", "Quake"], ["Quake"])
    assert [r["title"] for r in serving.within_region(stories, "FR").collect()] == ["Flood"] and serving.duplicate_rows(stories).first()["duplicates"] == 1
    assert [round(r[0], 2) for r in spark.createDataFrame([(0.0,), (0.5,), (9.0,), (-9.0,)], "v double").select(N.marker_scale(F.col("v"))).collect()] == [0.72, 1.22, 1.8, 0.72]
    parsed = spark.createDataFrame([(True,), (False,), (True,)], "valid boolean")
    assert tuple(batch.summed_diagnostics(batch.diagnostics(parsed).unionAll(batch.diagnostics(parsed, True))).first()) == (6, 4, 2, True)
    assert signals.omission()["status"] == "not_assessed"


def test_searches_go_to_the_most_promising_story_of_a_title(spark):
    rows = [("c1", "Quake shakes Tokyo towers", 2), ("c2", "Tokyo towers: quake shakes", 5), ("c3", "Parrots of Lima", 1), ("c4", "!!", 1)]
    clusters = spark.createDataFrame(rows, "cluster_id string, title string, article_count int")
    assert [r["cluster_id"] for r in enrich.searchable(clusters, 9).collect()] == ["c2", "c3"]
    assert [r["cluster_id"] for r in enrich.searchable(clusters, 9, include=["c1", "c3"], exclude=["c3"]).collect()] == ["c1"]
    articles = spark.createDataFrame([("a1", "w.example", "Opinion: no"), ("a2", "w.example", "News"), ("a3", "o.example", "Opinion")], "article_id string, domain string, title string")
    rules = spark.createDataFrame([("w.example", "^Opinion", "disputes", "negative", 0), ("w.example", None, "straight_report", "neutral", 1)], "domain string, title_pattern string, framing string, tone string, priority int")
    assert sorted((r["article_id"], r["framing"]) for r in enrich.framed(articles, rules).collect()) == [("a1", "disputes"), ("a2", "straight_report"), ("a3", None)]


def test_pairs_of_many_copies_arent_shuffled_and_have_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "CHUNK", 7)
    rows = [article(f"{i:03}", "Flood hits the old river town" if i % 3 else "Flood hits an old river town again", i) for i in range(60)]
    own = clustering.scored_pairs(articles_of(spark, rows))
    assert own.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    got = [(r["a"], r["b"]) for r in own.collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert len(got) == 60 * 59 // 2
    monkeypatch.setattr(clustering, "CHUNK", 1000)
    assert {(r["a"], r["b"], r["score"], tuple(r["reasons"])) for r in clustering.scored_pairs(articles_of(spark, rows)).collect()} == {(r["a"], r["b"], r["score"], tuple(r["reasons"])) for r in own.collect()}


def test_pairs_are_scored_in_methods_that_the_jvm_compiles(spark, capsys):
    rows = [article(f"{i:03}", "Flood hits the old river town", i) for i in range(9)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is the last one
    try:
        for own in (articles_of(spark, rows), articles_of(spark, rows).withColumn("location_ids", F.array("article_id"))):
            clustering.scored_pairs(own).explain("codegen")
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_names_alone_make_no_link_beyond_a_bucket_of_time(spark):
    rows = [article("a1", "Rescue boats leave harbour Flood", 0), article("a2", "Rescue boats leave harbour Flood", 60 * 24 * 60), article("b1", "Flood money boats never arrives", 30 * 24 * 60)]
    own = clustering._profile(articles_of(spark, rows), lambda title, _: F.array(F.lit("flood")))
    assert clustering._near_variants(own, *clustering._variants(own), 0.5, False).count() == 0
    assert {(r["a"], r["b"]) for r in clustering.scored_pairs(articles_of(spark, rows), extractor=lambda title, _: F.array(F.lit("flood"))).collect()} == {("a1", "a2")}


def test_scored_pairs_lose_none_of_all_pairs(spark):
    from coverscope.functions import numbers as N
    from coverscope.functions import text as X

    random.seed(5)
    rows = []
    for i in range(150):
        words = [w.title() if random.random() < 0.3 else w for w in random.sample("flood quake river town bridge harbour museum hall boats money storm paris".split(), random.randint(2, 7))]
        at = None if i % 10 == 0 else T0 + timedelta(minutes=random.randint(0, 30 * 24 * 60))
        rows.append((f"{i:03}", " ".join(words), at))
    own = spark.createDataFrame(rows, "article_id string, title string, published_at timestamp").withColumn("retrieved_at", F.col("published_at"))
    placed = own.withColumn("location_ids", F.when(F.col("article_id").endswith("3"), F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")))
    for articles in (own.where("published_at is not null"), own, placed):
        profile = {r["article_id"]: r for r in clustering._profile(articles, X.entities).collect()}
        share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0
        want = {}
        for a, b in itertools.combinations(sorted(profile), 2):
            x, y = profile[a], profile[b]
            parts = {"title": share(x["tokens"], y["tokens"]), "entities": share(x["names"], y["names"]) if x["names"] and y["names"] else None}
            parts["time"] = math.exp(-abs((x["at"] - y["at"]).total_seconds()) / 3600 / 36) if x["at"] and y["at"] else None
            parts["location"] = share(x["places"], y["places"]) if x["places"] and y["places"] else None
            known = {k: v for k, v in parts.items() if v is not None}
            score = sum(v * N.WEIGHTS[k] for k, v in known.items()) / sum(N.WEIGHTS[k] for k in known)
            if score >= 0.5:
                want[a, b] = round(score, 6)
        got = {(r["a"], r["b"]): round(r["score"], 6) for r in clustering.scored_pairs(articles).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 100


def test_matches_of_one_alias_are_dealt_out(spark):
    texts = spark.createDataFrame([(str(i), "o", "u", "summary", "in the town of the river") for i in range(400)], "article_id string, outlet_id string, url string, field string, text string")
    names = spark.createDataFrame([("the", 1, "city")], "alias string, place_id long, kind string")
    found = geocode.gazetteer_matches(texts.repartition(3), names)
    each = found.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(each) == 800 and max(each) < 400
    own = geocode.place_evidence(geocode.located_matches(found))
    plan = own._jdf.queryExecution().sparkPlan().toString()
    assert own.count() == 800 and "Aggregate" in plan and "REPARTITION" in plan.upper()


def test_receipts_of_one_partition_are_dealt_out(spark):
    rows = spark.createDataFrame([(i, '{"agent":" ","task_id":"t"}' if i % 2 else None) for i in range(40)], "run_id long, receipt string").coalesce(1)
    own = receipts.receipt_issues(rows)
    assert own.rdd.getNumPartitions() > 8 and {(r["code"], r["path"]) for r in own.collect()} == {("missing_agent", "agent")} and own.count() == 20


def test_values_that_should_be_unique_arent_held_before_they_are_dealt_out(spark):
    from coverscope.operators import constraints

    table = spark.createDataFrame([(str(i % 50), i) for i in range(51)], "run_id string, n int").coalesce(1)
    found = constraints.violations({"t": table}, {"t": constraints.Table(("run_id",), ("n",))})
    assert [(r["constraint"], r["key"], r["n"]) for r in found.collect()] == [("unique run_id", "0", 1)]
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_only_titles_of_other_than_ascii_signs_go_to_python_for_merging(spark):
    plan = lambda rows: merge.evidence_keys(spark.createDataFrame(rows, "cluster_id string, title string"), articles, places)._jdf.queryExecution().toString()
    articles = spark.createDataFrame([("a", "u")], "cluster_id string, canonical_url string")
    places = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p"), ("d", "p")], "cluster_id string, location_key string")
    assert "EvalPython" not in plan([("a", "Floods, again"), ("b", None)]) and "EvalPython" in plan([("a", "Été")])
    clusters = spark.createDataFrame([("a", "Été 1"), ("b", "Été 1"), ("c", "ete 1"), ("d", None)], "cluster_id string, title string")
    assert {tuple(r) for r in merge.merged_ids(clusters, articles, places).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}


def test_articles_of_a_composed_snapshot_are_merged_once(spark):
    from coverscope.plans.snapshot import assembled

    clusters = spark.createDataFrame([(i, "t", i, i) for i in range(4)], "cluster_id long, title string, first_observed_at long, last_observed_at long")
    articles = spark.createDataFrame([(i, f"a{i // 2}", f"u{i // 2}", i % 3, 0.5, i) for i in range(4)], "cluster_id long, article_id string, canonical_url string, outlet_id long, provider_score double, published_at long")
    places = spark.createDataFrame([(i, "l", "l", "X", None, 1.0, ["e"]) for i in range(4)], "cluster_id long, location_id string, location_key string, country string, admin1 string, confidence double, evidence array<string>")
    kept, own, _, shares = assembled(clusters, articles, places, 10)
    assert "min_by(struct(canonical_url" not in shares._jdf.queryExecution().toString()
    assert [(r["cluster_id"], r["article_id"], r["rank"]) for r in own.orderBy("rank").collect()] == [(0, "a1", 1), (0, "a0", 2)]
    assert [(r["cluster_id"], r["article_count"]) for r in kept.collect()] == [(0, 2)]
