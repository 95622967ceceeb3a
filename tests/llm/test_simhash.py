import random

import xxhash
from pyspark.sql import functions as F

from coverscope.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(n, seed):
    random.seed(seed)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    out = []
    for i in range(n):
        if out and random.random() < 0.4:
            own = random.choice(out).split()
            if own:
                own[random.randrange(len(own))] = random.choice(words)
            out.append(" ".join(own))
        else:
            out.append(" ".join(random.choice(words) + str(random.randrange(90)) for _ in range(random.choice([0, 1, 3, 8, 40, 200]))))
    return out


def test_components_are_exact(spark):
    rows = list(enumerate(texts(150, 5))) + [(500, None), (501, ""), (502, " \t"), (503, "one"), (504, "ONE"), (503, "one")]
    got = simhash.simhash_components(docs(spark, rows)).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(prints)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in prints}


def test_links_of_a_large_group_are_whole_with_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    random.seed(1)
    prints = [random.getrandbits(64)]
    for _ in range(120):
        x = random.choice(prints)
        for b in random.sample(range(64), random.randint(1, 4)):
            x ^= 1 << b
        prints.append(x)
    prints = list(dict.fromkeys(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "node long")
    masks = simhash.pigeonhole_masks(len(prints), 4)
    keyed = nodes.select("node", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("node").bitwiseAND(simhash._long(m))) for i, m in enumerate(masks)])).alias("key")).select("key", "node")
    labels = dict(tuple(r) for r in simhash.connected_components(simhash.block_links(keyed, 4)).collect())
    want = plain_components(dict(zip(signed, prints, strict=True)))
    for a in signed:
        assert labels.get(a, a) == min(x for x in signed if want[x] == want[a])


def test_any_number_of_blocks_finds_all_pairs():
    for n in (10, 10**6, 10**10):
        masks = simhash.pigeonhole_masks(n, 4)
        random.seed(n)
        for _ in range(300):
            a = random.getrandbits(64)
            b = a
            for i in random.sample(range(64), 4):
                b ^= 1 << i
            assert any(a & m == b & m for m in masks)


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "same text of five words"), (3, "same text of five words"), (None, "another one")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert got == {(None, 3), (3, 3), (None, None)}
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_near_duplicates_by_five_word_shingles(spark):
    random.seed(9)
    base = [f"word{random.randrange(10**6)}" for _ in range(300)]
    near = list(base)
    for i in (20, 140, 260):  # 15 of 296 shingles
        near[i] = f"new{i}"
    far = [f"other{random.randrange(10**6)}" for _ in range(300)]
    half = base[:150] + far[:150]
    clash = docs(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(half)), (5, " ".join(base)), (5, " ".join(base)), (None, "x"), (6, None), (7, "")])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(clash.withColumn("fp", F.lit(0)).withColumn("node", F.lit(1))).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, None: None, 6: 6, 7: 6}
    kept = simhash.deduplicated(clash)
    assert kept.columns == clash.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "6", "None"]


def test_one_id_with_two_texts_keeps_both(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (2, b, "y"), (3, "b " + b, "y")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, text_key string"))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (1, b)]


def five(text):
    w = (text or "").lower().encode().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(x, y):
    return x == y or (bool(x) and bool(y) and 5 * len(x & y) >= 4 * len(x | y))


def plain_groups(sets):
    """By comparing all texts with all; ids ascend."""
    root = {}
    for i, x in sets.items():
        near = {root[j] for j, y in sets.items() if j in root and alike(x, y)}
        root[i] = min(near, default=i)
        for j in root:
            if root[j] in near:
                root[j] = root[i]
    return root


def varied(rng, base, how, share):
    """A text of which a share is replaced by new words: scattered, in one passage, or put in at a place or at the end."""
    own, new, n = base.split(), lambda: f"new{rng.randrange(10**7)}", len(base.split())
    k = int(n * share)
    if how == "scattered":
        for i in rng.sample(range(n), max(1, k // 5)):
            own[i] = new()
    elif how == "replaced":
        at = rng.randrange(n - k)
        own[at : at + k] = [new() for _ in range(k)]
    else:
        at = n if how == "extended" else rng.randrange(n)
        own[at:at] = [new() for _ in range(k)]
    return " ".join(own)


def test_all_texts_alike_to_four_fifths_are_linked(spark, monkeypatch):
    """Every group is that of all pairs, at any size and kind of change, with passages that many texts share and with groups that are dealt out."""
    rng = random.Random(11)
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = []
    for n in (12, 40, 150, 600):
        for how in ("scattered", "replaced", "inserted", "extended"):
            for share in (0.03, 0.08, 0.11, 0.14, 0.19, 0.22, 0.25, 0.3):
                base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
                texts += [base + " " + passage if n > 100 else base, varied(rng, base, how, share) + (" " + passage if n > 100 else "")]
    sets = {i: five(t) for i, t in enumerate(texts)}
    want = plain_groups(sets)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    assert got == want and 20 < len(set(want.values())) < 200
    monkeypatch.setattr(simhash, "PAIRED", 2)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, list(enumerate(texts)))).collect()} == want


def test_pairs_of_the_given_table_by_queries_against_all(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    sets = {i: five(t) for i, t in rows}
    holders = {}
    for i, x in sets.items():
        for h in x:
            holders.setdefault(h, set()).add(i)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    near = [(i, j) for i in sets for j in set().union(*(holders[h] for h in sets[i])) if i < j and alike(sets[i], sets[j])]
    assert len(near) > 50 and all(got[i] == got[j] for i, j in near)
    linked = {x for p in near for x in p}
    assert all(got[i] == i for i in sets if i not in linked and sets[i])
