import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from coverscope.llm import toxicity as T


def test_marginals_are_those_of_all_taggings():
    random.seed(0)
    trans = np.array([[0.3, -0.7], [-0.2, 0.9], [0.1, -0.4]])
    chains = [[random.uniform(-2, 2) for _ in range(n)] for n in (1, 4, 3, 6)]
    p, expected = T.marginals(np.array([x for c in chains for x in c]), np.array([0, 1, 5, 8]), trans, learn=True)
    at, sums = 0, np.zeros((3, 2))
    for c in chains:
        weights = {}
        for tags in itertools.product((0, 1), repeat=len(c)):
            s = trans[2, tags[0]] + sum(e for e, t in zip(c, tags, strict=True) if t) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False))
            weights[tags] = np.exp(s)
        z = sum(weights.values())
        for i in range(len(c)):
            assert abs(p[at + i] - sum(w for t, w in weights.items() if t[i]) / z) < 1e-9
        for t, w in weights.items():
            sums[2, t[0]] += w / z
            for a, b in zip(t, t[1:], strict=False):
                sums[a, b] += w / z
        at += len(c)
    assert np.allclose(expected, sums)


def corpus(n, seed):
    random.seed(seed)
    rows = []
    for i in range(n):
        words = [f"w{random.randrange(400)}" for _ in range(random.randint(5, 60))]
        toxic = random.random() < 0.3
        for _ in range(random.randint(1, 4) * toxic):
            words.insert(random.randrange(len(words)), "grub" + random.choice(["ly", "ish", "er", "x"]))
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


def test_held_out_accuracy_and_offsets(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = T.trained(docs, labels)
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "GRUBLY İ grubish"), (None, "grubly grubly")], "doc_id long, text string")
    got = T.toxicity_scores(docs.unionAll(odd), model, spans=True).withColumn("held_out", T.held_out(F.col("doc_id"))).collect()
    by = {r["doc_id"]: r for r in got}
    held = [(y, by[i]["predicted"]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(y == p for y, p in held) / len(held) > 0.97
    assert by[9001]["score"] == by[9002]["score"] < 0.5
    assert ["GRUBLY", "grubish"] == ["GRUBLY İ grubish"[a:b] for a, b in by[9003]["spans"]]
    kept = T.without_toxic(docs.withColumn("score", F.lit("kept")), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in rows if by[i]["predicted"] == 0}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.trained(docs, labels)
    assert T.toxicity_scores(docs, model).first()["predicted"] == 0
    assert T.toxicity_scores(docs.where("false"), model).count() == 0


def test_long_chains_and_texts():
    model = T.Field()
    p, places = model.tags(["word " * 5000, "", ". . ."], model.emissions())[0]
    assert len(p) == 5000 and list(places[:2]) == [0, 1]
