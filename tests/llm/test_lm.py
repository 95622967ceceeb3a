import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from coverscope.llm import lm


def corpus(n, seed=0):
    random.seed(seed)
    word = lambda: "".join(random.choice(["ka", "lo", "mi", "tu", "the"]) for _ in range(random.randint(1, 4)))
    phrases = [" ".join(word() for _ in range(4)) for _ in range(40)]
    return [(i, " ".join(random.choice(phrases) for _ in range(random.choice([0, 1, 8, 30])))) for i in range(n)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(300) + [(900, None), (901, "The\tOF \n the ÉTÉ"), (902, "unseenword " * 3)]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows] + [(None, "the of", 0.0), (5, "again of", 0.0)], "doc_id long, text string, score double")
    return rows + [(None, "the of"), (5, "again of")], lm.scored(df).collect()


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_base_scores(scored):
    rows, got = scored
    train = [lm.tokens((t or "").encode()) for i, t in rows if not held(i)]
    counts = Counter(w for x in train for w in x)
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    p = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    want = sorted((str(i), held(i), len(w := lm.tokens((t or "").encode())) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(sum(p(counts[x]) for x in w) + p(len(train)), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_model_is_better_on_held_out_texts(scored):
    _, got = scored
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 for r in got)


BITS = (14, 15, 15)


def small_mixer():
    docs = lm.spread([lm.tokens(t.encode()) for _, t in corpus(80, 3)])
    code = lm.Code(lm.triple_counts(docs).astype(float).reshape(128, 128, 256))
    totals, keys = [np.zeros(2 << b, np.int64) for b in BITS], np.zeros(code.contexts() << 8, np.int64)
    for some in lm.pieces(docs):
        piece = lm.Piece(some, code, BITS)
        keys += np.bincount(piece.keys, minlength=len(keys))
        for total, slots in zip(totals, piece.slots[1:], strict=True):
            total += np.bincount(slots * 2 + piece.bit, minlength=len(total))
    return lm.Mixer(code, BITS, [code.pair_table(keys), *[lm.levels(t[0::2], t[1::2]) for t in totals]]), docs


def test_codes_are_whole_and_scores_stand_alone():
    mixer, docs = small_mixer()
    code = mixer.code
    # Of each context the codes of all bytes fill the tree, so probabilities of the next byte sum to one.
    assert np.allclose((0.5 ** code.length.reshape(-1, 256)).sum(axis=1), 1.0)
    mixer.fit(docs[:20])
    whole = mixer.units(docs)
    assert np.allclose(whole, np.concatenate([mixer.units([d]) for d in docs]), atol=1e-5)
    assert len(whole) == sum(max(1, len(d.split())) for d in docs)


def wrapped(x):
    return x & (2**64 - 1)


def plain_score(mixer, doc):
    """log10 of a document's probability, bit by bit and with numbers of Python's: contexts, slots, weights, the repeat predictor and what is learned on the way."""
    code, end = mixer.code, lm.END
    letter, base = [int(x) for x in lm._LETTER], lm._BASE
    word = lambda w: wrapped(sum(letter[b] * base**i for i, b in enumerate(w)))
    before = lambda i, k: bytes([end] * max(0, k - i)) + doc[max(0, i - k) : i]
    seen, done, current = {}, [], b""
    factors, curve, run, left, kept = np.ones(lm.INPUTS), np.eye(lm.INPUTS) * lm.HELD, lm.FIRST_BITS, lm.FIRST_BITS, []
    total = 0.0
    for i, byte in enumerate(doc):
        if i and doc[i - 1] == 32:
            done.append(word(current[:-1]))
            if len(done) >= 2:
                seen[tuple(done[-3:-1]) if len(done) > 2 else (0, done[-2])] = (begun, i)
            begun, current = i, b""
        elif i == 0:
            begun = 0
        two, one = before(i, 2)
        context = int(code.context[two, one])
        if not current:
            key = tuple(done[-2:]) if len(done) > 1 else (0, done[-1]) if done else None
            source = seen.get(key)
            guess = doc[source[0] : source[1]] if source else b""
            right = True
        last = done[-1] if done else 0
        four, prefix = int.from_bytes(before(i, 4), "little"), word(current)
        joint = prefix ^ wrapped(last * 0x9E3779B97F4A7C15) if len(current) <= lm.WORD_BEFORE else wrapped(int.from_bytes(before(i, 6), "little") + 1)
        at = lambda b: context * 256 + b
        path = lambda b: [int(x) for x in code.steps[int(code.offset[at(b)]) : int(code.offset[at(b)] + code.length[at(b)])]]
        said = guess[len(current)] if right and len(current) < len(guess) else None
        for depth, step in enumerate(path(byte)):
            node, bit = step >> 1, step & 1
            slots = [context << lm.NODES | node]
            for k, (c, size) in enumerate(zip((four, prefix, joint), BITS, strict=True)):
                h = wrapped(wrapped(c + k) * 0xFF51AFD7ED558CCD)
                slots.append((h ^ (h >> 29)) >> (64 - size) ^ ((node + 1) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - size))
            values = [int(t[s]) for t, s in zip(mixer.tables, slots, strict=True)]
            says, gate = 0.0, (values[3] & 3) << 2 | values[2] & 3
            if said is not None and depth < len(path(said)) and path(said)[depth] >> 1 == node:
                says, gate = 2.0 * (path(said)[depth] & 1) - 1, gate | 16 * (1 + (len(current) >= 2))
            x = np.array([1.0, *[v / 4 / 256 for v in values], says]) * mixer.weights[gate] * (2 * bit - 1)
            total -= math.log1p(math.exp(-float(factors @ x)))
            kept.append(x)
            left -= 1
            if left == 0:
                xs = np.array(kept)
                wrong = 1 - 1 / (1 + np.exp(-xs @ factors))
                curve = curve + (xs.T * (wrong * (1 - wrong))) @ xs
                factors = (factors + np.linalg.solve(curve, xs.T @ wrong)).clip(0, 4)
                run, kept = run * 2, []
                left = run
        if said is not None and said != byte:
            right = False
        current += bytes([byte])
    return total / math.log(10)


def test_scores_are_as_bit_by_bit(monkeypatch):
    monkeypatch.setattr(lm, "FIRST_BITS", 64)
    mixer, docs = small_mixer()
    mixer.fit(docs[:20])
    for doc in [*docs[:6], docs[3][:-1] + b" " + docs[3], b"\n", b"the the the the of the the of\n", "é ñé xy zzz ü\n".encode()]:
        assert math.isclose(mixer.units([doc]).sum(), plain_score(mixer, doc), rel_tol=4e-3, abs_tol=0.02)


def test_probabilities_of_the_next_byte_sum_to_one():
    mixer, _ = small_mixer()
    lead = b"the of ka"
    mass = 0.0
    for x in range(256):
        if x in (32, 10) or not 65 <= x <= 90:
            text = lead + bytes([x])
            piece = lm.Piece([(text, 0)], mixer.code, BITS)
            bits = int(mixer.code.length[mixer.code.context[ord("k"), ord("a")] * 256 + x])
            signed = mixer.weighted(piece).sum(axis=0)
            mass += float(np.exp(-np.logaddexp(0, -signed[-bits:].astype(float)).sum()))
    assert 0.97 < mass <= 1.0 + 1e-6


def test_long_documents_are_scored_in_stretches(monkeypatch):
    mixer, docs = small_mixer()
    monkeypatch.setattr(lm, "PIECE_BYTES", 200)
    doc = b" ".join(d.strip() for d in docs if d.strip()) + b"\n"
    assert len(lm.stretches(doc)) > 5 and b"".join(d[k:] for d, k in lm.stretches(doc)) == doc
    assert len(mixer.units([doc])) == len(doc.split())
    assert lm.stretches(b"x" * 1000 + b"\n") == [(b"x" * 1000 + b"\n", 0)]


def test_tables_grow_with_the_corpus_and_are_counted_over_all_training_documents(spark):
    assert lm.table_bits(0) == lm.LEAST_SLOTS and lm.table_bits(1 << 29) == (21, 22, 22) and lm.table_bits(1 << 60) == lm.MOST_SLOTS
    rows = corpus(400, 5)
    blocks = lm.blocks_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    lines = lm.spread([lm.tokens(t.encode()) for i, t in rows if not held(i)])
    counts = lm.triple_counts(lines).astype(float).reshape(128, 128, 256)
    assert (lm._triple_counts(blocks) == counts).all()
    code = lm.Code(counts)
    both = [lm.counted(blocks, code.parts(), BITS, chosen) for chosen in (False, True)]
    assert both[1].count() > 0
    got = lm.tables_of(both[0].unionAll(both[1]), code, BITS)
    for k, size in enumerate((code.contexts() << lm.NODES, *[1 << b for b in BITS])):
        want = np.zeros(2 * size, np.int64)
        for some in lm.pieces(lines):
            piece = lm.Piece(some, code, BITS)
            want += np.bincount(piece.slots[k] * 2 + piece.bit, minlength=len(want))
        assert (got[k] == lm.levels(want[0::2], want[1::2])).all()


def test_empty_table(spark):
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weights_are_fitted_on_every_training_document(spark):
    rows = corpus(300, 5)
    blocks = lm.blocks_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    mixer, _ = small_mixer()
    train = lm.spread([lm.tokens(t.encode()) for i, t in rows if not held(i)])
    want = sum(len(lm.Piece(some, mixer.code, BITS).bit) for some in lm.pieces(train))
    fits = [lm.fitted(blocks, mixer.code.parts(), BITS, mixer.tables, which) for which in (0, 1)]
    assert all(n > want / 4 for _, n in fits) and sum(n for _, n in fits) == want
    assert all(np.abs(w / n - mixer.weights).max() > 0.01 for w, n in fits)


def test_weights_fitted_beside_counts_are_the_same(spark):
    rows = corpus(200, 6)
    blocks = lm.blocks_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    mixer, _ = small_mixer()
    code = mixer.code.parts()
    sent = spark.sparkContext.broadcast((code, mixer.tables))
    both = lm.counted(blocks, code, BITS, 1, sent)
    (w, n), (want, bits) = lm.fitted_beside(both), lm.fitted(blocks, code, BITS, mixer.tables, 1)
    assert n == bits > 0 and np.allclose(w, want, rtol=1e-12)
    parts = lambda df: sorted((r["part"], lm.zstandard.ZstdDecompressor().decompress(bytes(r["counts"]))) for r in df.where(f"part <> {lm.FITTED}").collect())
    assert parts(both) == parts(lm.counted(blocks, code, BITS, 1))


def test_orders_are_stable_and_owners_repeat():
    rng = np.random.default_rng(1)
    for keys in (rng.integers(0, 50, 999), rng.integers(0, 1 << 63, 999), np.append(rng.integers(0, 1 << 63, 99), [5, 6, 5, 7])):
        keys = keys.astype(np.uint64)
        assert (lm.stable_order(keys) == np.argsort(keys, kind="stable")).all()
    for length in (rng.integers(0, 4, 99), rng.integers(1, 4, 99)):
        assert (lm.owners(length, np.cumsum(length)) == np.repeat(np.arange(99), length)).all()


def test_distinct_is_as_unique():
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 50, 999), rng.integers(0, 1 << 63, 99), np.append(rng.integers(0, 1 << 20, (1 << 20) + 5) << 40, [5, 6, 5, 7]), np.empty(0)):
        for got, want in zip(lm.distinct(keys.astype(np.uint64)), np.unique(keys.astype(np.uint64), return_inverse=True), strict=True):
            assert (got == want).all()


def test_steps_of_a_fit_are_as_by_plain_sums():
    mixer, docs = small_mixer()
    columns = mixer.weights.T.astype(np.float64)
    for some in lm.pieces(docs):
        piece = lm.Piece(some, mixer.code, BITS)
        values, (where, says), gate = mixer.inputs(piece)
        repeat = np.zeros(len(gate))
        repeat[where] = says
        x = np.array([np.ones(len(gate)), *[v / 4 / 256 for v in values], repeat])
        for a in range(0, len(gate), 1 << 14):
            g, xs = gate[a : a + (1 << 14)], x[:, a : a + (1 << 14)]
            miss = piece.bit[a : a + (1 << 14)] - 1 / (1 + np.exp(-(xs * columns[:, g]).sum(axis=0)))
            columns += lm.RATE * np.array([[(miss * row)[g == k].sum() for k in range(lm.GATES)] for row in xs]) / (np.bincount(g, minlength=lm.GATES) + 64.0)
    mixer.fit(docs)
    assert np.abs(mixer.weights - small_mixer()[0].weights).max() > 0.01 and np.allclose(mixer.weights, columns.T, atol=1e-4)


def test_memory_of_pieces_is_kept():
    """Making a piece again asks the system for next to no memory, in a process of its own as tasks have."""
    import os
    import subprocess
    import sys

    code = """
import resource
from coverscope.llm import lm
docs = [b"some words of a text that is not short " * 50 + b"\\n" for _ in range(130)]
code = lm.Code(lm.triple_counts(docs).astype(float).reshape(128, 128, 256))
lm.keep_freed()
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
def again():
    for some in lm.pieces(docs):
        lm.Piece(some, code, (20, 21, 21))
again()
before = faults()
for _ in range(5):
    again()
print(faults() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    faults = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, cwd=root).stdout)
    assert faults < 2000
