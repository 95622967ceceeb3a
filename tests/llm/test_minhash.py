import hashlib
import random

import numpy as np

from coverscope.llm import minhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_order_of_documents_edits_and_likeness(spark):
    random.seed(2)
    rows = []
    for i in random.sample(range(1000), 60):
        n = random.choice([0, 2, 30, 150, 400])
        rows.append((i, " ".join(f"é{random.randrange(3000)}" for _ in range(n))))
    rows += [(2000, None), (2001, "x" * 7), (2001, "y" * 9)]
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, near_next int")
    got = minhash.document_fingerprints(df).collect()
    assert len(got) == len(rows)
    known = sorted((i, t or "") for i, t in rows if i < 2001)
    by = {r["doc_id"]: r for r in got}
    error = []
    for (i, t), (j, n) in zip(known, known[1:], strict=False):
        r, q = by[i], len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(n)
        if a and b:
            error.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
        if a and c:
            error.append(abs(r["near_next"] - len(a & c) / len(a | c)))
    assert sum(error) / len(error) < 0.03
    last = [r for r in got if r["doc_id"] == 2001]
    first = known[0][1]
    assert any(r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 4] + first[: len(t) // 4]).encode()).hexdigest() for r in last for t in ("x" * 7, "y" * 9))


def test_equal_texts_and_texts_without_words(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "A B c d e f g"), (3, ""), (4, None), (None, "z")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.document_fingerprints(df).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and len(got[1]["fingerprint"]) == minhash.BINS * minhash.LOW_BITS // 4
    assert got[1]["near_next"] == 1.0 and got[2]["near_next"] == 0.0 and got[3]["near_next"] == 1.0 and got[3]["fingerprint"] == ""
    assert minhash.document_fingerprints(df.where("false")).count() == 0
    alone = minhash.document_fingerprints(df.where("doc_id = 1")).collect()
    assert [r["near_next"] for r in alone] == [1.0]


def plain_bits(text):
    """Each bin's least hash; an empty bin takes that of the first full one in its order."""
    least = {}
    for h in maker.hashes(text).tolist():
        b = h >> (64 - 9)
        least[b] = min(h, least.get(b, h))
    orders = minhash._orders()
    return [least[b] if b in least else least[next(x for x in orders[b].tolist() if x in least)] for b in range(minhash.BINS)]


maker = minhash.Fingerprinter()


def test_bins_and_densification_are_as_plainly_done():
    random.seed(7)
    for n in (1, 3, 6, 40, 400, 3000):
        text = " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
        assert maker.low_bits(text).tolist() == minhash.bits_of(np.array(plain_bits(text), np.uint64)).tolist()


def test_unrelated_short_texts_have_no_likeness():
    for n in (1, 3, 7, 20):
        each = [maker.low_bits(" ".join(f"w{i}x{j}" for j in range(n))) for i in range(100)]
        assert max(maker.likeness(a, b) for a, b in zip(each, each[1:], strict=False)) < 0.15


def test_one_id_on_many_rows_is_dealt_to_several_ranges(spark):
    keys, hashes = minhash.starts_of([3, 9, 9, 9, 20])
    assert keys.tolist() == [3, 9, 9, 9, 20] and len(set(minhash.parts_of(np.full(50, 9), np.linspace(-(2**63), 2**63 - 1024, 50).astype(np.int64), keys, hashes).tolist())) == 3
    assert minhash.parts_of(np.array([1, 3, 8, 19, 20, 99]), np.zeros(6, np.int64), keys, hashes).tolist() == [0, 1, 1, 4, 5, 5]
    rows = [(None, f"null {i} of them is here {i}") for i in range(40)] + [(i, f"text {i} of some more words {i}") for i in range(20)]
    got = minhash.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {len(t): t for _, t in rows}
    edits = {hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest() for _, t in rows for _, n in rows}
    assert len(got) == 60 and texts and all(r["edited_sha256"] in edits for r in got)
