import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coverscope.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Groups of a whole text by both libraries, byte by byte."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet, vocabulary = alignment.byte_alphabet(), {i: t for t, i in a.get_vocab().items()}

    def groups(text):
        if not text:
            return []
        whole = f" {text}".encode()
        left = [(i, bytes(alphabet[x] for x in vocabulary[i])) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            return []
        out, p, q, x, y = [([], [])], 0, 0, 0, 0
        for end in range(1, len(whole) + 1):
            if x < len(left) and p + len(left[x][1]) == end:
                out[-1][0].append(left[x][0])
                p, x = end, x + 1
            if y < len(right) and q + len(right[y][1]) == end:
                out[-1][1].append(right[y][0])
                q, y = end, y + 1
            if p == q == end:
                out.append(([], []))
        return out[:-1]

    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def linked(groups):
    return Counter((x, y) for a, b in groups for x in a for y in b)


@pytest.fixture(scope="module")
def aligner():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return alignment.Aligner(a.read(), b.read())


ODD = ["", " ", "  x", "x  ", "a\n b", "a \n\tb", "a  b", "a 　b", "it's 'quoted' we'll", "<s> </s> <unk> <|endoftext|> <0x41>", "▁x", "été ü̈", "中文字 と かな", "😀 👩‍👩‍👧 x", "zzzz" * 99, "\x1c a \x85 b", "\x00 \x01", "a  b   c    d", "=" * 300, "1234567890 3.14", "​ a ﻿ b", "٣٤ ab"]


def check(aligner, plain, texts):
    for text, (n, found, keys, links) in zip(texts, aligner.align(texts), strict=True):
        want = plain(text)
        assert found == written(want)
        assert n == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want), sum(len(a) * len(b) for a, b in want))
        assert {(k // aligner.width, k % aligner.width): x for k, x in zip(keys.tolist(), links.tolist(), strict=True)} == linked(want)
        again = alignment.unpacked(alignment.packed(keys, links))
        assert np.array_equal(again[0], keys) and np.array_equal(again[1], links)


def test_odd_texts(aligner, plain, monkeypatch):
    check(aligner, plain, ODD)
    aligner.clear()
    monkeypatch.setattr(alignment, "WIDE_GROUP", 3)
    check(aligner, plain, ODD)
    aligner.clear()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tab.,'s1é中▁ "), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_texts(aligner, plain, texts):
    check(aligner, plain, texts)


def test_given_documents(aligner, plain):
    import pyarrow.parquet as pq

    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    check(aligner, plain, texts)


@pytest.mark.parametrize("sent", [1 << 22, 40, 0])
def test_rows(spark, plain, monkeypatch, sent):
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    monkeypatch.setattr(alignment, "COUNTED_PAIRS", 50)
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", 9)
    texts = [*ODD, None, "the cat sat on the mat", "the cat sat on the mat", "The catalogue of mats", "unrelated ououeaux"]
    rows = [(None if i == 3 else i % 25, t, "x", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, row int").repartition(3)
    want, groups = [], [plain(t or "") for t in texts]
    counts = Counter(k for g in groups for k in linked(g))
    best = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    for (i, *_), g in zip(rows, groups, strict=True):
        own = linked(g)
        sha = hashlib.sha256(written(g).encode()).hexdigest() if g else ""
        want.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for k, n in own.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in own.items()), sha))
    got = alignment.aligned(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert alignment.aligned(docs.where("false"), A, B).count() == 0
    if sent > 40:
        texts_of = alignment.alignments(docs, A, B, groups=True).collect()
        assert sorted(r["groups"] for r in texts_of) == sorted(map(written, groups))
