import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from coverscope.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    own = bpe.Vocabulary(*bpe.Vocabulary.read(PATH), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ids, special_tokens={})


def test_long_runs_and_odd_signs(both):
    own, library = both
    texts = ["", "a" * 700, "ab" * 300, "=" * 900, "the" * 200, " " * 77 + "x", "é" * 99, "中文" * 40, "😀" * 30, "aaaaabbbbb" * 50, "<|endoftext|>", "it's we'll \r\n\t x"]
    assert list(bpe.Encoder(own).encode(texts)) == [library.encode_ordinary(t) for t in texts]
    assert all(own.decode(library.encode_ordinary(t)) == t.encode() for t in texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_texts(both, texts):
    own, library = both
    assert list(bpe.Encoder(own).encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_merges_of_a_lesser_rank_come_first():
    # "xab" ranks before "ab", though it can be made from it.
    tokens = [bytes([i]) for i in range(256)] + [b"xa", b"xab", b"bc", b"ab", b"abab"]
    own = bpe.Vocabulary(tokens, list(range(len(tokens))), r"\S+|\s+")
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=own.ids, special_tokens={})
    for word in ("xabc", "abab", "xabab", "ababab", "yabxab", "abc", "abcabc"):
        assert list(bpe.Encoder(own).encode([word]))[0] == library.encode_ordinary(word)


def test_rows_and_round_trip(spark, monkeypatch, both):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "REPLAYED_BYTES", 10)
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (None, "Hello"), (1, "Hello wörld"), (4, "z" * 30_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = bpe.encoded(docs, PATH, public_tokenizers.PATTERN, ids=True)
    for r, (i, t) in zip(got.collect(), rows, strict=True):
        ids = both[1].encode_ordinary(t or "")
        assert (r["doc_id"], r["n_tokens"], r["ids"]) == (i, len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert [r["text"] for r in bpe.decoded(got, PATH).collect()] == [t or "" for _, t in rows]
    assert bpe.encoded(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
