import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coverscope.llm import langid


def worth(scores, path, switch):
    return sum(scores[t][x] for t, x in enumerate(path)) - switch * sum(a != b for a, b in itertools.pairwise(path))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3).flatmap(lambda k: st.lists(st.lists(st.integers(-6, 0), min_size=k, max_size=k), min_size=1, max_size=6)), st.sampled_from([0, 1, 2, 5]))
def test_path_is_the_best_of_all(scores, switch):
    got = langid.best_path(np.array(scores, float), switch).tolist()
    best = max(worth(scores, p, switch) for p in itertools.product(range(len(scores[0])), repeat=len(scores)))
    assert worth(scores, got, switch) == best


TEXTS = {
    "en": "the cat sat on the mat and the dog was with the children who went to the house of their friends",
    "de": "der Hund ist auf der Straße und die Katze sitzt nicht mit den Kindern in einem großen Haus",
    "ru": "собака и кошка живут в большом доме с детьми которые любят играть на улице",
    "el": "ο σκύλος και η γάτα ζουν σε ένα μεγάλο σπίτι με τα παιδιά που παίζουν στον δρόμο",
    "uk": "собака і кішка живуть у великому будинку з дітьми які люблять гратися на вулиці",
}


def corpus():
    rows = []
    for lang, text in TEXTS.items():
        words = text.split()
        r = np.random.default_rng(len(rows))
        rows += [" ".join(r.choice(words, 12)) for _ in range(30)]
    return [(i, t, list(TEXTS)[i // 30], 5, "x") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def model(spark):
    return langid.trained(spark.createDataFrame(corpus(), "doc_id long, text string, lang string, score int, cell string").repartition(3))


def test_spans_of_mixed_text(spark, model):
    en, de, ru = TEXTS["en"], TEXTS["de"], TEXTS["ru"]
    text = f"{en}. {de}! 123 {ru} ({TEXTS['el']})"
    row = langid.languages_of(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, spans=True).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru", "el"]
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == [en, de, ru, TEXTS["el"]]
    assert row["lang_pred"] == "en" and 0.2 < row["score"] < 0.5


def test_scripts_narrow(model):
    uses = {lang: [n for n, u in zip(langid.SCRIPTS, row, strict=True) if u] for lang, row in zip(model.languages, model.uses, strict=True)}
    assert uses == {"de": ["latin"], "el": ["greek"], "en": ["latin"], "ru": ["cyrillic"], "uk": ["cyrillic"]}
    scores = dict(zip(["жжж", "xyz", "漢字", "aж"], model.score(["жжж", "xyz", "漢字", "aж"]), strict=True))
    at = {lang: i for i, lang in enumerate(model.languages)}
    assert all(scores["жжж"][at[x]] == -langid.FOREIGN for x in ("de", "el", "en")) and scores["жжж"][at["ru"]] > -langid.FOREIGN
    assert all(scores["xyz"][at[x]] == -langid.FOREIGN for x in ("el", "ru", "uk"))
    assert scores["漢字"].max() == 0 and scores["aж"].max() == 0  # no language uses these: no narrowing
    assert all(s.max() == 0 for s in scores.values())


def test_blocks():
    assert all(langid._NAMES[langid.scripts_of([w])[0][0]] == name for w, name in (("a", "latin"), ("é", "latin"), ("ж", "cyrillic"), ("λ", "greek"), ("中", "han"), ("か", "kana"), ("한", "hangul"), ("ع", "arabic"), ("न", "devanagari"), ("𠀀", "han"), ("ก", "thai"), ("ｱ", "kana"), ("Ａ", "latin")))
    assert len(langid.scripts_of(["é"])[0]) == 1  # a mark has no script


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ... !"), (None, TEXTS["de"]), (4, TEXTS["en"]), (4, TEXTS["en"]), (5, "a" * 50_000), (6, f"{TEXTS['ru']} " * 3000), (7, "²³ ½")]
    docs = spark.createDataFrame([(i, t, 1, "zz", "q") for i, t in rows], "doc_id long, text string, lang_pred int, lang string, spans string").repartition(2)
    got = {}
    for r in langid.languages_of(docs, model, spans=True).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], len(r["spans"])))
        assert 0 <= r["score"] <= 1
    assert got[1] == got[2] == got[3] == got[7] == [("und", 0)]
    assert got[None] == [("de", 1)] and got[4] == [("en", 1)] * 2 and got[6] == [("ru", 1)] and len(got[5]) == 1
    assert langid.languages_of(docs.where("false"), model).count() == 0
    # Nothing to learn from.
    none = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identified(none).collect()} == {("und", 0.0)}
    assert langid.identified(docs.where("false")).count() == 0


def test_learns_only_from_what_is_not_held_out(spark):
    rows = [(i, t, "held" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang, *_ in corpus()]
    docs = spark.createDataFrame([*rows, (None, TEXTS["de"], "de"), (999, "x", None)], "doc_id long, text string, lang string")
    assert langid.trained(docs).languages == sorted(TEXTS)
    got = langid.identified(docs).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i, _, lang in rows if lang == "held"}
    assert all(r["lang_pred"] in TEXTS or r["doc_id"] == 999 for r in got)


def test_a_bound_takes_a_share(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, score int, cell string")
    assert langid.trained(docs, most_docs=6).languages == sorted(TEXTS)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in rows)
    assert len(rows) > 200 and right >= 0.99 * len(rows)
