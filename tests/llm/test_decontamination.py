import random
from collections import defaultdict

import regex

from coverscope.llm import decontamination as D

ITEM = "A farmer named Alice has 12 cows and sells 5 of them to her neighbour Robert for 300 dollars each; how much money does Alice get?"


def found(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"], r["kind"]) for r in D.contaminated(docs, bench).collect()}


def test_verbatim_reparameterised_and_clean(spark):
    pre, post = "Some words that come before it here. ", " And words that follow after."
    swapped = ITEM.replace("Alice", "Clara").replace("Robert", "Simon").replace("12", "31").replace("300", "450")
    broken = ITEM.replace("Alice has", "Clara has")  # one name in the item, two in the text
    broken = broken.replace("farmer named Clara has 12 cows and sells 5 of them to her neighbour Robert", "farmer named Clara has 12 cows and sells 5 of them to her neighbour Clara")
    texts = [(1, pre + ITEM + post), (2, pre + swapped + post), (3, pre.upper() + ITEM.upper()), (4, ITEM.replace(" ", "%%% ")), (5, pre + post), (6, "A farmer named Alice has 12 cows."), (7, None), (8, ""), (9, broken), (None, ITEM)]
    got = found(spark, texts, [(10, ITEM), (11, "too short"), (12, None), (None, ITEM)])
    assert {(i, k) for i, _, k in got} == {(1, "verbatim"), (2, "reparameterised"), (3, "verbatim"), (4, "verbatim"), (None, "verbatim")}


def test_names_at_the_start_of_sentences_and_of_several_words(spark):
    item = "Anna has 5 apples. Ben has 7. How many apples do Anna and Ben have together?"
    other = item.replace("Anna", "Clara").replace("Ben", "Simon").replace("5", "8")
    longer = item.replace("Anna", "Mary Ann").replace("7", "9")
    wrong = other.replace("do Clara", "do Peter")
    lower = "before it " + item.lower() + " after"
    texts = [(1, "Words. " + other), (2, f"“{longer}”"), (3, "Seen by Robert " + item), (4, wrong), (5, lower), (6, "Who has it? Ben has 7.")]
    assert found(spark, texts, [(1, item)]) == {(1, 1, "reparameterised"), (2, 1, "reparameterised"), (3, 1, "verbatim"), (5, 1, "verbatim")}
    # Verbatim after text without a full stop, and short.
    assert found(spark, [(1, "and so on Copper melts before iron does, and more"), (2, "on Copper melts before tin")], [(2, "Copper melts before iron does.")]) == {(1, 2, "verbatim")}


def test_items_under_five_words_match_whole_texts(spark):
    assert found(spark, [(1, "gold-rush fever!"), (2, "a gold rush fever"), (3, "gold rush"), (4, "gold RUSH, fever")], [(1, "gold rush fever"), (2, "..."), (3, "rush")]) == {(1, 1, "verbatim"), (4, 1, "verbatim")}


def test_short_items_and_repeats(spark):
    got = found(spark, [(1, "x one two three four five y"), (1, "x one two three four five y"), (2, "one two three four")], [(7, "One two, three four five.")])
    assert got == {(1, 7, "verbatim")}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    texts = [(i, f"some {i} words before " + ITEM + f" {i} after") for i in range(8)]
    want = found(spark, texts, [(1, ITEM)])
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert found(spark, texts, [(1, ITEM)]) == want and len(want) == 8


def test_clean_documents_stay_as_they_are(spark):
    docs = spark.createDataFrame([(1, ITEM, "a", 0), (2, None, "b", 0), (3, "clean words", "c", 0), (3, "clean words", "c", 0)], "doc_id long, text string, _bad string, text_key int")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 3]
    assert D.contaminated(docs.where("false"), bench).count() == 0 and D.contaminated(docs, bench.where("false")).count() == 0


def tokens(text):
    """A plain version of marked_tokens: (word or placeholder, value)."""
    out, last = [], None
    number = rf"(?<![\p{{L}}\p{{N}}_.,])[+-]?\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*(?=(?i:{D._UNIT})?(?![\p{{L}}\p{{N}}]))"
    unit = rf"(?i:{D._UNIT})(?![\p{{L}}\p{{N}}])"
    for m in regex.finditer(rf"(?P<name>(?<![\p{{L}}\p{{N}}])\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}'’-]*)|(?P<number>{number})|(?P<word>[\p{{L}}\p{{N}}\p{{M}}]+)", text):
        kind, value = m.lastgroup, m[0]
        gap = text[last : m.start()] if last is not None else None
        if kind == "name" and out and out[-1][0] == "name" and gap == " ":
            out[-1] = ("name", out[-1][1] + " " + value.lower())
        elif out and out[-1][0] == "number" and gap is not None and (gap == "" or gap.isspace()) and regex.fullmatch(unit, value):
            out.append(("unit", value.lower()))
        else:
            out.append((kind, value.lower()))
        last = m.end()
    return out


def plain(docs, items):
    """Every window of an item against every place of a document."""
    got = set()
    for item, text in items:
        own = tokens(text)
        forms = [own, [y for k, v in own for y in ([("word", w) for w in regex.findall(r"[\p{L}\p{N}\p{M}]+", v)] if k == "name" else [(k, v)])]]
        for doc, body in docs:
            has = tokens(body or "")
            kinds = [v if k == "word" else f"<{k}>" for k, v in has]
            need, hits = None, defaultdict(set)
            for form in forms:
                size = min(len(form), D.WINDOW)
                template = [v if k == "word" else f"<{k}>" for k, v in form]
                if size < D.LEAST_WORDS and len(has) != size:
                    continue
                for i in range(len(form) - size + 1):
                    for p in range(len(has) - size + 1):
                        if kinds[p : p + size] == template[i : i + size]:
                            for g in ((0, p - i), (1, (p - i + 2) // 4), (2, (p - i + 4) // 4)):
                                hits[g].add((i, p - i, size, any(k != "word" for k, _ in form[i : i + size]), len(form)))
            for ws in hits.values():
                need = min(D.COVERED, -(-max(n for *_, n in ws) * 3 // 4))
                cover = {i + x for i, _, size, _, _ in ws for x in range(size)}
                free = {i + x for i, _, size, slot, _ in ws if not slot for x in range(size)}
                pairs = set()
                for i, d, size, _, _ in ws:
                    for x in range(i, i + size):
                        if x < len(own) and own[x][0] != "word" and has[x + d][0] != "word":
                            a, b = own[x], has[x + d]
                            if (x == 0 and b[1].endswith(" " + a[1])) or (x == len(own) - 1 and b[1].startswith(a[1] + " ")):
                                b = a
                            pairs.add((a, b))
                names = [b for a, b in pairs if a[0] == "name"]
                consistent = len({a for a, _ in pairs}) == len(pairs) and len(set(names)) == len(names)
                if len(cover) >= need and (len(free) >= need or consistent):
                    got.add((doc, item))
    return got


def test_documents_as_by_comparing_every_window(spark):
    """On the given tables, and on items with other values, cut and mixed."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    docs, bench = (duckdb.sql(f"select * from '{sf}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    docs, items = [(r[0], r[1]) for r in docs], [(r[0], r[1]) for r in bench]
    rng = random.Random(5)
    subjects, units = ["Anna", "Ben", "Mary Ann", "Clara", "O'Neil"], ["km", "kg", "hours"]
    make = lambda: "{0} walks {1} {4} with {2} and then {3} more. How far did {0} go before {2} came back home?".format(*rng.sample(subjects, 1), rng.randrange(9), *rng.sample(subjects, 1), rng.randrange(9), rng.choice(units))
    items = items[:12] + [(1000 + i, make()) for i in range(4)]
    mine = [(5000 + i, " ".join(rng.choice(["Then", "some", "words. More", "3", "Robert"]) for _ in range(5)) + " " + make() + " end") for i in range(40)]
    mine += [(6000 + i, rng.choice(items)[1].upper() if i % 2 else " ".join(rng.choice(items)[1].split()[: rng.randrange(3, 20)])) for i in range(30)]
    docs = docs[:120] + mine
    got = {(i, j) for i, j, _ in found(spark, docs, items)}
    want = plain(docs, items)
    assert got == want and len({i for i, _ in want if i >= 5000}) > 10
    assert {(i, j) for i, t in docs for j, x in items if x.lower() in t.lower()} <= got
