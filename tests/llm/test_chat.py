import hashlib

from coverscope.llm import chat
from coverscope.llm.queries import ORACLES, QUERIES
from tests.oracle import same


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|> é"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (2, 0, "system", "alone"), (None, None, None, "x")]
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotated(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = got[(1, "ann")]
    assert ann["text"].startswith("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi < |im_end|> é<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n")
    spans = [tuple(map(int, s.split(":"))) for s in ann["train_spans"].split(",")]
    assert [ann["text"][a:b] for a, b in spans] == ["Hi < |im_end|> é<|im_end|>", "Bye<|im_end|>"] and ann["n_messages"] == 4
    assert got[(None, "unknown")]["part"] == 0 and got[(None, "unknown")]["train_spans"] == "22:33"


def plain(rows, perspective):
    """The whole rendering of one dialogue and its spans."""
    text, spans = "", []
    for _, _, role, body in sorted({(t is not None, t or 0, r, b) for _, t, r, b in rows}, key=lambda x: (x[0], x[1], hashlib.md5(f"{x[2]}\n{x[3]}".encode()).hexdigest())):
        text += "<|im_start|>" + ("assistant" if role == perspective else "system" if role == "system" else f"user name={role}") + "\n"
        if role == perspective:
            spans.append(f"{len(text)}:{len(text) + len(body) + 10}")
        text += body + "<|im_end|>\n"
    return text, ",".join(spans)


def test_a_long_or_crowded_dialogue_is_one_rendering_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "CROWD", 300)
    rows = [(1, i, "ab"[i % 2], f"m{i} é") for i in range(-300, 600)] + [(1, None, "a", f"null {i}") for i in range(700)] + [(1, 300, "b", f"crowd {i}") for i in range(900)]
    rows += [(2, 5, "system", "s"), (2, 1, "c", "x")]
    got = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    for p in "ab":
        parts = sorted((r for r in got if (r["conv_id"], r["perspective"]) == (1, p)), key=lambda r: r["part"])
        assert [r["part"] for r in parts] == list(range(len(parts))) and len(parts) > 6 and max(r["n_messages"] for r in parts) < 600
        assert ("".join(r["text"] for r in parts), ",".join(r["train_spans"] for r in parts if r["train_spans"])) == plain([r for r in rows if r[0] == 1], p)
        assert [r["start"] for r in parts] == [sum(len(x["text"]) for x in parts[:i]) for i in range(len(parts))]
    assert len([r for r in got if r["conv_id"] == 2]) == 1
    assert chat.rotated(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_query_is_as_its_sql(spark):
    same(spark, "/root/testdata/sf0.001", QUERIES["op9_chat_rotation"], ORACLES["op9_chat_rotation"])
