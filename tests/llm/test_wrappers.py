import time

from pyspark.sql import functions as F

from coverscope.llm import wrappers as W


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="post"><header><a href="/">Site</a></header>
<nav><ul><li><a href="?id=3&class=ad">{title[:3]}</a></li><li><a href="/b">B</a></li></ul></nav><!-- x --><div class="cookie-bar">Cookies!</div><div class="ad">Buy {title}</div>
<article><h1>{title}</h1>{body}<div class="box">Read us daily</div>{extra}<form><label>Mail</label></form></article><aside>About {title}</aside>
<section id="comments"><article class="comment"><p>I disagree with {title}, and at length, so that this is longer than the article.</p></article></section><footer>&copy; {title}</footer></body></html>"""


def host(pages):
    """What several pages have in common, plainly."""
    wrapper, seen = None, {}
    for p in sorted(set(pages)):
        root = W.parse(p)
        wrapper = W.inferred(wrapper, W.folded(root))
        W.add_places(seen, W.places(root))
    return W.Host(wrapper, {k for k, n in seen.values() if n >= W.LEAST_PAGES and k != W.VARIES}, len(set(pages)))


def test_article_without_what_is_around_it():
    pages = [page(f"Title {i}", [f"First of {i}.", f"Second &amp; last {i}"][: 1 + i % 2]) for i in range(6)]
    own = host(pages)
    assert W.main_text(pages[1], own) == "Title 1\nFirst of 1.\nSecond & last 1"
    assert W.main_text(pages[2], own) == "Title 2\nFirst of 2."


def test_what_pages_share_is_told_only_from_several():
    one = page("T", ["a"])
    assert W.main_text(one, host([one])) == "T\na\nRead us daily"


def untold(i, body):
    """A page whose tags and names don't say where the article is; longer texts of the host than the article's."""
    return f"""<body><div><div>Daily of the town, founded long ago and read by many people in it every day of the week</div><div>Today: {i} degrees</div>
<div><div><h1>Title {i}</h1>{body}</div></div><div><div>About us: we are a paper of the town and write of what happens in it, as we have done for years and years, and will.</div></div></div></body>"""


def test_the_wrapper_tells_the_article_where_the_page_does_not():
    long = "".join(f"<p>Paragraph {{0}} {j} of a long article that tells of many things that happened.</p>" for j in range(8))
    pages = [untold(i, long.replace("{0}", str(i))) for i in range(7)]
    short = untold(9, "<p>Little to tell.</p>")
    own = host([*pages, short])
    assert W.main_text(short, own) == "Title 9\nLittle to tell."
    assert W.main_text(pages[3], own) == "\n".join(["Title 3", *[f"Paragraph 3 {j} of a long article that tells of many things that happened." for j in range(8)]])
    # From the page alone it can't be told.
    assert W.main_text(short, None) != "Title 9\nLittle to tell." and "About us" in W.main_text(short, None)


def test_articles_that_are_only_teasers_are_not_taken_for_the_article():
    pages = [f"<body><div><section><article><h3>Other {i}</h3></article><article><h3>More {i}</h3></article></section><div><h1>T{i}</h1><p>The text of page {i} is here, and it's much longer than teasers are.</p></div></div></body>" for i in range(5)]
    assert W.main_text(pages[2], host(pages)) == "T2\nThe text of page 2 is here, and it's much longer than teasers are."


def test_a_section_of_few_pages_has_fixed_texts_too():
    usual = [f"<body><article><h1>U{i}</h1><p>Usual text {i} of a page, long enough.</p></article></body>" for i in range(300)]
    section = [f"<body><article><h1>S{i}</h1><p>Sport text {i} of a page, long enough.</p><div>All about sports here</div></article></body>" for i in range(4)]
    assert W.main_text(section[1], host([*usual, *section])) == "S1\nSport text 1 of a page, long enough."


def test_no_paragraph_of_an_article_is_lost_by_its_names():
    texts = [f"""<body><article><h1>T{i}</h1><p class="more">More of {i} is told here.</p><section class="related work"><h2>Related work</h2><p>Others wrote of {i} before.</p></section>
<div class="related"><a href=1>Read this {i}</a> <a href=2>and that</a></div><p class="ad">Buy {i}</p></article></body>""" for i in range(2)]
    assert W.main_text(texts[1], host(texts)) == "T1\nMore of 1 is told here.\nRelated work\nOthers wrote of 1 before."
    text = '<main><section class="related work"><p>One</p></section><p class="popular">Two</p></main><div class="related"><p>Out</p></div>'
    assert W.main_text(text) == "One\nTwo"


def test_what_one_page_alone_has_is_not_fixed_by_its_host():
    plain = [f"<body><article><h1>T{i}</h1><p>Text of page {i}, which is long enough to count.</p><div class=box>Read us daily</div></article></body>" for i in range(6)]
    only = "<body><article><h1>Own</h1><p>Its first paragraph is of a usual length.</p><blockquote>Quoted once</blockquote><p>Last words</p><ul><li>One item</li></ul><div class=box>Read us daily</div></article></body>"
    own = host([*plain[:3], only, *plain[3:]])
    assert W.main_text(only, own) == "Own\nIts first paragraph is of a usual length.\nQuoted once\nLast words\nOne item"
    assert W.main_text(plain[5], own) == "T5\nText of page 5, which is long enough to count."


def test_wrapper_has_slots_options_and_groups():
    pages = ["<div><p>a</p><p>b</p></div><i></i>", "<div><p>c</p></div><h2>x</h2>", "<div><p>d</p><p>e</p><p>f</p></div>"]
    items = host(pages).wrapper[W.ITEMS]
    assert items[0][:2] == ["div", ""] and [x[:5] for x in items[0][W.ITEMS]] == [["p", "", True, False, [None]]] and items[0][W.PAGES] == 3
    assert items[1][0] == "h2" and items[1][W.OPTIONAL] and items[1][W.PAGES] == 1


def test_long_sequences_are_aligned(monkeypatch):
    monkeypatch.setattr(W, "ALIGNED", 8)
    tags = [f"x{i}" for i in range(60)]
    make = lambda skip: W.folded(W.parse("".join(f"<{t}>text</{t}>" for t in tags if t not in skip)))
    got = W.inferred(make({"x7", "x30"}), make({"x3", "x44", "x45"}))[W.ITEMS]
    assert [x[0] for x in got] == tags and {x[0] for x in got if x[W.OPTIONAL]} == {"x3", "x7", "x30", "x44", "x45"}


def test_deep_and_broken_pages_take_time_by_their_length():
    began = time.perf_counter()
    deep = "<div>" * 10_000 + "a<nav>menu</nav><p>b</p>c" + "</div>" * 10_000
    assert W.main_text(deep, host([deep] + [deep.replace("b", f"b{i}") for i in range(4)])).split("\n") == ["a", "b", "c"]
    for bad in ("<a '" * 250_000, "<a \"'" * 200_000, "<p x=\"" * 140_000 + ">", "<span class=ad>" * 60_000, "<li>" * 100_000 + "</ul>" * 100_000, "<" * 10**6, "<!--" * 10**5, "<div a" + " " * 10**6 + ">x</div>"):
        W.main_text(bad, host([bad]))
    assert time.perf_counter() - began < 40


def test_pages_without_an_article_element():
    text = """<body><div><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>Big title</h1><p>Text one is here and&nbsp;long   enough.</p><p>Two<br>lines &#8211; unclosed <b>bold<p>Three</div></div><div><p><a href=3>More</a></p></div></body>"""
    assert W.main_text(text, None) == "Big title\nText one is here and long enough.\nTwo lines – unclosed bold\nThree"
    assert [W.main_text(x, None) for x in ("", "plain text", "<p>", "<script>x")] == ["", "plain text", "", ""]


def test_rows_broadcast_or_joined(spark, monkeypatch):
    rows = [(i, f"https://h{i % 3}.example/{i}", page(f"Title {i}", [f"Some words of {i}"])) for i in range(12)] + [(None, None, None), (50, "", ""), (3, "https://h0.example/3", page("Title 3", ["Some words of 3"]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in W.extracted(pages).collect())
    assert ("None", "", 0) in got and ("50", "", 0) in got and ("7", "Title 7\nSome words of 7", 23) in got and len(got) == 15
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in W.extracted(pages).collect()) == got
    assert W.extracted(pages.where("false")).count() == 0


def blocks_of_article(h):
    import html
    import re

    inner = h[h.index("<article>") : h.index("</article>")].replace("<br>", " ")
    return "\n".join(x for b in re.split(r"</?(?:p|h1)[^>]*>", inner) if (x := " ".join(html.unescape(re.sub("<[^>]*>", "", b)).split())))


def test_given_pages_whole_hosts(spark):
    """Every page of every host, extracted with its host's wrapper, is the blocks of its article: none is lost, none added."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r["page_id"]: blocks_of_article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in W.extracted(pages).collect()}
    assert len(got) == 2500 and got == want


def test_paragraphs_that_pages_share_stay(spark):
    shared = ["Released under the MIT License.", "The same sentence in several articles."]
    texts = [f"<body><nav>Menu</nav><article><h1>T{i}</h1><p>Text {i} is long enough to be the most of it.</p><p>{shared[i % 2]}</p><ul><li>Same item</li></ul><div class='box'>Read us daily</div></article></body>" for i in range(12)]
    pages = spark.createDataFrame([(i, "https://h.example/x", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    for r in W.extracted(pages).collect():
        i = r["page_id"]
        assert r["text"] == f"T{i}\nText {i} is long enough to be the most of it.\n{shared[i % 2]}\nSame item"


def test_any_split_gives_the_same_texts(spark, monkeypatch):
    texts = [untold(i, f"<p>Paragraph {i} of the article that tells of many things that happened and will be told.</p>" * (1 + 3 * i)) for i in range(3)]
    rows = [(10 * i + k, "https://h.example/x", t) for i, t in enumerate(texts) for k in range(4)] + [(100 + i, f"https://h{i % 2}.example/", page(f"T{i}", ["a b c"])) for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted(map(tuple, W.extracted(x).collect())) for x in (frame.coalesce(1), frame.repartition(4), frame.repartition(7, "html"), frame.orderBy(F.desc("page_id")))]
    monkeypatch.setattr(W, "KNOWN_PAGES", 1)
    got.append(sorted(map(tuple, W.extracted(frame.repartition(3)).collect())))
    assert all(x == got[0] for x in got)
    # Copies don't make a host's wrapper decide.
    alone = {r[0]: r[2] for r in got[0]}
    assert all(alone[10 * i] == W.main_text(t, None) for i, t in enumerate(texts))


def test_an_article_in_two_siblings_and_items_that_are_links():
    two = "<body><article><h1>A</h1><p>The first half of the story is told in this element.</p></article><article><p>The second half of the story is told in this one.</p></article><article><p><a href=1>Another story that is only linked to from here, at some length</a></p></article></body>"
    assert W.main_text(two) == "A\nThe first half of the story is told in this element.\nThe second half of the story is told in this one."
    items = "<body><div><h1>List</h1><p>Here is what we think of each of these, in order of how good they are to us.</p><ul><li><a href=1>A book with a long title</a></li><li>A film without a link, of which we tell more here than of the book</li></ul></div></body>"
    assert W.main_text(items).split("\n")[2:] == ["A book with a long title", "A film without a link, of which we tell more here than of the book"]
