"""HTML extraction: wrappers inferred from pages of a host, as union-free regular expressions over their token streams."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.llm.common import as_texts, partitions
from coverscope.runtime import settle

#: Bytes of all wrappers and fixed texts together up to which they are broadcast; beyond, pages are joined with them by host.
BROADCAST_BYTES = 24_000_000
#: Pages that a task remembers as seen; places that a host's wrappers and pages are dealt to.
KNOWN_PAGES, SALTS = 100_000, 16
#: Distinct pages of a host from which its wrapper decides, and that have a place whose text it fixes.
LEAST_PAGES = 4
#: Stands for the text of a place that has several.
VARIES = -1
#: Nodes of two sequences that are aligned at a time; longer ones go on from the middle of what was aligned.
ALIGNED = 400
#: Levels of elements that are told apart; deeper ones are of their ancestor at this level, with their texts and marks.
DEEP = 64
#: Share of a host's text outside of links that the element has which holds the article, where no tag says so.
HOLDS = 0.7

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split()
)
BOILERPLATE = frozenset("nav footer aside form button select option dialog menu menuitem fieldset legend datalist output progress head".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody"}, "tbody": {"thead", "tbody"},
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Words of class, id and role names that mark what isn't the article wherever they stand; those that mark it outside of the article, and inside where
# its text is links; and parts of words that do.
MARKS = """ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos promotion promoted banner menu nav navbar navigation topnav
    breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar cookie cookies consent gdpr notice notices
    popup modal overlay lightbox newsletter subscribe subscription signup signin share sharing comment comments commentlist disqus replies reply respond
    responses discussion pagination pager paywall complementary contentinfo hidden form forms""".split()
WEAK = """side rail secondary foot privacy alert alerts warning announcement announcements flash login search social follow related recommended recommendations trending
    popular latest teaser teasers more reactions feedback skip copyright legal disclaimer tags toc""".split()
PARTS = "sidebar comment cookie advert sponsor newsletter breadcrumb navbar navigation footer submenu dropdown disqus".split()
MAINS = "article main content post entry story body text articlebody".split()

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are of a text, never what holds an article.
TEXTS = HEADINGS | frozenset("p blockquote pre li dt dd td th figcaption".split()) | INLINE
_OPEN = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_TAG = re.compile(r"<[^>]*>")
_NAMED = frozenset("class id role itemprop".split())
_MARKED = re.compile(rf"(?<![a-z])(?:{'|'.join(MARKS)})(?![a-z])|{'|'.join(PARTS)}")
_WEAK = re.compile(rf"(?<![a-z])(?:{'|'.join(WEAK)})(?![a-z])")
_MAIN = re.compile(rf"(?<![a-z])(?:{'|'.join(MAINS)})(?![a-z])")
_HEADER = re.compile(r"(?<![a-z])header(?![a-z])")


class Node:
    """A node of a page's tree: an element with the text blocks and elements in it, in order."""

    __slots__ = ("tag", "names", "items", "links", "gone", "kind", "path")

    def __init__(self, tag: str, names: str, parent: Node | None) -> None:
        self.tag, self.names = tag, names
        self.items: list[Node | str] = []
        self.links = 0  # characters of text in links right here
        inside = parent is not None and parent.kind != ""
        self.gone = parent is not None and parent.gone or marked(tag, names, inside)
        #: "article" or "main" in an element that a tag says to be such, "named" in one whose names do; the outermost one's.
        self.kind = parent.kind if inside else "" if self.gone or tag in ("html", "body") else tag if tag in ("article", "main") else "named" if _MAIN.search(names) else ""
        self.path = 0 if parent is None else xxhash.xxh64_intdigest(f"{tag}.{names}", parent.path)

    def part(self) -> Node:
        own = Node.__new__(Node)
        own.tag, own.names, own.items, own.links, own.gone, own.kind, own.path = self.tag, self.names, [], 0, self.gone, self.kind, self.path
        return own


def marked(tag: str, names: str, inside: bool) -> bool:
    """Whether an element isn't of the article by its tag or names. A header inside the article is the article's own, as is what WEAK names are on."""
    if tag in ("html", "body", "", "article"):
        return tag == "article" and bool(_MARKED.search(names))
    if not inside and (tag == "header" or _HEADER.search(names) or _WEAK.search(names)):
        return True
    return tag in BOILERPLATE or bool(_MARKED.search(names))


def _tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name in lower case or "", attributes, whether it ends an element) of each tag and comment, in time that grows with the page's length.

    Quotes hide a ">" until one isn't closed; after that a tag ends with the next ">". A tag without one is text.
    """
    at, quotes = 0, True
    while m := _OPEN.search(page, at):
        start = m.start()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", "", False
            continue
        if page[start + 1] in "!?":
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
            yield start, at, "", "", False
            continue
        name = _NAME.match(page, start)
        rest = _REST.match(page, name.end()) if quotes else None
        if rest is None:
            quotes = False
            end = page.find(">", name.end())
            if end < 0:
                return
        else:
            end = rest.end() - 1
        at = end + 1
        yield start, at, name[1].lower(), page[name.end() : end], page[start + 1] == "/"


def parse(page: str) -> Node:
    """The block elements of a page and the texts in them; inline elements are part of the text, raw ones and comments are dropped.

    Nothing is called for each level, and the work grows with the page's length.
    """
    root = Node("", "", None)
    stack: list[tuple[str, Node]] = [("", root)]
    opened: Counter = Counter()
    run: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            node = stack[-1][1]
            if len(stack) > DEEP:  # a part of it, in its place in the ancestor at this level
                node = node.part()
                stack[DEEP - 1][1].items.append(node)
            node.items.append(text)
            node.links += min(linked, len(text))
        linked = 0

    def pop(to: int) -> None:
        for tag, _ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]

    at, no_end = 0, set()
    for start, end, tag, attributes, ends in _tags(page):
        if start < at:  # in a raw element
            continue
        piece = page[at:start]
        run.append(piece)
        if in_link:
            linked += len(piece)
        at = end
        if not tag:
            continue
        if ends:
            if tag == "a":
                in_link = 0
            if tag not in INLINE:
                flush()
                if opened[tag]:
                    to = len(stack) - 1
                    while stack[to][0] != tag:
                        to -= 1
                    pop(to)
            elif opened[tag]:  # a marked inline element may end here
                to = len(stack) - 1
                if stack[to][0] == tag:
                    flush()
                    pop(to)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/") and tag not in no_end:
                found = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                if not found:
                    no_end.add(tag)
                at = found.end() if found else len(page)
            continue
        names = ""
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            if tag == "br":
                run.append(" ")
            names = _names(attributes)
            # An inline element that is marked as something else than text is a node of its own, until its end or that of its block.
            if tag in VOID or not _MARKED.search(names) or attributes.endswith("/"):
                continue
        else:
            names = _names(attributes)
        flush()
        if tag in ENDS_P and stack[-1][0] == "p":
            pop(len(stack) - 1)
        closes = CLOSES.get(tag)
        if closes and any(opened[x] for x in closes):
            stops = ("ul", "ol", "dl", "table", "select", "tr" if tag not in ("tr", "tbody") else "table")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    pop(i)
                    break
                if stack[i][0] in stops:
                    break
        node = Node(tag, names, stack[-1][1])
        if len(stack) < DEEP:
            stack[-1][1].items.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, node))
            opened[tag] += 1
    run.append(page[at:])
    flush()
    return root


def _names(attributes: str) -> str:
    """Class, id and role of an element in lower case, without digits; "hidden" where it is so."""
    if not attributes or attributes.isspace():
        return ""
    found: set[str] = set()
    for key, a, b, c in _ATTR.findall(attributes):
        key = key.lower()
        if key in _NAMED:
            found.update(re.sub(r"\d+", "", (a or b or c).lower()).split())
        elif key == "hidden" or (key == "aria-hidden" and (a or b or c).lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", a or b or c, re.IGNORECASE)):
            found.add("hidden")
    return " ".join(sorted(found))


# A wrapper is a list: [tag, names, repeated, optional, items, pages, characters of text in it that isn't marked as something else, those in links]; its items are
# wrappers, or None for a text slot. That of a host is of its whole pages.
Wrapper = list
TAG, NAMES, REPEATED, OPTIONAL, ITEMS, PAGES, TEXT, LINKS = range(8)


def folded(node: Node) -> Wrapper:
    """A page as a wrapper of its own: neighbours of one kind become a repeated group, texts become slots."""
    items: list = []
    text = 0
    for x in node.items:
        if isinstance(x, str):
            text += len(x)
            if not items or items[-1] is not None:
                items.append(None)
            continue
        own = folded(x)
        last = items[-1] if items else None
        if isinstance(last, list) and _same(last, own):
            items[-1] = [*own[:REPEATED], True, False, aligned(last[ITEMS], own[ITEMS]), 1, last[TEXT] + own[TEXT], last[LINKS] + own[LINKS]]
        else:
            items.append(own)
    return [node.tag, node.names, False, False, items, 1, 0 if node.gone else text, 0 if node.gone else node.links]


def _kinds(w: Wrapper, before: str = "", levels: int = 3) -> set[str]:
    """Of what kinds an element's children are, and their children: tags, and "" of texts."""
    found = set()
    for x in w[ITEMS]:
        here = before + (x[TAG] + "/" if x is not None else "")
        found.add(here)
        if x is not None and levels > 1:
            found |= _kinds(x, here, levels - 1)
    return found


def _node_kinds(node: Node, before: str = "", levels: int = 3) -> set[str]:
    found = set()
    for x in node.items:
        here = before + ("" if isinstance(x, str) else x.tag + "/")
        found.add(here)
        if levels > 1 and not isinstance(x, str):
            found |= _node_kinds(x, here, levels - 1)
    return found


def _same(a: object, b: object) -> bool:
    """Whether two items are one of the wrapper: slots, or elements of a tag and names; those without names by mostly the same kinds of what is in them."""
    if a is None or b is None:
        return a is b
    if a[TAG] != b[TAG] or a[NAMES] != b[NAMES]:
        return False
    if a[NAMES] or a[TAG] in TEXTS:
        return True
    x, y = _kinds(a), _kinds(b)
    return 2 * len(x & y) >= len(x | y)


def aligned(a: list, b: list) -> list:
    """Two sequences as one: what is the same is merged, and what only one has is optional."""
    out: list = []
    while True:
        start = 0
        while start < min(len(a), len(b)) and _same(a[start], b[start]):
            start += 1
        out += [merged(p, q) for p, q in zip(a[:start], b[:start], strict=True)]
        a, b = a[start:], b[start:]
        if not a or not b:
            return out + [_optional(p) for p in [*a, *b]]
        end = 0
        while end < min(len(a), len(b)) and _same(a[-1 - end], b[-1 - end]):
            end += 1
        x, y = a[: min(ALIGNED, len(a) - end)], b[: min(ALIGNED, len(b) - end)]
        part = len(x) + len(y) < len(a) + len(b) - 2 * end
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if _same(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y) and not (part and max(i, j) > ALIGNED // 2):
            if _same(x[i], y[j]):
                out.append(merged(x[i], y[j]))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                out.append(_optional(x[i]))
                i += 1
            else:
                out.append(_optional(y[j]))
                j += 1
        if part:
            a, b = a[i:], b[j:]
            continue
        out += [_optional(p) for p in [*x[i:], *y[j:]]]
        return out + [merged(p, q) for p, q in zip(a[len(a) - end :], b[len(b) - end :], strict=True)]


def _optional(x: object) -> object:
    return [*x[:OPTIONAL], True, *x[ITEMS:]] if isinstance(x, list) else None


def merged(a: object, b: object) -> object:
    """Two elements of different pages as one."""
    if a is None:
        return None
    return [a[TAG], a[NAMES], a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], aligned(a[ITEMS], b[ITEMS]), a[PAGES] + b[PAGES], a[TEXT] + b[TEXT], a[LINKS] + b[LINKS]]


def inferred(wrapper: Wrapper | None, page: Wrapper) -> Wrapper:
    """A wrapper made to fit a page, or another wrapper, of the host too."""
    return page if wrapper is None else merged(wrapper, page)


def places(root: Node) -> dict[int, int]:
    """For each place of a page (its elements, by tags and names) that has text, the number of its text, or VARIES where it has several."""
    found: dict[int, int] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        for x in node.items:
            if isinstance(x, str):
                key = _text_key(node, x)
                place = node.path >> 1
                found[place] = key if found.get(place, key) == key else VARIES
            else:
                todo.append(x)
    return found


def add_places(to: dict[int, list[int]], found: dict[int, int]) -> None:
    """Adds a page's places to those of other pages: [text, pages that have the place] of each. A place whose text differs is a slot of the wrapper (VARIES); else it is fixed."""
    for place, key in found.items():
        own = to.setdefault(place, [key, 0])
        own[0] = key if own[0] == key else VARIES
        own[1] += 1


def _text_key(node: Node, text: str) -> int:
    return xxhash.xxh64_intdigest(text, node.path) >> 1


def _weight(w: Wrapper) -> int:
    """Characters of text outside of links in an element, of all its pages."""
    return max(0, w[TEXT] - 2 * w[LINKS]) + sum(_weight(x) for x in w[ITEMS] if isinstance(x, list))


def _tagged(w: Wrapper) -> int:
    """The same of what is in <article> or <main>."""
    return _weight(w) if w[TAG] in ("article", "main") else sum(_tagged(x) for x in w[ITEMS] if isinstance(x, list))


class Host:
    """What a host's pages have in common: its wrapper, inferred from all its distinct pages, their number, and the texts that it fixes."""

    def __init__(self, wrapper: Wrapper, fixed: set[int], pages: int) -> None:
        self.wrapper, self.fixed = wrapper, fixed
        self.decides = pages >= LEAST_PAGES
        total = _weight(wrapper)
        #: Whether tags say where the article is: they do where they hold half of the text at least.
        self.tagged = 2 * _tagged(wrapper) >= total
        #: Else the innermost element that holds HOLDS of it.
        self.holder = wrapper
        while below := [x for x in self.holder[ITEMS] if isinstance(x, list) and not x[REPEATED] and x[TAG] not in TEXTS and total and _weight(x) >= HOLDS * total]:
            self.holder = below[0]


def _fits(node: Node, items: list) -> Iterator[tuple[Node | str, object]]:
    """The items of a page's node, each with the wrapper's item that it fits, or None."""
    at = 0
    kinds: dict[int, set[str]] = {}
    for x in node.items:
        fit = None
        if not isinstance(x, str):
            own = None
            for k in range(at, len(items)):
                if items[k] is not None and items[k][TAG] == x.tag and items[k][NAMES] == x.names:
                    if not x.names and x.tag not in TEXTS:
                        if k not in kinds:
                            kinds[k] = _kinds(items[k])
                        own = own or _node_kinds(x)
                        if 2 * len(kinds[k] & own) < len(own):
                            continue
                    fit, at = items[k], k if items[k][REPEATED] else k + 1
                    break
        yield x, fit


def _blocks(root: Node, host: Host | None) -> list:
    """A page's blocks (text, node, nodes around it, whether in the host's holder), in page order."""
    blocks: list = []
    todo = [(iter(_fits(root, host.wrapper[ITEMS] if host else [])), root, (root,), host is not None and host.holder is host.wrapper)]
    while todo:
        each, node, trail, held = todo[-1]
        for x, fit in each:
            if isinstance(x, str):
                blocks.append((x, node, trail, held))
            else:
                todo.append((iter(_fits(x, fit[ITEMS] if fit else [])), x, (*trail, x), held or (fit is not None and host is not None and fit is host.holder)))
                break
        else:
            todo.pop()
    return blocks


def _of_links(node: Node) -> bool:
    """Whether an element's text is links for the most part."""
    text = links = 0
    todo = [node]
    while todo:
        x = todo.pop()
        links += x.links
        for y in x.items:
            if isinstance(y, str):
                text += len(y)
            else:
                todo.append(y)
    return 2 * links > text


def main_text(page: str, host: Host | None = None) -> str:
    """The article of a page: its blocks that are neither marked as something else nor fixed by the host.

    Where the host has LEAST_PAGES, its wrapper says what is fixed, which is what stands around its slots, and which element holds the article: <article> or <main>, where these hold most of the
    host's text, or else the element that does. Of a host with fewer pages that is told from the page alone: the <article> with the most
    text, else <main>, else an element that is named so, else the one that holds most text outside of links.
    """
    root = parse(page)
    decides = host is not None and host.decides
    blocks = _blocks(root, host if decides else None)
    of_links: dict[int, bool] = {}

    def linked(node: Node) -> bool:
        if id(node) not in of_links:
            of_links[id(node)] = bool(_WEAK.search(node.names)) and _of_links(node)
        return of_links[id(node)]

    live = [b for b in blocks if not b[1].gone and not any(linked(n) for n in b[2])]

    def unfixed(some: list, article: bool = False) -> list:
        """Without what the host fixes, unless it is so much that the pages are copies. A heading may be the article's own though several pages have it, and so may, in what tags say is the article,
        any paragraph, list item, quotation and the like: only texts of plain boxes go there."""
        own = [b for b in some if b[1].tag in HEADINGS or (article and b[1].tag in TEXTS) or _text_key(b[1], b[0]) not in host.fixed] if decides else some
        return own if 2 * sum(len(b[0]) for b in own) >= sum(len(b[0]) for b in some) else some

    if decides and not host.tagged and (held := [b for b in live if b[3]]):
        return "\n".join(b[0] for b in unfixed(held))
    for kind in ("article", "main") if decides else ("article", "main", "named"):
        sizes: Counter = Counter()
        outer = [next((n for n in b[2] if n.kind == kind), None) for b in live]
        for b, n in zip(live, outer, strict=True):
            if n is not None:
                sizes[id(n)] += len(b[0])
        nodes = {id(n): n for n in outer if n is not None}
        if told := {k: n for k, n in sizes.items() if not _of_links(nodes[k])}:
            sizes = Counter(told)
        if sizes:
            best = max(sizes.values())
            # Parts of one article can be siblings; small ones beside it, and those that are links for the most part, are teasers.
            beside = {id(x) for b in live for parent in b[2] if any(isinstance(x, Node) and sizes[id(x)] == best for x in parent.items) for x in parent.items if isinstance(x, Node)}
            keep = {k for k, n in sizes.items() if n == best or (4 * n >= best and (kind != "article" or (2 * n >= best and k in beside)))}
            return "\n".join(b[0] for b in unfixed([b for b, n in zip(live, outer, strict=True) if n is not None and id(n) in keep], True))
    live = unfixed(live)
    if not live:
        return ""
    links = lambda b: b[1].links * len(b[0]) / max(1, sum(len(x) for x in b[1].items if isinstance(x, str)))
    weights: Counter = Counter()
    total = 0.0
    for b in live:
        own_weight = max(0.0, len(b[0]) - 2 * links(b))
        total += own_weight
        for depth, n in enumerate(b[2]):
            weights[depth, id(n)] += own_weight
    deepest = [k for k, n in weights.items() if n >= HOLDS * total]
    if deepest and total:
        key = max(deepest)[1]
        live = [b for b in live if any(id(n) == key for n in b[2])] or live
    # A list item that is a link stays if its list isn't one of links.
    return "\n".join(b[0] for b in live if links(b) < 0.7 * len(b[0]) or b[1].tag == "p" or b[1].tag in HEADINGS or (b[1].tag in TEXTS and len(b[2]) > 1 and not _of_links(b[2][-2])))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))


def _source(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, host, page): host and page are hashes; equal pages of a host have one number."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.withColumn("host", F.xxhash64(host_of(F.col("url")))).withColumn("page", F.xxhash64("host", F.coalesce("html", F.lit(""))))


def _distinct(source: DataFrame) -> DataFrame:
    """(host, salt, page, html), by host and salt in order of page: the distinct pages of each host, in SALTS places. Copies in a task are left out before they are sent."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            new = []
            for i, page in enumerate(batch.column(1).to_pylist()):
                if page not in known:
                    known.add(page)
                    new.append(i)
            if len(known) >= KNOWN_PAGES:
                known.clear()  # what comes twice then is left out below
            yield batch.take(pa.array(new, pa.int64()))

    own = source.select("host", "page", F.pmod("page", F.lit(SALTS)).cast("int").alias("salt"), "html").mapInArrow(once, "host long, page long, salt int, html string")
    return own.repartition(partitions(source.sparkSession), "host", "salt").sortWithinPartitions("host", "salt", "page").select("host", "salt", "page", "html")


def _observed(source: DataFrame) -> DataFrame:
    """(host, salt, wrapper, place, key, pages): for each host and salt a row with the wrapper of its pages as JSON and their number, and a row for each place of text."""
    types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, page_before, own, found, n = None, None, None, {}, 0

        def rows() -> pa.RecordBatch:
            out = [(*last, json.dumps(own), None, None, n), *((*last, None, place, key, m) for place, (key, m) in found.items())] if last else []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names=["host", "salt", "wrapper", "place", "key", "pages"])

        for batch in batches:
            for host, salt, page, text in zip(*(batch.column(i).to_pylist() for i in range(3)), as_texts(batch.column(3)), strict=True):
                if (host, salt) != last:
                    if last:
                        yield rows()
                    last, page_before, own, found, n = (host, salt), None, None, {}, 0
                if page == page_before:
                    continue
                page_before, n = page, n + 1
                root = parse(text)
                own = inferred(own, folded(root))
                add_places(found, places(root))
        yield rows()

    return _distinct(source).mapInArrow(look, "host long, salt int, wrapper string, place long, key long, pages long")


def hosts(source: DataFrame) -> DataFrame:
    """(host, wrapper, pages, fixed): each host's wrapper as JSON, of all its distinct pages, their number, and the keys of the texts that it fixes, which LEAST_PAGES of them have at a place where no page has another.

    Wrappers of a host's salts are aligned in their order, so it doesn't matter how the table is split.
    """
    observed = settle(_observed(source))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, n = None, None, 0
        for batch in batches:
            done = []
            for host, text, pages in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if host != last:
                    if own is not None:
                        done.append((last, json.dumps(own), n))
                    last, own, n = host, None, 0
                own, n = inferred(own, json.loads(text)), n + pages
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["host", "wrapper", "pages"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([json.dumps(own)], pa.string()), pa.array([n], pa.int64())], names=["host", "wrapper", "pages"])

    some = observed.where("wrapper is not null").repartition(partitions(source.sparkSession), "host").sortWithinPartitions("host", "salt").select("host", "wrapper", "pages")
    found = some.mapInArrow(align, "host long, wrapper string, pages long")
    each = observed.where("place is not null").groupBy("host", "place").agg(F.min("key").alias("key"), F.max("key").alias("most"), F.sum("pages").alias("n"))
    fixed = each.where((F.col("n") >= LEAST_PAGES) & (F.col("key") == F.col("most")) & (F.col("key") != VARIES))
    return found.join(fixed.groupBy("host").agg(F.collect_list("key").alias("fixed")), "host", "left")  # places of a template


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages: the main text of the whole html.

    Blocks go in page order, joined by line breaks; white space in a block is one blank. A null html counts as empty, whose text is empty; a null url
    is of the host "", whose pages share a wrapper. Very long and very deep pages are taken whole, in time that grows with their length: of over ALIGNED nodes in an element wrappers are aligned a part at a time, and elements
    below DEEP levels are of their ancestor there. Repeated rows each come back, rows with a null id too, and neither they nor how the table is split change what a host's wrapper is. Other columns aren't
    read; an empty table gives no rows.

    What several pages of a host share stays in an article that tags show, but for texts of plain boxes at a place where all pages have the same.
    """
    source = _source(pages, id_col, url_col, html_col)
    found = settle(hosts(source))
    size = found.agg(F.sum(F.length("wrapper") + 100 + 8 * F.coalesce(F.size("fixed"), F.lit(0)))).first()[0] or 0
    schema = "page_id long, url string, text string, n_chars long"

    def result(ids: list[int], urls: list[str], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["wrapper"], r["fixed"] or (), r["pages"]) for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read: dict[int, Host] = {}
            for batch in batches:
                texts = []
                for host, page in zip(batch.column(3).to_pylist(), as_texts(batch.column(2)), strict=True):
                    if host not in read:
                        wrapper, fixed, n = sent.value[host]
                        read[host] = Host(json.loads(wrapper), set(fixed), n)
                    texts.append(main_text(page, read[host]))
                yield result(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts)

        return source.select("page_id", "url", "html", "host").mapInArrow(run, schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            for page_id, url, page, wrapper, fixed, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if wrapper is not None:
                    own = Host(json.loads(wrapper), set(fixed or ()), n)
                else:
                    out.append((page_id, url, main_text(page or "", own)))
            yield result([r[0] for r in out], [r[1] for r in out], [r[2] for r in out])

    # A host's wrapper goes once to each of its places, ahead of the pages there.
    none = lambda kind: F.lit(None).cast(kind)
    ahead = found.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("order"), none("long").alias("page_id"), none("string").alias("url"), none("string").alias("html"), "wrapper", "fixed", "pages")
    spread = F.pmod(F.xxhash64("page", F.coalesce("page_id", F.lit(0))), F.lit(SALTS)).cast("int")
    rows = source.select("host", spread.alias("salt"), F.lit(1).alias("order"), "page_id", "url", "html", none("string").alias("wrapper"), none("array<long>").alias("fixed"), none("long").alias("pages"))
    sent = ahead.unionAll(rows).repartition(partitions(pages.sparkSession), "host", "salt").sortWithinPartitions("host", "salt", "order")
    return sent.select("page_id", "url", "html", "wrapper", "fixed", "pages").mapInArrow(each, schema)
