"""Main-text extraction with induced wrappers (operator 1).

A page is a stream of tag and text tokens. Pages of one host are aligned to a wrapper, a union-free
regular expression over such tokens: ``merge`` walks expressions side by side, aligns the tags that
both have, makes what only one has an optional group, folds neighbours of the same form into a repeated
group, and turns texts that differ into a text slot. The merge takes pages or wrappers, so a task folds
the pages of a host that it reads into one wrapper and wrappers of a host are then merged; a hot host
sends one row for each task, not its pages. Nothing recurses, and an alignment takes memory in
proportion to its two lists.

``roles`` decides by the host's wrapper alone what is text of the article:

* A slot weighs what its texts have in characters outside links. A text that is one and the same on
  three different pages or more is constant and weighs nothing; copies of a page are one page.
* Elements that are by definition no part of an article (nav, footer, aside, form and the like) and
  containers whose names say so (comments, advert, sidebar and the like) are out, unless they hold the
  page's title or an article element.
* The region is the article element, or else the main element, if it holds half of the weight or more.
  If not, the wrapper is walked down from the page to the one child that holds the content: as long as
  what stands beside it has hardly any weight and no title.
* Words that also name parts of an article (social, alert, related and the like) put a container out only
  where its slots agree, or a host has too few pages to tell.
* Groups of links that repeat are out, and in a region without a name of its own constant texts are too. The
  header of an article keeps its title and what varies between pages.

Applied to each page, what is left of the region becomes blocks.

Defined results: null and empty html give an empty text; a page without the region of its host's
wrapper is extracted by the wrapper that it makes alone; a null url or one without host has the host
"" (one wrapper); repeated pages give repeated rows; unclosed or cut-off markup is closed where the
page ends; an empty table gives an empty table. Input columns named like output columns are replaced.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import add_columns, materialise, shielded, table

#: Wrappers of at most so many bytes are broadcast; beyond that pages are joined to them.
BROADCAST_BYTES = 32_000_000
#: Hosts that a task folds at once.
HOSTS_HELD = 2_000
MERGED_AT_ONCE = 16
MERGE_FAN = 32

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|math)\b(?P<rawattr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag that ends an open element of the first kind, unless one of the second kind lies between.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BOILER_TAGS = frozenset("head nav header footer aside form script style noscript template iframe svg math select button menu dialog textarea".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner banners promo promos promotion sponsor sponsored sponsors nav navbar navigation menu menus "
    "sidebar sidebars rail header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies respond disqus "
    "share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe subscription signup login search pagination pager toolbar widget widgets copyright disclaimer skip complementary contentinfo".split()
)
#: Words of those that also name parts of an article: such a name alone decides nothing where the wrapper
#: has seen enough pages to know what the container holds.
SOFT_WORDS = frozenset("alert banner copyright disclaimer header modal notice notices rail recommended related respond search skip social subscription widget widgets".split())
#: A container with a soft name is text of the article if its varying texts are this long on average.
PROSE = 40
#: A name with one of these is about content, whatever else it says.
MAIN_WORDS = frozenset("article articlebody main content post entry story body text".split())
#: Elements of text, whose names do not make them a container of something else.
TEXT_TAGS = frozenset("body html article main p blockquote pre h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody thead figure figcaption address".split())
TITLE_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: So many different pages with one text make it constant.
CONSTANT_PAGES = 3
#: What stands beside the content may weigh this share of it.
BESIDE = 0.05
LINK_SHARE = 0.6
#: Within an article, a place that lists of links share with other text is left as it is.
ONLY_LINKS = 0.95
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BLANK = re.compile(r"\s+")


@dataclass
class Node:
    """An element of a wrapper, with what is known of its own texts: how many, their characters, those
    of them in links, least and greatest hash, and the least numbers of different pages that have one."""

    key: str
    optional: bool = False
    repeated: bool = False
    texts: int = 0
    size: int = 0
    linked: int = 0
    low: int = 0
    high: int = 0
    pages: tuple[int, ...] = ()
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[tuple[int, Node]]:
        """(depth, node) in page order."""
        stack = [(0, self)]
        while stack:
            depth, node = stack.pop()
            yield depth, node
            stack += [(depth + 1, c) for c in reversed(node.children)]

    def dump(self) -> list:
        return [[d, n.key, int(n.optional), int(n.repeated), n.texts, n.size, n.linked, n.low, n.high, list(n.pages)] for d, n in self.walk()]

    @classmethod
    def load(cls, rows: list) -> Node:
        path: list[Node] = []
        for depth, key, optional, repeated, texts, size, linked, low, high, pages in rows:
            node = cls(key, bool(optional), bool(repeated), texts, size, linked, low, high, tuple(pages))
            del path[depth:]
            if path:
                path[-1].children.append(node)
            path.append(node)
        return path[0]

    def constant(self) -> bool:
        return len(self.pages) >= CONSTANT_PAGES and self.low == self.high

    def add_texts(self, other: Node) -> None:
        if other.texts:
            self.low, self.high = (min(self.low, other.low), max(self.high, other.high)) if self.texts else (other.low, other.high)
            self.texts, self.size, self.linked = self.texts + other.texts, self.size + other.size, self.linked + other.linked
            self.pages = tuple(sorted({*self.pages, *other.pages})[:CONSTANT_PAGES])

    def expression(self) -> str:
        """The wrapper as text: ( )? optional, ( )+ repeated, #T a text slot, #C a constant text."""
        out: list[str] = []
        ends: list[str] = []
        for depth, n in self.walk():
            while len(ends) > depth:
                out.append(ends.pop())
            mark = {(True, True): ")*", (True, False): ")?", (False, True): ")+"}.get((n.optional, n.repeated), "")
            out.append((" " if out else "") + ("(" if mark else "") + f"<{n.key}>" + ("" if not n.texts else " #C" if n.constant() else " #T"))
            ends.append(mark)
        return "".join(out + ends[::-1])


def element_key(tag: str, attributes: str) -> str:
    """Tag, class words, id, role and itemprop; digits in them are alike."""
    if not attributes or "=" not in attributes:
        return tag
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    out = tag
    if got.get("class"):
        out += "".join("." + c for c in sorted(set(re.sub(r"\d+", "0", got["class"]).split())))
    for name, sign in (("id", "#"), ("role", "@"), ("itemprop", "$")):
        if got.get(name):
            out += sign + re.sub(r"\d+", "0", re.sub(r"\s", "_", got[name].strip()))
    return out


def events(page: str) -> Iterator[tuple[str, str]]:
    """("open", key), ("close", ""), ("text", raw) and ("break", "") in page order, well nested."""
    stack: list[str] = []
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            yield "text", text
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue  # comment, declaration, script or style
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in stack:
                while True:
                    yield "close", ""
                    if stack.pop() == tag:
                        break
            continue
        if tag in VOID:
            if tag not in ("wbr", "img"):
                yield "break", ("" if tag == "br" else tag)
            continue
        if tag in CLOSES_P and "p" in stack:
            while True:
                yield "close", ""
                if stack.pop() == "p":
                    break
        if tag in SIBLINGS:
            ends, until = SIBLINGS[tag]
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in ends or stack[i] in until), -1)
            if at >= 0 and stack[at] in ends:
                for _ in range(len(stack) - at):
                    yield "close", ""
                del stack[at:]
        yield "open", element_key(tag, m["attr"] or "")
        stack.append(tag)
    for _ in stack:
        yield "close", ""


def parse(page: str | None) -> Node:
    """The page as a wrapper of its own. Inline elements belong to their block."""
    root = Node("#page")
    own = zlib.crc32((page or "").encode("utf-8", "surrogatepass"))
    stack, parts, linked = [root], [[]], [0]
    inline, links = [False], 0
    for kind, value in events(page or ""):
        if kind == "text":
            parts[-1].append(value)
            if links:
                linked[-1] += len(value.strip())
        elif kind == "open":
            tag = tag_of(value)
            inline.append(tag in INLINE)
            links += tag == "a"
            if tag not in INLINE:
                node = Node(value)
                stack[-1].children.append(node)
                stack.append(node)
                parts.append([])
                linked.append(0)
            else:
                inline[-1] = "a" if tag == "a" else True
        elif kind == "close":
            flat = inline.pop()
            links -= flat == "a"
            if not flat:
                _settle(stack.pop(), parts.pop(), linked.pop(), own)
    _settle(root, parts[0], linked[0], own)
    return root


def _settle(node: Node, parts: list[str], linked: int, page: int) -> None:
    text = _BLANK.sub(" ", "".join(parts)).strip()
    if text:
        h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        node.texts, node.size, node.linked, node.low, node.high, node.pages = 1, len(text), min(linked, len(text)), h, h, (page,)
    node.children = _grouped([_Group([c]) for c in node.children])


class _Group(list):
    """Nodes of one form that become one node of the wrapper."""

    def __init__(self, nodes: list[Node], optional: bool = False, repeated: bool = False):
        super().__init__(nodes)
        self.optional, self.repeated = optional, repeated


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: equal ends, then keys that both have once in the longest order
    that both keep, then, between those, the next of each key."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    pairs = [(i, i) for i in range(head)]
    end_a, end_b = len(a) - tail, len(b) - tail
    once_a, once_b = Counter(a[head:end_a]), Counter(b[head:end_b])
    place = {k: j for j, k in enumerate(b[head:end_b], head) if once_b[k] == 1}
    single = [(i, place[k]) for i, k in enumerate(a[head:end_a], head) if once_a[k] == 1 and k in place]
    ends: list[int] = []  # longest increasing run of places in b
    back: list[int] = []
    at: list[int] = []
    for x, (_, j) in enumerate(single):
        d = bisect_left(ends, j)
        ends[d : d + 1] = [j]
        at[d : d + 1] = [x]
        back.append(at[d - 1] if d else -1)
    anchors = []
    x = at[-1] if at else -1
    while x >= 0:
        anchors.append(single[x])
        x = back[x]
    where: dict[str, list[int]] = {}
    for j in range(head, end_b):
        where.setdefault(b[j], []).append(j)
    i, j = head, head
    for stop_a, stop_b in [*reversed(anchors), (end_a, end_b)]:
        for x in range(i, stop_a):
            found = where.get(a[x], ())
            y = bisect_left(found, j)
            if y < len(found) and found[y] < stop_b:
                pairs.append((x, found[y]))
                j = found[y] + 1
        if stop_a < end_a:
            pairs.append((stop_a, stop_b))
        i, j = stop_a + 1, stop_b + 1
    return pairs + [(len(a) - tail + t, len(b) - tail + t) for t in range(tail)]


def align(a: list[_Group], b: list[_Group]) -> list[_Group]:
    out: list[_Group] = []
    i = j = 0
    for x, y in [*_common([g[0].key for g in a], [g[0].key for g in b]), (len(a), len(b))]:
        for g in (*a[i:x], *b[j:y]):
            g.optional = True
            out.append(g)
        if x < len(a):
            out.append(_Group([*a[x], *b[y]], a[x].optional or b[y].optional, a[x].repeated or b[y].repeated))
        i, j = x + 1, y + 1
    return out


def _fold(groups: list[_Group]) -> list[_Group]:
    """Neighbours of one form become a repeated group."""
    out: list[_Group] = []
    for g in groups:
        if out and out[-1][0].key == g[0].key:
            last = out[-1]
            out[-1] = _Group([*last, *g], last.optional and g.optional, True)
        else:
            out.append(g)
    return out


def _grouped(groups: list[_Group]) -> list[Node]:
    """One node for each folded group."""
    return [g[0] if len(g) == 1 else merge(g, g.optional, g.repeated) for g in _fold(groups)]


def merge(nodes: list[Node], optional: bool = False, repeated: bool = False) -> Node:
    """The wrapper that matches whatever one of ``nodes``, all of one form, matches."""
    top = Node(nodes[0].key, optional, repeated)
    todo = [(top, list(nodes))]
    while todo:
        out, some = todo.pop()
        for n in some:
            out.add_texts(n)
        groups = [_Group([c], c.optional, c.repeated) for c in some[0].children]
        for n in some[1:]:
            groups = align(groups, [_Group([c], c.optional, c.repeated) for c in n.children])
        for g in _fold(groups):
            if len(g) == 1:
                g[0].optional, g[0].repeated = g.optional, g.repeated
                out.children.append(g[0])
            else:
                out.children.append(Node(g[0].key, g.optional, g.repeated))
                todo.append((out.children[-1], list(g)))
    return top


def _name_words(key: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(key)}


def tag_of(key: str) -> str:
    return re.split(r"[.#@$]", key, maxsplit=1)[0]


def _named_out(key: str) -> bool:
    """A container whose names say that it is no part of an article."""
    tag = tag_of(key)
    words = _name_words(key[len(tag) :])
    return tag not in TEXT_TAGS and bool(words & BOILER_WORDS) and not words & MAIN_WORDS


def _softly(key: str) -> bool:
    """Whether nothing but soft words puts the container out."""
    return not (_name_words(key[len(tag_of(key)) :]) & BOILER_WORDS) - SOFT_WORDS


def _article(key: str) -> int:
    """2 for an article element, 1 for a main element, by tag, role or itemprop."""
    tag = tag_of(key)
    told = {w for w in re.split(r"[@$]", key[len(tag) :].lower())[1:]}
    return 2 if tag == "article" or told & {"article", "articlebody"} else 1 if tag == "main" or "main" in told else 0


@dataclass
class _Place:
    """All nodes of the wrapper on one path of keys."""

    key: str
    parent: int
    below: list[int] = field(default_factory=list)
    repeated: bool = False
    own: int = 0
    weight: int = 0
    size: int = 0
    linked: int = 0
    links_repeat: bool = False
    constant: bool = False
    title: bool = False
    named: int = 0
    #: Of the place and all below it: varying texts outside links and their characters, all characters, those in
    #: links, and different pages seen.
    prose: int = 0
    proses: int = 0
    all: int = 0
    all_linked: int = 0
    pages: set[int] = field(default_factory=set)

    def article_text(self, least: int) -> bool:
        """The slots say that the container holds text that varies between pages, and is no list of links."""
        return len(self.pages) >= CONSTANT_PAGES and self.prose >= max(1, least * self.proses) and self.all_linked < LINK_SHARE * self.all


def roles(wrapper: Node) -> dict[str, list]:
    """What a page is extracted by: ``steps`` (place, key, next place), and the places of the regions
    (``article``), of what is ``out``, of ``constant`` texts and, in a named region, of ``varying`` ones."""
    places: list[_Place] = []
    steps: dict[tuple[int, str], int] = {}
    path: list[int] = []
    for depth, n in wrapper.walk():
        del path[depth:]
        at = steps.setdefault((path[-1] if path else -1, n.key), len(places))
        if at == len(places):
            places.append(_Place(n.key, path[-1] if path else -1, constant=True))
            if path:
                places[path[-1]].below.append(at)
        path.append(at)
        p = places[at]
        p.repeated |= n.repeated
        p.size += n.size
        p.linked += n.linked
        p.links_repeat |= n.repeated and n.linked > 0
        p.constant &= not n.texts or n.constant()
        p.own += 0 if n.constant() else n.size - n.linked
        p.title |= tag_of(n.key) == "h1" and n.size > 0
        p.named = max(p.named, _article(n.key))
        p.pages.update(n.pages)
        p.all, p.all_linked = p.all + n.size, p.all_linked + n.linked
        if n.texts and not n.constant():
            p.prose, p.proses = p.prose + n.size - n.linked, p.proses + n.texts
    for p in places:
        p.constant &= p.size > 0
    for p in reversed(places[1:]):
        up = places[p.parent]
        up.prose, up.proses, up.all, up.all_linked = up.prose + p.prose, up.proses + p.proses, up.all + p.all, up.all_linked + p.all_linked
        up.pages = set(sorted(up.pages | p.pages)[:CONSTANT_PAGES])
    holds = [p.title or p.named > 0 for p in places]
    for i in range(len(places) - 1, 0, -1):
        up = places[i].parent
        holds[up] |= holds[i]
        places[up].title |= places[i].title
    kept = lambda p: _softly(p.key) and p.article_text(PROSE)
    out = {i for i, p in enumerate(places) if tag_of(p.key) in BOILER_TAGS or _named_out(p.key) and not holds[i] and not kept(p)}
    for i in range(len(places) - 1, -1, -1):  # a place stands after the one that it is below
        p = places[i]
        p.weight += p.own
        if i and i not in out:
            up = places[p.parent]
            up.weight += p.weight
        if i:
            up = places[p.parent]
            up.size, up.linked, up.links_repeat = up.size + p.size, up.linked + p.linked, up.links_repeat or p.links_repeat or p.repeated and p.linked > 0
    hidden = set()
    for i, p in enumerate(places):
        if i in out or p.parent in hidden:
            hidden.add(i)
    named = {level: [i for i, p in enumerate(places) if p.named == level and i not in hidden] for level in (2, 1)}
    region: list[int] = []
    for some in named.values():
        outer = [i for i in some if not _below(places, i, set(some))]
        if not region and outer and 2 * sum(places[i].weight for i in outer) >= places[0].weight:
            region = outer
    constant: list[int] = []
    varying: list[int] = []
    within: list[int] = []
    if region:  # of the header of an article belongs to it what varies; lists of links do not
        own = set(region)
        within = [i for i in range(len(places)) if _below(places, i, own)]
        varying = [i for i in within if places[i].own > 0 and len(places[i].pages) >= CONSTANT_PAGES]
        out |= {i for i in within if (p := places[i]).links_repeat and p.linked >= ONLY_LINKS * p.size and not p.title and len(p.pages) >= CONSTANT_PAGES}
    else:
        region = [_content(places, out)]
        out |= {i for i, p in enumerate(places) if p.links_repeat and p.linked >= LINK_SHARE * p.size and not p.title and i not in region}
        constant = [i for i, p in enumerate(places) if p.constant and not _inside_title(p)]
    hidden.difference_update(within)
    return {"steps": [[a, k, b] for (a, k), b in steps.items() if a not in hidden], "article": region, "out": sorted(out), "constant": constant, "varying": varying}


def _inside_title(p: _Place) -> bool:
    return tag_of(p.key) == "h1"


def _below(places: list[_Place], i: int, some: set[int]) -> bool:
    i = places[i].parent
    while i >= 0:
        if i in some:
            return True
        i = places[i].parent
    return False


def _content(places: list[_Place], out: set[int]) -> int:
    """Down from the page to the container of the content."""
    at = 0
    while True:
        here = places[at]
        below = [i for i in here.below if i not in out]
        if not below:
            return at
        best = max(below, key=lambda i: (places[i].weight, -i))
        rest = here.own + sum(places[i].weight for i in below if i != best)
        title = any(places[i].title for i in below if i != best)
        p = places[best]
        if title or rest > BESIDE * p.weight or p.own * 2 > p.weight or not p.weight:
            return at
        at = best


def extract(page: str | None, role: dict[str, list]) -> str:
    """The blocks of the regions, one to a line."""
    if not page:
        return ""
    steps = role.get("_steps")
    if steps is None:
        steps = role["_steps"] = {(a, k): b for a, k, b in role["steps"]}
        role["_sets"] = set(role["article"]), set(role["out"]), set(role["constant"]), set(role["varying"])
    article, out, constant, varying = role["_sets"]
    places, inline = [steps.get((-1, "#page"), -2)], [False]
    inside, hidden, titles_only = [places[0] in article], [places[0] in out], [False]
    blocks: list[str] = []
    part: list[str] = []
    reached = inside[0]

    def flush() -> None:
        if part:
            text = _BLANK.sub(" ", entities.unescape("".join(part))).strip()
            if text and places[-1] not in constant:
                blocks.append(text)
            part.clear()

    for kind, value in events(page):
        if kind == "text":
            if inside[-1] and not hidden[-1] and not titles_only[-1]:
                part.append(value)
        elif kind == "break":
            if value == "hr":
                flush()
            part.append(" ")
        elif kind == "open":
            tag = tag_of(value)
            inline.append(tag in INLINE)
            if inline[-1]:
                continue
            flush()
            at = steps.get((places[-1], value), -2)
            # the title of an article may stand in a header of its own
            titles = tag == "header" and inside[-1] and not hidden[-1]
            places.append(at)
            inside.append(inside[-1] or at in article)
            reached = reached or inside[-1]
            hidden.append(hidden[-1] or at in out and not titles)
            titles_only.append((titles_only[-1] or titles) and tag not in TITLE_TAGS and at not in varying)
        elif not inline.pop():
            flush()
            for x in (places, inside, hidden, titles_only):
                x.pop()
    flush()
    if not reached and not role.get("alone"):  # a page of another kind than its host's articles is its own wrapper
        return extract(page, roles(parse(page)) | {"alone": True})
    return "\n".join(blocks)


def _fold_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html or wrapper) -> one wrapper for each host met."""
    held: dict[str, list[Node]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(merge(n).dump(), ensure_ascii=True) for n in held.values()], pa.string())], names=["host", "wrapper"])

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            node = parse(page.as_py())
            own = held.setdefault(host, [])
            own.append(node)
            if len(own) >= MERGED_AT_ONCE:
                held[host] = [merge(own)]
        if len(held) > HOSTS_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _merge_group(t: pa.Table) -> pa.Table:
    # the order of merging is fixed, whatever order the rows came in
    nodes = [Node.load(json.loads(w)) for w in sorted(t.column("wrapper").to_pylist())]
    return pa.table({"host": t.column("host")[:1], "wrapper": pa.array([json.dumps(merge(nodes).dump())], pa.string())})


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def induce(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): the induced expression of each host, as JSON."""
    own = pages.select(host_of(url).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    partial = own.mapInArrow(_fold_hosts, "host string, wrapper string")
    fan = partial.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_FAN)))
    some = fan.groupBy("host", "part").applyInArrow(_merge_group, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(_merge_group, "host string, wrapper string")


def expressions(wrappers: DataFrame) -> DataFrame:
    """(host, expression): wrappers as readable regular expressions."""
    return add_columns(wrappers, ["wrapper"], lambda _, w: [[Node.load(json.loads(x)).expression() for x in w]], [T.StructField("expression", T.StringType())], keep=["host"])


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with text."""
    pages, named_back = shielded(pages, ("_host", "_roles", "_roles_of"))
    wrappers = induce(pages, url, html)
    told = add_columns(wrappers, ["wrapper"], lambda _, w: [[json.dumps(roles(Node.load(json.loads(x)))) for x in w]], [T.StructField("_roles", T.StringType())], keep=["host"])
    told = materialise(told, "wrapper-roles")
    size = told.agg(F.coalesce(F.sum(F.octet_length("_roles") + F.octet_length("host")), F.lit(0))).first()[0]
    rows = pages.withColumn("_host", host_of(url))
    field_ = [T.StructField("text", T.StringType())]
    keep = [c for c in pages.columns if c.lower() != "text"]
    if size <= BROADCAST_BYTES:
        side = pages.sparkSession.sparkContext.broadcast({r.host: json.loads(r["_roles"]) for r in told.collect()})
        return named_back(add_columns(rows, [html, "_host"], lambda _, page, host: [[extract(p, side.value[h]) for p, h in zip(page, host, strict=True)]], field_, keep=keep))
    rows = rows.join(told.withColumnRenamed("host", "_roles_of"), F.col("_host") == F.col("_roles_of"))
    return named_back(add_columns(rows, [html, "_roles"], lambda _, page, role: [[extract(p, json.loads(r)) for p, r in zip(page, role, strict=True)]], field_, keep=keep))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
