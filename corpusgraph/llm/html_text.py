"""Main text of HTML pages by composite text density.

A tolerant tokenizer builds the tree of the whole page (implied and missing
end tags as browsers treat them; a cut-off last tag is dropped).  Elements
that never hold article text, by name, or by a role, class or id that names such
a part as a whole (``sidebar``, ``site-header``; not ``has-sidebar``), are left
out with all they contain.  Of these, elements for layout and those left out for a
role, class or id stay in if they hold most of the body's text outside links, or
an article or main element, unless one stands outside them all.  For every other node

    density = chars / tags * log_b(chars / link_chars * tags / link_tags)
    b = ln(chars / other_chars * link_chars + body_link_chars / body_chars * chars + e)

(zero counts as one), so text thick in links scores low, and a node's density
sum is the sum of its child blocks' densities (inline elements are part of their
block's text).  The threshold is the least density
on the path from the node with the largest sum to the body.  From the body down,
a block that reaches the threshold is kept and its blocks are judged in turn, so
an article in several parts keeps them all; a block below it falls out, links and
short texts between the parts alike.  In each kept block the one of the largest
sum is article as a whole: of it only blocks of two or more links and hardly any
other text fall out, if below the threshold.  Text is judged with its block
(runs of text and inline elements beside blocks only if they hold links), and a
heading goes with the block after it.

A page with exactly one article element that is not set apart is judged inside
it alone, with the headings right before it or what holds it.  Elsewhere three
or more sisters of one name, class and make-up, each a short name, something
dated or to click, and a text, are reader comments if they hold less than half
of the page's plain text.  A button stays in where its parent's own text is
longer, as in a sentence.

Text: character references decoded, white space inside a block one space,
blocks trimmed and joined by a line feed in page order; nothing is dropped
or cut otherwise.

Defined cases: null html counts as empty; a page without text gives an empty
text; every input row gives one row, repeated rows included; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.llm.batches import values

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIP = RAW | frozenset(
    "head template nav header footer aside form button select option input object svg canvas "
    "menu dialog audio video map".split())
#: Names and marks that a layout may put around the article all the same.
LAYOUT = frozenset("nav header footer aside form menu dialog".split())
#: What a start tag closes if it is open, and the elements that shield it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_SHIELD = frozenset({"table", "td", "th", "button", "caption", "object", "template", "html"})
#: For "p" and each of these a bit tells whether one that the start tag closes is
#: open and not shielded, so that no start tag has to look for it.
_FAMILIES = {"p": ({"p"}, _SHIELD | {"body"}),
             **{k: (names, shields | {"body"}) for k, (names, shields) in CLOSES.items()}}
_BIT = {family: 1 << i for i, family in enumerate(_FAMILIES)}


def _mask(name: str) -> tuple[int, int]:
    """Bits that an element of this name sets and keeps for what it holds."""
    sets = sum(_BIT[f] for f, (names, _) in _FAMILIES.items() if name in names)
    return sets, ~sum(_BIT[f] for f, (_, shields) in _FAMILIES.items() if name in shields)


#: Classes, ids and roles that mark what is not the article.
_APART = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header footer masthead sidebar "
    "side aside complementary widget related recommended share sharing social cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe "
    "signup login search comment comments commentlist respond reply replies disqus copyright "
    "legal disclaimer pagination pager toolbar skip contentinfo".split())

#: Words that say which one of them it is, before or after the name.
_WHICH = frozenset(
    "site page main top bottom left right primary secondary global mobile sticky fixed list box bar "
    "area block section container wrapper wrap links buttons form posts articles".split())
#: Of these only before the name: a search-page or page-search is told apart.
_AFTER = _WHICH - frozenset("site page main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("name", "parent", "kids", "apart", "chars", "tags", "link_chars", "link_tags",
                 "density", "sum", "block", "top", "keep", "whole", "plain", "named", "mark", "open", "scope")

    def __init__(self, name: str, parent: Node | None, apart: int = 0, mark: str = "") -> None:
        self.name, self.parent, self.apart, self.mark = name, parent, apart, mark
        sets, keeps = _mask(name)
        self.open = (parent.open if parent else 0) & keeps | sets
        #: open elements by name, up to the next shield
        self.scope: dict[str, int] = {} if parent is None or name in _SHIELD else parent.scope
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.block = self.keep = self.whole = False
        self.top, self.plain, self.named = self, 0, False


def _names_apart(token: str) -> bool:
    """Whether a class, id or role as a whole names a part that is not the article."""
    words = [w.lower() for w in _SPLIT.split(token) if w and not w.isdigit()]
    named = [i for i, w in enumerate(words) if w in _APART]
    return bool(named) and all(
        w in _APART or w in (_WHICH if i < named[0] else _AFTER) for i, w in enumerate(words))


def _set_apart(name: str, attributes: str) -> tuple[int, str]:
    """0: not; 1: by its layout name, role, class or id; 2: never article text.
    And the class."""
    if name in SKIP and name not in LAYOUT:
        return 2, ""
    apart, mark = int(name in LAYOUT), ""
    for m in _ATTR.finditer(attributes) if name not in ("body", "html", "article", "main") else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        mark = value if key == "class" else mark
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 2, mark
        if key in ("class", "id", "role") and any(map(_names_apart, value.split())):
            apart = 1
        if key == "style" and "display:none" in value.lower().replace(" ", ""):
            return 2, mark
    return apart, mark


def _take_back(root: Node) -> None:
    """Undoes ``apart`` of elements around most of the text, or around the article."""
    nodes, stack, outside = [], [(root, False)], False
    while stack:
        x, inside = stack.pop()
        nodes.append(x)
        inside = inside or x.apart > 0
        outside = outside or not inside and x.name in ("article", "main")
        stack.extend((k, inside) for k in x.kids if isinstance(k, Node) and k.apart < 2)
    for x in reversed(nodes):
        x.named = x.name in ("article", "main")
        for k in x.kids:
            if isinstance(k, str):
                x.plain += 0 if k.isspace() else len(k)
            elif k.apart < 2:
                x.plain += k.plain
                x.named = x.named or k.named
        if x.name == "a":
            x.plain = 0
    for x in nodes:
        if x.apart == 1 and not outside and (2 * x.plain > root.plain or x.named):
            x.apart = 0


def _text(x: Node) -> str:
    """All text under a node, white space as one space."""
    out, stack = [], [x]
    while stack:
        y = stack.pop()
        if isinstance(y, str):
            out.append(y)
        else:
            stack.extend(reversed(y.kids))
    return " ".join("".join(out).split())


_NAME, _RECORD, _FEW = 40, 1000, 3


def _is_comment(x: Node) -> bool:
    """A short name first, something dated or to click, and a text."""
    parts = [k for k in x.kids if isinstance(k, Node)]
    if len(parts) < 3 or x.plain > _RECORD or parts[0].name in HEADINGS:
        return False
    texts = [_text(k) for k in parts]
    dated = [len(t) <= _NAME and (k.name in ("time", "a", "button") or any(c.isdigit() for c in t))
             for k, t in zip(parts, texts)]
    words = max((len(t.split()) for t, d in zip(texts[1:], dated[1:]) if not d), default=0)
    return (0 < len(texts[0]) <= _NAME and texts[0][-1] not in ".!?:;," and any(dated[1:])
            and words > len(texts[0].split()))


def _comments_apart(root: Node) -> None:
    """Sets reader comments without a telling name apart, by their make-up; and
    keeps a button's text where it is part of a sentence."""
    stack = [root]
    while stack:
        x = stack.pop()
        groups: dict[tuple, list[Node]] = {}
        own = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        for k in x.kids:
            if isinstance(k, Node):
                if k.name == "button" and own > len(_text(k)):
                    k.apart = 0
                if not k.apart:
                    stack.append(k)
                    if k.name in BLOCK and k.plain <= _RECORD:
                        made = tuple(y.name for y in k.kids if isinstance(y, Node))
                        groups.setdefault((k.name, k.mark, made), []).append(k)
        for like in groups.values():
            if len(like) >= _FEW and 2 * sum(k.plain for k in like) < root.plain and all(map(_is_comment, like)):
                for k in like:
                    k.apart = 1


def _lone_article(root: Node) -> Node | None:
    """The only article element that is not set apart, if it holds text."""
    found, stack = [], [root]
    while stack and len(found) < 2:
        x = stack.pop()
        if x.name == "article":
            found.append(x)
        stack.extend(k for k in x.kids if isinstance(k, Node) and not k.apart)
    return found[0] if len(found) == 1 and found[0].plain else None


def _headings_before(x: Node) -> list[Node]:
    """The headings right before a node, or before what holds it, in page order."""
    out: list[Node] = []
    while x.parent is not None:
        here = []
        at = next(i for i, k in enumerate(x.parent.kids) if k is x)
        for k in reversed(x.parent.kids[:at]):
            if isinstance(k, Node) and k.name in HEADINGS and not k.apart:
                here.append(k)
            elif isinstance(k, Node) and not k.apart or isinstance(k, str) and not k.isspace():
                break
        out = here[::-1] + out
        x = x.parent
    return out


def parse(page: str) -> Node:
    """The tree of a page; the root is named ``html``."""
    root = Node("html", None)
    body, at, size = root, 0, len(page)
    here = root

    def close(names, shields) -> None:
        """Closes the nearest of ``names`` that is known to be open."""
        nonlocal here
        x = here
        while x.parent is not None and x.name not in names:
            if x.name in shields:
                return
            x = x.parent
        if x.parent is not None:
            while here is not x.parent:
                leave(here)
                here = here.parent

    def leave(x: Node) -> None:
        x.parent.scope[x.name] -= 1
        opened[x.name] -= 1

    def enter(x: Node) -> Node:
        x.parent.scope[x.name] = x.parent.scope.get(x.name, 0) + 1
        opened[x.name] = opened.get(x.name, 0) + 1
        return x

    opened: dict[str, int] = {}
    while at < size:
        begin = page.find("<", at)
        m = None
        while begin >= 0:
            m = _TOKEN.match(page, begin)
            if m:
                break
            begin = page.find("<", begin + 1)
        end = begin if m else size
        if end > at:
            here.kids.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name in _SHIELD:
                if name != "html" and opened.get(name):
                    close({name}, frozenset())
            elif name != "body" and here.scope.get(name):
                close({name}, _SHIELD)
        elif m[2] and m[4]:
            name = m[2].lower()
            if name in ("html", "body"):
                if name == "body" and body is root:
                    while here.parent is not None:
                        leave(here)
                        here = here.parent
                    body = here = enter(_add(here, Node("body", here)))
                continue
            if name in BLOCK and here.open & _BIT["p"]:
                close(*_FAMILIES["p"])
            if name in CLOSES:
                for _ in range(3):
                    if not here.open & _BIT[name]:
                        break
                    close(*_FAMILIES[name])
            node = _add(here, Node(name, here, *_set_apart(name, m[3])))
            if name in RAW:
                done = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
                at = done.end() if done else size
            elif name not in VOID and not (m[3].endswith("/") and name in ("svg", "path", "math")):
                here = enter(node)
    _take_back(root)
    _comments_apart(root)
    return root


def _add(parent: Node, node: Node) -> Node:
    parent.kids.append(node)
    return node


def _ordered(root: Node) -> list[Node]:
    """Nodes that are not apart, parents before children."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.apart)
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density; ``ratio`` is the share of link text in the body."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + ratio * chars + math.e)
    gain = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * math.log(max(gain, 1.0)) / math.log(max(base, 1.0001))


def measure(body: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes under ``body``."""
    nodes = _ordered(body)
    for x in reversed(nodes):
        x.chars = sum(len(k) for k in x.kids if isinstance(k, str) and not k.isspace())
        x.block = x.name in BLOCK
        for k in x.kids:
            if isinstance(k, Node) and not k.apart:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.name == "a")
                x.block = x.block or k.block
        if x.name == "a":
            x.link_chars = x.chars
    ratio = body.link_chars / max(1, body.chars)
    for x in nodes:
        x.density = density(x.chars, x.tags, x.link_chars, x.link_tags, ratio)
    for x in nodes:
        x.sum = sum(k.density for k in x.kids if isinstance(k, Node) and not k.apart and k.block)
    return nodes


def select(root: Node) -> tuple[Node, float]:
    """Marks what is kept; the body and the threshold."""
    body = _lone_article(root) or next((k for k in root.kids if isinstance(k, Node) and k.name == "body"), root)
    nodes = measure(body)
    for x in reversed(nodes):
        x.top = x
        for k in x.kids:
            if isinstance(k, Node) and not k.apart and k.top.sum > x.top.sum:
                x.top = k.top
    x = body.top
    threshold = x.density
    while x is not body:
        x = x.parent
        threshold = min(threshold, x.density)
    stack = [body]
    while stack:
        x = stack.pop()
        x.keep = True
        inner = [k for k in x.kids if isinstance(k, Node) and not k.apart and k.block]
        if not inner:
            x.whole = True
        y = x.top
        y.whole = True
        while not y.keep:
            y.keep = True
            y = y.parent
        if not x.whole:
            stack.extend(k for k in inner if k.keep or k.density >= threshold)
    return body, threshold


def _shown(x: Node, threshold: float, ratio: float) -> list[Node | str | None]:
    """The kids of a kept node that are kept; None for a block that is not."""
    out: list[Node | str | None] = []
    run: list[Node | str] = []

    def judge() -> None:
        chars = tags = link_chars = link_tags = 0
        for k in run:
            if isinstance(k, str):
                chars += 0 if k.isspace() else len(k)
            elif not k.apart:
                chars, tags = chars + k.chars, tags + k.tags + 1
                link_chars += k.link_chars
                link_tags += k.link_tags + (k.name == "a")
        if not link_chars or density(chars, tags, link_chars, link_tags, ratio) >= threshold:
            out.extend(run)
        run.clear()

    for k in x.kids:
        if isinstance(k, Node) and (k.apart and k.name in BLOCK or k.block):
            judge()
            out.append(k if k.keep or k.apart or k.name in HEADINGS else None)
        else:
            run.append(k)
    judge()
    follows = False
    for i in range(len(out) - 1, -1, -1):
        k = out[i]
        if isinstance(k, Node) and k.name in HEADINGS and not (k.keep or follows):
            out[i] = None
        elif k is None or isinstance(k, Node) and k.block:
            follows = k is not None
    return out


def blocks(body: Node, threshold: float) -> list[str]:
    """Texts of the kept blocks, in page order."""
    out: list[str] = []
    run: list[str] = []
    ratio = body.link_chars / max(1, body.chars)

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node | str | None, bool, bool]] = [(body, False, False)]
    while stack:
        x, leaving, whole = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None or leaving:
            flush()
        elif x.apart:
            if x.name in BLOCK:
                flush()
        elif x.name == "br":
            run.append(" ")
        elif (whole and x.block and x.link_tags > 1 and x.density < threshold
              and 10 * (x.chars - x.link_chars) < x.chars):
            flush()
        else:
            whole = whole or x.whole or not x.block
            if x.name in BLOCK:
                flush()
                stack.append((x, True, whole))
            kids = x.kids if whole or not x.keep else _shown(x, threshold, ratio)
            stack.extend((k, False, whole) for k in reversed(kids))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    body, threshold = select(parse(page))
    heads = [_text(h) for h in _headings_before(body)] if body.name == "article" else []
    return "\n".join([h for h in heads if h] + blocks(body, threshold))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per page."""
    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in values(b, 2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
