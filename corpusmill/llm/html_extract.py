"""Main text of web pages by composite text density.

A page becomes a tree of elements.  For every node the characters ``C``, the tags
``T``, the link characters ``LC`` and the link tags ``LT`` below it give the composite
density

    D = C/T * log_b(C/LC * T/LT),    b = ln(C/(C-LC) * LC + LC_body/C_body * C + e)

with counts below one taken as one: characters per tag, scaled down as links take
over.  A node's density sum is the sum of its children's densities.  The subtree with the
largest density sum is the content.  The threshold is the least density on the path
from the body to it.  On that path, body included, the other children of a node
that reach the threshold are content as well, and so are headings; if the path runs
through an ``article`` or ``main`` element, all of that element is.  Directly in the
body, runs of nothing but links are left out.

Elements that never hold article text (scripts, styles, menus, headers, also those of an article,
...) and hidden ones are taken out before the counts.  So are forms and elements whose class, id or role
names a side part (adverts, notices, comments, ...), unless they hold an ``article`` or
``main`` or more than half of the text: these count with a tenth of their density,
and go only if the content lies elsewhere.  Names that say what a page has, or has not
(``has-sidebar``, ``comments-open``), name no part, and if hardly any text is outside
of the named parts, names are not followed at all.

The text is that of the content's blocks in page order.  Character references are
decoded, white space in a block becomes one space, blocks are trimmed and joined
by one space.  Nothing is cut off or dropped beyond that.

Cases: a null, empty or text-free page gives an empty text.  Markup that is not
closed, nests wrongly or ends early is closed where its parent ends.  A page without
markup is all text.  Equal density sums go to the outer, earlier node.  Repeated rows
are extracted alike, null ids and urls are passed through, other columns are not
read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ready

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template".split())
DROPPED = set("head script style noscript template iframe object svg math canvas nav header footer aside "
              "button select textarea input dialog menu title audio video map".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
             "strike strong sub sup time tt u var wbr img".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
               "header hr main menu nav ol p pre section table ul".split())
#: an opening tag closes an open element of these names (up to the given parents)
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: words of a class, id or role that name a part beside the article
SIDE_WORDS = set("ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo "
                 "promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail footer foot "
                 "header masthead topbar comment comments reply replies disqus cookie cookies consent notice notices gdpr "
                 "popup modal overlay newsletter subscribe subscription signup login share sharing social related "
                 "recommended widget pagination pager skip toolbar complementary contentinfo search alert".split())
#: names that start or end with these words say something of a page and name no part
STATE_FIRST = set("has have no non not with without".split())
STATE_LAST = set("open closed free enabled disabled".split())
ROOT_LIKE = set("html body main article".split())
CONTENT = ("article", "main")
#: density share of a part that is named as a side part but too large to be one
LOWERED = 0.1
#: share of the text that must be outside of the named side parts
LEAST_OUTSIDE = 0.1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "up", "kids", "side", "own", "holds", "standing", "c", "t", "lc", "lt", "density", "total")

    def __init__(self, tag, up=None, side=False):
        self.tag, self.up, self.kids, self.side = tag, up, [], side  # side: its names are those of a side part
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.total = 0.0


def _is_gone(tag: str, attrs: list[tuple[str, str]]) -> bool:
    """Whether an element is never content: by its name, or as it is hidden."""
    return tag in DROPPED or tag not in ROOT_LIKE and any(
        name == "hidden" or name == "style" and _NO_DISPLAY.search(value) for name, value in attrs)


def _is_side(tag: str, attrs: list[tuple[str, str]]) -> bool:
    """Whether an element is a side part by its names, or as a form (some pages wrap all they have in one)."""
    if tag in ROOT_LIKE:
        return False
    if tag == "form":
        return True
    for attr, value in attrs:
        if attr in ("class", "id", "role"):
            for name in value.split():
                words = [w.lower() for w in _WORD.findall(name)]
                if (words and words[0] not in STATE_FIRST and words[-1] not in STATE_LAST
                        and not SIDE_WORDS.isdisjoint(words)):
                    return True
    return False


def parse(page: str) -> Node:
    """The element tree of a page, without what is never content.  Kids are nodes and
    strings, in page order."""
    root = Node("body")
    stack = [(root, False)]  # node, inside a part that is never content
    is_open: Counter = Counter()  # open elements by name
    at, n, low = 0, len(page), None

    def close(i):
        for node, _ in stack[i:]:
            is_open[node.tag] -= 1
        del stack[i:]

    def close_nearest(names, crosses):
        """Close up to the nearest open element of ``names`` that lies above only
        elements which ``crosses`` allows."""
        if any(is_open[x] for x in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0].tag in names:
                    return close(i)
                if not crosses(stack[i][0].tag):
                    return None
        return None

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text and not stack[-1][1]:
            stack[-1][0].kids.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[1] and not stack[-1][1]:
            stack[-1][0].kids.append(m[1])
        if not m[3]:
            continue
        tag, attrs = m[3].lower(), m[4]
        if tag in ("html", "body"):
            continue
        if m[2]:
            inline = tag in INLINE
            close_nearest((tag,), lambda x: not (inline and x in ("td", "th", "table")))
            continue
        if tag in CLOSES_P:
            close_nearest(("p",), INLINE.__contains__)
        if tag in CLOSES:
            names, stop = CLOSES[tag]
            close_nearest(names, lambda x: x not in stop)
        named = [] if stack[-1][1] or not attrs else [
            (a[1].lower(), a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(attrs)]
        gone = stack[-1][1] or _is_gone(tag, named)
        node = Node(tag, stack[-1][0], not gone and _is_side(tag, named))
        if not gone:
            stack[-1][0].kids.append(node)
        if tag in RAW:  # its content is not markup
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            at = n if end < 0 else end
        if tag not in VOID:
            stack.append((node, gone))
            is_open[tag] += 1
    return root


def _in_order(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return order


def _drop_side_parts(root: Node, order: list[Node]) -> list[Node]:
    """Take out the named side parts that are not too large to be one; the nodes left."""
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = node.own + sum(size[id(k)] for k in node.kids if isinstance(k, Node))
        node.holds = node.tag in CONTENT or any(k.holds for k in node.kids if isinstance(k, Node))
    every = size[id(root)]

    def goes(k):
        return isinstance(k, Node) and k.side and not k.holds and 2 * size[id(k)] <= every

    left, todo = 0, [root]
    while todo:
        node = todo.pop()
        left += node.own
        todo += [k for k in node.kids if isinstance(k, Node) and not goes(k)]
    if left < LEAST_OUTSIDE * every:
        for node in order:
            node.side = False
        return order
    for node in order:
        node.kids = [k for k in node.kids if not goes(k)]
    return _in_order(root)


def _measure(root: Node) -> list[Node]:
    """Drop the side parts and fill in the counts and densities; all nodes in page order."""
    order = _in_order(root)
    for node in order:
        node.own = sum(len(_SPACE.sub("", k)) for k in node.kids if isinstance(k, str))
    if any(node.side for node in order):
        order = _drop_side_parts(root, order)
    for node in order:
        node.standing = LOWERED if node.side else node.up.standing if node.up else 1.0
    for node in reversed(order):
        node.c = node.own
        for k in node.kids:
            if isinstance(k, Node):
                link = k.tag == "a"
                node.c += k.c
                node.t += k.t + 1
                node.lc += k.c if link else k.lc
                node.lt += k.lt + link
    share = root.lc / max(root.c, 1)
    for node in reversed(order):
        if node.c:
            c, t, lc, lt = node.c, max(node.t, 1), max(node.lc, 1), max(node.lt, 1)
            base = math.log(c / max(c - node.lc, 1) * node.lc + share * c + math.e)
            ratio = c / lc * t / lt
            node.density = max(0.0, c / t * (math.log(ratio) / math.log(base) if base > 1.0000001 else math.log(ratio) * 1e7))
        node.total = sum(k.density * k.standing for k in node.kids if isinstance(k, Node))
    return order


def _content(root: Node, order: list[Node]) -> tuple[Node, set[int]]:
    """The top node of the content, and the ids of nodes below it to leave out."""
    best = max(order, key=lambda x: x.total)  # the first, thus outermost, of equals
    path = [best]
    while path[-1].up:
        path.append(path[-1].up)
    on_path = set(map(id, path))
    # side parts that were too large to drop go if the content lies elsewhere
    out, inside = set(), {id(best)}
    for x in order:
        if x.up and id(x.up) in inside:
            inside.add(id(x))
        if x.side and id(x) not in on_path and (id(x) not in inside or 2 * x.c <= best.c):
            out.add(id(x))
    for x in reversed(path):
        if x.tag in CONTENT:
            return x, out
    threshold = min(x.density for x in path)
    top = best
    for child, parent in zip(path, path[1:]):
        top = parent
        out |= {id(k) for k in parent.kids if isinstance(k, Node) and k is not child and k.tag not in HEADINGS
                and k.tag not in INLINE and k.density < threshold}
    if top is root and best is not root:
        _drop_link_runs(root)
    return top, out


def _drop_link_runs(root: Node) -> None:
    """Take the runs of text and inline elements that are nothing but links out of the body's children."""
    kids, run = [], []
    for k in [*root.kids, None]:
        if isinstance(k, str) or k is not None and k.tag in INLINE:
            run.append(k)
            continue
        if _has_plain_text(run):
            kids += run
        run = []
        if k is not None:
            kids.append(k)
    root.kids = kids


def _has_plain_text(run: list) -> bool:
    """Whether there are letters or digits outside of links."""
    todo = list(run)
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if any(c.isalnum() for c in x):
                return True
        elif x.tag != "a":
            todo += x.kids
    return False


def _blocks(top: Node, out: set[int]) -> list[str]:
    """The text blocks of the content, in page order."""
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            blocks.append(text)
        run.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif id(x) in out:
            pass
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.kids)
        else:
            flush()
            todo.append(None)
            todo += reversed(x.kids)
    flush()
    return blocks


def main_text(page: str | None) -> str:
    """The text of the page's main content."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    if not root.c:
        return ""
    return " ".join(_blocks(*_content(root, order)))


def _extracted(batches):
    for rb in batches:
        texts = [main_text(page) for page in rb.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` per row of ``pages``."""
    src = ready(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                              F.col(html_col).cast("string").alias("html"))
    kind = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(_extracted, f"page_id {kind['page_id']}, url {kind['url']}, text string")
