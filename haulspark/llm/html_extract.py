"""Main text of web pages by a tree-structured graphical model.

The page becomes a tree of block elements.  Each is content or not; a node's own potential comes from its tag,
its class and id words and the shape of its text, and a parent-child potential ties neighbours.  Sum-product
messages, once upward and once downward, give each node's marginal of being content; text directly inside
content blocks is the main text.  The potentials are trained from labelled pages: pages that this module writes
itself from a grammar of layouts, with the label of each block known (``training_pages``).
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from haulspark.llm.common import map_batches, narrow, prepare

#: Elements whose content is never text of the page: scripts, styles, graphics, forms, sources of formulas, and what
#: stands in for a player that is there.
SKIP = frozenset("script style noscript template svg annotation annotation-xml head title iframe object embed canvas audio video select textarea button option datalist map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "nav header footer aside form fieldset legend label details summary address dialog menu center hgroup search".split()
)
#: A start tag that ends an open element of the set, up to the nearest of the bounds.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Words of a class or an id.
WORDS = re.compile(r"[a-z]+|\d+")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: A tag whose quotes are unbalanced ends at the first angle bracket.
LOOSE_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
OPENING = re.compile(r"</?[a-zA-Z]")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "hints", "hidden", "links", "parent", "tag", "texts", "total")

    def __init__(self, tag: str, parent: Node | None, hints: frozenset = frozenset(), hidden: bool = False):
        self.tag, self.parent, self.hints, self.hidden = tag, parent, hints, hidden
        self.children: list[Node] = []
        self.texts: list = []  # own text, in order with the children that interrupt it
        self.links = self.total = 0


def parse(page: str) -> Node:
    """The tree of block elements.  Inline elements leave their text to the block around them; unclosed and
    wrongly nested tags are taken as browsers take them, as far as blocks are concerned."""
    root = Node("html", None)
    here, at, n, link = root, 0, len(page), 0
    stack: list[Node] = []  # open elements
    opened: defaultdict[str, list[int]] = defaultdict(list)  # their places in the stack, by tag
    unclosed: set[str] = set()  # elements that are skipped and have no end tag from here on
    last = page.rfind(">")
    find = TAG

    def text(s: str) -> None:
        if s:
            here.texts.append(s)
            here.total += len(s)
            here.links += len(s) * (link > 0)

    def close_from(place: int) -> Node:
        while len(stack) > place:
            opened[stack.pop().tag].pop()
        return stack[-1] if stack else root

    def nearest(tags) -> int:
        return max((opened[t][-1] for t in tags if opened[t]), default=-1)

    while at < n:
        m = find.search(page, at) if at <= last else None
        if find is TAG and (m is None or OPENING.search(page, at, m.start())):  # a tag without an end was passed over
            find = LOOSE_TAG
            m = find.search(page, at) if at <= last else None
        if not m:
            end = page.find("<!--", at)  # a comment without an end hides what follows
            text(page[at:] if end < 0 else page[at:end])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag, close = m[2].lower(), m[1]
        if close:
            if tag == "a":
                link = max(0, link - 1)
            elif tag == "br":
                text(" ")
            elif opened[tag]:
                here, link = close_from(opened[tag][-1]), 0
            continue
        if tag in SKIP and tag not in VOID:
            if tag not in unclosed:
                end = RAW.get(tag) or re.compile(rf"</{re.escape(tag)}\s*>", re.I)
                if tag == "head":
                    end = re.compile(r"</head\s*>|(?=<body\b)", re.I)
                m2 = end.search(page, at)
                if m2:
                    at = m2.end()
                    continue
                unclosed.add(tag)
            if tag in RAW:
                at = n
            continue
        if tag == "a":
            link = 1
        if tag == "br" or tag == "hr" or tag == "img":
            text(" ")
            continue
        if tag in VOID or tag not in BLOCKS:
            continue
        shut, bounds = CLOSED_BY.get(tag, ((), ()))
        if (place := nearest(shut)) > nearest(bounds):
            here = close_from(place)
        if here.parent and (here.tag == "p" or here.tag[0] == "h" and len(here.tag) == 2 and tag[0] == "h" and len(tag) == 2):
            here = close_from(len(stack) - 1)
        hints, hidden = [], False
        if m[3]:
            for a in ATTR.finditer(m[3]):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
                elif name in ("class", "id", "role", "itemprop"):
                    hints += WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        if tag in ("html", "body") and here is root:
            root.hints |= frozenset(hints)
            continue
        child = Node(tag, here, frozenset(hints), hidden)
        here.children.append(child)
        here.texts.append(child)
        opened[tag].append(len(stack))
        stack.append(child)
        here, link = child, 0
    return root


def own_blocks(node: Node) -> list:
    """A node's text, cut where child blocks interrupt it: cleaned strings and child nodes in page order."""
    out: list = []
    run: list[str] = []
    for x in [*node.texts, None]:
        if isinstance(x, str):
            run.append(x)
        else:
            if run and (s := SPACE.sub(" ", html.unescape("".join(run))).strip()):
                out.append(s)
            run = []
            if x is not None:
                out.append(x)
    return out


def features(node: Node, depth: int) -> list[str]:
    """Discrete features of a node; its class and id words count one by one."""
    kids = Counter(c.tag for c in node.children)
    size = node.total
    f = [f"tag={node.tag}", f"kids={min(3, len(node.children))}", f"size={0 if not size else min(6, 1 + int(math.log2(1 + size / 20)))}"]
    if size:
        f.append(f"link={min(3, int(4 * node.links / size))}")
        f.append(f"stop={any(isinstance(t, str) and t.rstrip()[-1:] in '.!?:;' for t in node.texts)}")
    if node.children:
        f.append(f"paras={min(3, kids['p'])}")
    f += [f"hint={h}" for h in node.hints]
    if node.hidden:
        f.append("hidden")
    return f


# ---- training --------------------------------------------------------------------------------------------

#: Elements and class words of blocks that are not the article, by kind, and of the article.
APART = {
    "nav": "nav navbar menu breadcrumb breadcrumbs navigation toc pagination pager skip tabs links", "header": "header masthead topbar banner logo branding toolbar brand",
    "footer": "footer copyright colophon legal bottom foot sitemap", "aside": "sidebar aside related widget recommended trending popular rail tags more also",
    "div": "ad ads advert advertisement sponsored promo sponsor adsense adbox notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall share social sharing follow",
    "section": "comments comment disqus replies reply respond discussion thread responses feedback related recommendations", "form": "form search login contact subscribe",
}
ARTICLE = "content article post entry story body main text page document prose blog paragraph lead intro"
COMMENT_PARTS = "comment reply user avatar meta"


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize() + r.choice([".", ".", ".", "?", ""])


def training_pages(count: int, seed: int) -> list[tuple[Node, set[int]]]:
    """Labelled pages: trees, and the ids of the nodes that are content."""
    r, out = random.Random(seed), []
    for _ in range(count):
        content: set[int] = set()

        def node(parent, tag, hints=(), text="", good=False, link=0.0, content=content):
            x = Node(tag, parent, frozenset(hints))
            if parent:
                parent.children.append(x)
                parent.texts.append(x)
            if text:
                x.texts.append(text)
                x.total, x.links = len(text), int(len(text) * link)
            if good:
                content.add(id(x))
            return x

        def apart(parent, kind, node=node):
            words = APART[kind].split()
            hinted = r.random() < 0.6 or kind in ("div", "section")
            box = node(parent, kind if r.random() < 0.7 or kind == "div" else "div", r.sample(words, 1) if hinted else (), "" if r.random() < 0.6 else _words(r, r.randint(2, 40)))
            if kind in ("nav", "aside", "footer", "header") and r.random() < 0.7:
                ul = node(box, "ul")
                for _ in range(r.randint(2, 8)):
                    node(ul, "li", (), _words(r, r.randint(1, 4)), link=1.0)
            elif kind == "section":
                for _ in range(r.randint(1, 5)):
                    c = node(box, r.choice(["div", "article", "li"]), [r.choice(COMMENT_PARTS.split())])
                    for _ in range(r.randint(1, 3)):
                        node(c, "p", (), _words(r, r.randint(3, 60)))
            else:
                for _ in range(r.randint(0, 3)):
                    node(box, r.choice(["p", "div", "label", "h3"]), (), _words(r, r.randint(1, 30)), link=r.choice([0, 0, 1.0]))

        root = node(None, "html", good=True)
        for kind in ("header", "nav", "div", "aside"):
            for _ in range(r.choice([0, 1, 1, 2])):
                apart(root, kind)
        body = root
        if r.random() < 0.6:
            body = node(body, r.choice(["main", "div", "section"]), r.sample(ARTICLE.split(), r.randint(0, 2)), good=True)
        art = node(body, r.choice(["article", "article", "div", "section", "main"]), r.sample(ARTICLE.split(), r.randint(0, 2)), good=True)
        node(art, r.choice(["h1", "h1", "h2"]), (), _words(r, r.randint(1, 14)), good=True)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                node(art, "p", (), _words(r, r.choice([1, 2, 5, 20, 60, 200])), good=True, link=r.choice([0, 0, 0, 0, 0.2]))
            elif kind < 0.8:
                node(art, r.choice(["h2", "h3"]), (), _words(r, r.randint(1, 8)), good=True)
            elif kind < 0.86:
                ul = node(art, r.choice(["ul", "ol"]), (), good=True)
                for _ in range(r.randint(2, 6)):
                    node(ul, "li", (), _words(r, r.randint(1, 25)), good=True)
            elif kind < 0.9:
                q = node(art, "blockquote", (), "" if r.random() < 0.5 else _words(r, 15), good=True)
                node(q, "p", (), _words(r, r.randint(5, 40)), good=True)
            elif kind < 0.94:
                tab = node(node(art, "table", (), good=True), "tr", (), good=True)
                for _ in range(3):
                    node(tab, "td", (), _words(r, r.randint(1, 3)), good=True)
            elif kind < 0.96:
                node(art, "pre", (), _words(r, 30), good=True)
            else:
                apart(art, r.choice(["div", "aside", "form"]))
        for kind in ("section", "aside", "form", "div", "footer"):
            for _ in range(r.choice([0, 1, 1])):
                apart(body if r.random() < 0.3 else root, kind)
        out.append((root, content))
    return out


class Model:
    """Log potentials: of features given content, and of a child's state given its parent's."""

    def __init__(self, pages: list[tuple[Node, set[int]]]):
        seen = {True: Counter(), False: Counter()}
        ties: dict[tuple[bool, bool], float] = defaultdict(lambda: 1.0)
        states: Counter = Counter()
        for root, content in pages:
            stack = [(root, 0)]
            while stack:
                x, depth = stack.pop()
                y = id(x) in content
                states[y] += 1
                seen[y].update(features(x, depth))
                for c in x.children:
                    ties[y, id(c) in content] += 1
                    stack.append((c, depth + 1))
        names = set(seen[True]) | set(seen[False])
        rate = lambda f, y: (seen[y][f] + 0.3) / (states[y] + 0.6)
        self.own = {f: math.log(rate(f, True)) - math.log(rate(f, False)) for f in names}
        self.tie = {(a, b): math.log(ties[a, b] / (ties[a, True] + ties[a, False])) for a in (True, False) for b in (True, False)}

    def potential(self, node: Node, depth: int) -> float:
        """Log odds of content from the node alone.  Hidden nodes are never content."""
        return -30.0 if node.hidden else sum(self.own.get(f, 0.0) for f in features(node, depth))

    def marginals(self, root: Node) -> dict[int, float]:
        """Sum-product: messages from the leaves up, then from the root down; exact on a tree."""
        order = [(root, 0)]
        for x, depth in order:
            order.extend((c, depth + 1) for c in x.children)
        tt, tf, ft, ff = (math.exp(self.tie[k]) for k in ((True, True), (True, False), (False, True), (False, False)))
        belief, message = {}, {}
        for x, depth in reversed(order):
            b = (8.0 if x is root else self.potential(x, depth)) + sum(message[id(c)] for c in x.children)
            b = max(-40.0, min(40.0, b))
            belief[id(x)] = b
            e = math.exp(b)
            message[id(x)] = math.log((tt * e + tf) / (ft * e + ff))
        out = {id(root): belief[id(root)]}
        for x, _ in order:
            for c in x.children:
                rest = max(-40.0, min(40.0, out[id(x)] - message[id(c)]))  # the parent without what this child told it
                e = math.exp(rest)
                down = math.log((tt * e + ft) / (tf * e + ff))
                out[id(c)] = belief[id(c)] + down
        return {k: 1 / (1 + math.exp(-max(-40.0, min(40.0, v)))) for k, v in out.items()}


@functools.cache
def model(pages: int = 600, seed: int = 7) -> Model:
    return Model(training_pages(pages, seed))


def main_text(page: str | None, m: Model | None = None, threshold: float = 0.5) -> tuple[str, int, int]:
    """The main text, the number of blocks with text, and how many of them are content."""
    m = m or model()
    root = parse(page or "")
    p = m.marginals(root)
    lines, total = [], 0
    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            total += 1
            if x[1]:
                lines.append(x[0])
        else:
            good = p[id(x)] > threshold
            stack.extend(s if isinstance(s, Node) else (s, good) for s in reversed(own_blocks(x)))
    return "\n".join(lines), total, len(lines)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_content of every page.

    Null html gives an empty text, as does a page without content blocks.  Null ids and urls and repeated rows
    are kept as they come; no rows give no rows; pages of any length and depth are read whole.
    """
    prepare(pages.sparkSession)

    def make():
        m = model()

        def step(b: pa.RecordBatch):
            got = [main_text(h, m) for h in b.column(2).to_pylist()]
            yield {"page_id": b.column(0).to_pylist(), "url": b.column(1).to_pylist(), "text": [g[0] for g in got], "n_chars": [len(g[0]) for g in got], "n_blocks": [g[1] for g in got], "n_content": [g[2] for g in got]}

        return step

    d = narrow(pages, page_id=id_col, url=url_col, html=html_col)
    return map_batches(d.withColumn("page_id", d.page_id.cast("bigint")), make, "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_content int")
