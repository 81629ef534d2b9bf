"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a hidden state, content or not.  A node has potentials from what can be seen of
it (its tag, all hints in its class and id, how much text and links it has) and an edge potential with its
parent, which depends on what both are.  Sum-product messages go from the leaves to the root and back; a block's
text is kept if the marginal of its node says content.  All potentials are frequencies counted on labelled pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:/?>|(?=<)|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")

#: Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "select", "title", "canvas", "audio", "video"}
#: Of these the content is not markup; it ends at the closing tag alone.
UNPARSED = {"script", "style", "textarea", "title", "noscript", "iframe"}
#: Elements that may stand in a head; any other one, and text, ends it as the body's first.
HEAD = {"meta", "link", "base", "title", "script", "style", "noscript", "template"}
#: Elements that make a block.
BLOCKS = {
    "html", "body", "div", "p", "article", "main", "section", "header", "footer", "nav", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li",
    "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "form", "fieldset",
    "address", "details", "summary", "dialog", "menu", "center", "hr",
}
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "col", "area", "base", "embed", "source", "track", "param"}
#: An opening tag closes an open element of these kinds, up to the container that holds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

#: Words in class, id and role, by what they tell; an element has all hints that match.
HINTS = (
    ("comment", re.compile(r"comment|discuss|disqus|repl(?:y|ies)|respon[ds]|feedback|talkback", re.I)),
    ("advert", re.compile(r"\bads?\b|\bad[-_]|[-_]ad\b|advert|sponsor|promo|banner|teaser", re.I)),
    ("notice", re.compile(r"cookie|consent|notice|gdpr|alert|popup|modal|newsletter|subscribe|signup|paywall|toast", re.I)),
    ("menu", re.compile(r"nav|menu|breadcrumb|pagination|pager|toolbar|tabs?\b|toc\b", re.I)),
    ("side", re.compile(r"side|aside|widget|related|recommend|share|social|popular|trending|tags?\b|meta\b|byline", re.I)),
    ("frame", re.compile(r"foot|header|masthead|copyright|legal|search|login|form", re.I)),
    ("content", re.compile(r"article|content|main|post|entry|story|body|text", re.I)),
    ("layout", re.compile(r"wrap|layout|container|column|page|site|grid|row|with|has", re.I)),
)
#: Words of a block's own text that tell what it is for.
CUES = (
    ("rights", re.compile(r"©|\(c\) *\d{4}|copyright|all rights reserved", re.I)),
    ("consent", re.compile(r"\bcookies?\b|privacy policy|\bsubscribe\b|newsletter|sign up", re.I)),
)


class Node:
    __slots__ = ("tag", "hints", "label", "parent", "children", "chars", "links", "cues", "depth")

    def __init__(self, tag: str, parent: int, hints: tuple[str, ...], label: str | None, depth: int):
        self.tag, self.parent, self.hints, self.label, self.depth = tag, parent, hints, label, depth
        self.children: list[int] = []
        self.cues: tuple[str, ...] = ()
        self.chars = self.links = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order (a parent stands before its children) and text pieces (node, text), blanks made single."""
    nodes = [Node("root", -1, (), None, 0)]
    stack, pieces, held = [0], [], []
    #: how many open elements there are of each tag, so that one that isn't open is not looked for
    opened: Counter = Counter()
    raw: str | None = None
    depth = link = 0
    head = False
    unclosed: set[str] = set()

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", "".join(t for t, _ in held)).strip()
            if text:
                if len(stack) == 1:  # text beside all elements is a block of its own
                    nodes.append(Node("p", 0, (), None, 1))
                    nodes[0].children.append(len(nodes) - 1)
                own = stack[-1] or len(nodes) - 1
                node = nodes[own]
                node.chars += len(text)
                node.links += sum(len(t.strip()) for t, in_link in held if in_link)
                if len(text) <= 300:
                    node.cues += tuple(k for k, r in CUES if k not in node.cues and r.search(text))
                pieces.append((own, text))
            held.clear()

    def close(place: int) -> None:
        """Closes the open elements from a place of the stack on."""
        opened.subtract(nodes[i].tag for i in stack[place:])
        del stack[place:]

    at = 0
    while at < len(page):
        match = _TOKEN.match(page, at)
        at = match.end()
        name = match[2]
        if name is None:
            if raw is None and not match[0].startswith(("<!", "<?", "</")):
                text = html.unescape(match[0])
                if head and text.strip():
                    head = False
                if not head:
                    held.append((text, link > 0))
            continue
        name, closing = name.lower(), bool(match[1])
        if raw == "select" and not closing and name in BLOCKS and name != "hr":
            raw = None  # it was never closed: a block can't stand in it
        if raw is not None:
            if name == raw:
                depth += -1 if closing else 1
                if not depth:
                    raw = None
            continue
        if name == "head":
            head = not closing and (len(nodes) == 1 or (len(nodes) == 2 and nodes[1].tag == "html"))
            continue
        if head and not closing and name not in HEAD:
            head = False
        if name in RAW:
            if not closing and not match[0].endswith("/>") and name not in unclosed:
                if name in UNPARSED:
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                elif name == "select" or re.compile(rf"</{name}\b", re.I).search(page, at):
                    raw, depth = name, 1
                else:  # without an end it holds nothing
                    unclosed.add(name)
                held.append((" ", False))
            continue
        if name == "a":
            link = 0 if closing else 1
        if name not in BLOCKS:
            if name in ("br", "button", "input", "img"):
                held.append((" ", False))
            continue
        if name in ("html", "body") and (closing or opened[name]):
            continue
        if closing:
            place = next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == name), 0) if opened[name] else 0
            if place or name == "p":  # other stray closing tags mean nothing
                flush()
                link = 0
            if place:
                close(place)
            continue
        flush()
        link = 0
        if nodes[stack[-1]].tag == "p":  # a block can't stand in a paragraph
            close(len(stack) - 1)
        if name in CLOSES:
            own, limits = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in own) else ():
                tag = nodes[stack[k]].tag
                if tag in limits:
                    break
                if tag in own:
                    close(k)
                    break
        hints, label = (), None
        if match[3]:
            words = []
            for a in _ATTRIBUTE.finditer(match[3]):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-label":
                    label = value
                else:
                    words.append(value)
            if words:
                joined = " ".join(words)
                hints = tuple(k for k, r in HINTS if r.search(joined)) or ("other",)
        nodes.append(Node(name, stack[-1], hints, label, len(stack)))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if name not in VOID:
            stack.append(len(nodes) - 1)
            opened[name] += 1
    flush()
    return nodes, pieces


_KINDS = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"), **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), **dict.fromkeys(("li", "dt", "dd"), "item"), **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "table"), **dict.fromkeys(("form", "fieldset"), "form"), **dict.fromkeys(("html", "body", "root"), "root")}


def edge_kinds(nodes: list[Node], i: int) -> tuple[str, ...]:
    """What an edge's potential depends on, from special to general: tags and hints of parent and node, less and less of them."""
    node, over = nodes[i], nodes[nodes[i].parent]
    tag, above = _KINDS.get(node.tag, node.tag), _KINDS.get(over.tag, over.tag)
    own, upper = "+".join(node.hints), "+".join(over.hints)
    return f"{above}.{upper}>{tag}.{own}", f"{above}.{upper}>{tag}", f"{above}>{tag}.{own}", f"{above}>{tag}", tag


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(nodes: list[Node]) -> list[tuple[str, ...]]:
    """What is seen of each node, as named values: tag, hints and cues, own text, links in the subtree, share of the page's text."""
    chars = [n.chars for n in nodes]
    links = [n.links for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        links[nodes[i].parent] += links[i]
    whole = max(1, chars[0])
    out = []
    for n, c, a in zip(nodes, chars, links):
        out.append((
            f"tag={_KINDS.get(n.tag, n.tag)}", f"text={_bucket(n.chars, (1, 20, 80, 250))}",
            f"links={_bucket(a / c if c else -1.0, (0.0, 0.05, 0.4, 0.9))}", f"share={_bucket(c / whole, (0.02, 0.2, 0.6))}",
            *(f"hint={h}" for h in n.hints or ("",)), *(f"cue={k}" for k in n.cues),
        ))
    return out


def labels(nodes: list[Node]) -> list[int]:
    """States of a labelled page: data-label holds for an element and what it contains until another one says otherwise."""
    out = []
    for n in nodes:
        own = {"content": 1, "other": 0}.get(n.label)
        out.append(own if own is not None else out[n.parent] if n.parent >= 0 else 0)
    return out


#: Edges of a kind seen on labelled pages for the kind to have potentials of its own.
LEAST_EDGES = 20


class Model:
    """Log potentials from counts of (what, state) and (edge kind, parent's state, state)."""

    def __init__(self, counts: dict[str, int]):
        self.seen: dict[str, list[float]] = {}
        self.edges: dict[str, list[list[float]]] = {}
        total = [counts.get("state=0", 0) + 1.0, counts.get("state=1", 0) + 1.0]
        seen: dict[str, list[float]] = {}
        edges: dict[str, list[list[float]]] = {}
        for key, n in counts.items():
            what, _, states = key.rpartition("|")
            if what.startswith("edge="):
                edges.setdefault(what[5:], [[0.5, 0.5], [0.5, 0.5]])[int(states[0])][int(states[1])] += n
            elif what:
                seen.setdefault(what, [0.5, 0.5])[int(states)] += n
        self.seen = {k: [math.log(v / t) for v, t in zip(row, total)] for k, row in seen.items()}
        self.edges = {k: [[math.log(v / sum(row)) for v in row] for row in rows] for k, rows in edges.items() if sum(map(sum, rows)) >= LEAST_EDGES + 2}
        self.plain = [[math.log(0.8), math.log(0.2)], [math.log(0.2), math.log(0.8)]]

    def edge(self, nodes: list[Node], i: int) -> list[list[float]]:
        """Potentials (parent's state, state) of a node's edge: those of its most special kind that was seen often enough."""
        return next((e for k in edge_kinds(nodes, i) if (e := self.edges.get(k))), self.plain)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of each node, by messages to the root and back.  The root is no content."""
        n = len(nodes)
        own = [[0.0, 0.0] for _ in range(n)]
        for i, seen in enumerate(features(nodes)):
            for f in seen:
                v = self.seen.get(f)
                if v is not None:
                    own[i][0] += v[0]
                    own[i][1] += v[1]
        edge = [self.plain, *(self.edge(nodes, i) for i in range(1, n))]
        belief = [list(o) for o in own]  # potential of a node and the messages from its children
        up = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            e, (b0, b1) = edge[i], belief[i]
            m = (_add(e[0][0] + b0, e[0][1] + b1), _add(e[1][0] + b0, e[1][1] + b1))
            top = max(m)
            up[i] = (m[0] - top, m[1] - top)
            p = belief[nodes[i].parent]
            p[0] += up[i][0]
            p[1] += up[i][1]
        belief[0][1] += -20.0
        out = [0.0] * n
        for i in range(n):
            b0, b1 = belief[i]
            if i:
                p, e = belief[nodes[i].parent], edge[i]
                q0, q1 = p[0] - up[i][0], p[1] - up[i][1]  # the parent's belief without this child's message
                d0, d1 = _add(q0 + e[0][0], q1 + e[1][0]), _add(q0 + e[0][1], q1 + e[1][1])
                top = max(d0, d1)
                b0, b1 = b0 + d0 - top, b1 + d1 - top
            top = max(b0, b1)
            belief[i] = [b0 - top, b1 - top]
            out[i] = 1.0 / (1.0 + math.exp(min(700.0, b0 - b1)))
        return out

    def text(self, page: str | None) -> tuple[str, int, float]:
        """The page's main text, its blocks, and the least certainty among all blocks with text."""
        if not page:
            return "", 0, 1.0
        nodes, pieces = parse(page)
        p = self.marginals(nodes)
        kept = [t for i, t in pieces if p[i] > 0.5]  # a tie is no content
        return "\n".join(kept), len(kept), float(min((abs(2 * p[i] - 1) for i, _ in pieces), default=1.0))


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(labelled: DataFrame) -> Model:
    """The model of labelled pages (html): see labels().  The counts' table has a row a kind of observation."""
    small_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                nodes, _ = parse(page or "")
                states = labels(nodes)
                for i, (n, own, s) in enumerate(zip(nodes, features(nodes), states)):
                    seen.update(f"{f}|{s}" for f in own)
                    seen[f"state={s}"] += 1
                    if n.parent >= 0:
                        seen.update(f"edge={k}|{states[n.parent]}{s}" for k in edge_kinds(nodes, i))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["what", "n"])

    sums = labelled.select(F.col("html").cast("string")).mapInArrow(count, "what string, n bigint").groupBy("what").agg(F.sum("n").alias("n"))
    return Model({r["what"]: r["n"] for r in sums.collect()})  # tags and hints are fixed lists, so this is small


def labelled_page(rng: random.Random) -> str:
    """A page in one of many common layouts, with its main text marked by data-label."""

    def words(low: int, high: int) -> str:
        made = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
        return " ".join(made).capitalize() + rng.choice(["", ".", ".", "."])

    named = lambda *names: rng.choice(names)
    chance = lambda p: rng.random() < p
    link = lambda low=1, high=2: f'<a href="/x">{words(low, high)}</a>'
    row = lambda: named(" ", " | ", " - ").join(link() for _ in range(rng.randint(2, 7)))
    listed = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"
    menu = lambda: listed() if chance(0.75) else named("{}", "<p>{}</p>", "<div>{}</div>").format(row())
    rights = lambda: named("&copy; ", "Copyright ", "&copy; 2020 ", "") + words(2, 14) + named("", " All rights reserved.")

    def inside() -> str:
        """A block that stands in the article but is no part of it."""
        return named(
            f'<div class="{named("ad", "advert", "promo", "related", "newsletter")}" data-label="other"><p>{words(2, 25)}</p></div>',
            f'<aside data-label="other"><p>{words(4, 30)}</p></aside>',
            f'<div class="{named("share", "social", "tags", "related")}" data-label="other">{row()}</div>',
            f'<form data-label="other"><p>{words(2, 12)}</p><button>{words(1, 1)}</button></form>',
        )

    def body() -> list[str]:
        out = []
        if chance(0.9):
            title = f"<h1>{words(2, 12)}</h1>"
            byline = f'<{(t := named("p", "div"))} class="{named("meta", "byline", "entry-meta", "post-meta")}" data-label="other">{words(1, 5)} {link()}</{t}>' if chance(0.2) else ""
            out.append(f"<header{named('', ' class=entry-header')}>{title}{byline}</header>" if chance(0.25) else title + byline)
        for _ in range(rng.randint(1, 9)):
            x = rng.random()
            if x < 0.02:
                out.append(f"<p>{link(3, 20)}</p>")
            elif x < 0.70:
                out.append(f"<p>{words(1, 90)}{' ' + link() + ' ' + words(3, 20) if chance(0.15) else ''}</p>")
            elif x < 0.76:
                out.append(f"<p><b>{words(2, 15)}<br>")
            elif x < 0.81:
                out.append(f"<{(h := named('h2', 'h3'))}>{words(1, 7)}</{h}>")
            elif x < 0.86:
                out.append("<ul>" + "".join(f"<li>{words(2, 18)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif x < 0.89:
                out.append(f"<blockquote><p>{words(5, 40)}</p></blockquote>")
            elif x < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif x < 0.93:
                out.append(f"<pre>{words(3, 30)}</pre>")
            elif x < 0.95:
                out.append(f"<figure><figcaption>{words(2, 12)}</figcaption></figure>")
            else:
                out.append(inside())
        if chance(0.08):
            out.append(f'<footer data-label="other">{named(row(), words(2, 8))}</footer>')
        return out

    around = {
        "header": lambda: f"<header>{named('', '<h1>' + words(1, 4) + '</h1>')}<p>{words(1, 8)}</p></header>" if chance(0.7) else f'<div class="{named("header", "masthead")}">{named(words(1, 4), "<h1>" + words(1, 4) + "</h1>", link())}</div>',
        "nav": lambda: f"<nav>{menu()}</nav>" if chance(0.6) else f'<{(t := named("div", "ul"))} class="{named("menu", "navbar", "breadcrumb")}">{menu()}</{t}>' if chance(0.7) else menu(),
        "ad": lambda: f'<div class="{named("ad", "ads", "advert", "sponsored", "banner")}">{named(words(3, 30), "<p>" + words(3, 30) + "</p>")}</div>',
        "notice": lambda: f'<div class="{named("cookie-notice", "consent", "alert", "newsletter", "popup")}"><p>{words(4, 35)}</p></div>',
        "side": lambda: f"<aside><h3>{words(1, 4)}</h3>{menu()}<p>{words(3, 25)}</p></aside>" if chance(0.6) else f'<div class="{named("sidebar", "widget", "related", "side-column")}"><h3>{words(1, 3)}</h3>{menu()}</div>',
        "form": lambda: f'<form class="{named("search", "login", "")}"><p>{words(1, 6)}</p><label>{words(1, 2)}</label><button>{words(1, 1)}</button></form>',
    }
    comments = f'<{(box := named("div", "section"))} {named("id", "class")}="{named("comments", "comment-list", "responses", "discussion")}"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="{named("comment", "reply")}"><p>{words(3, 60)}</p></div>' for _ in range(rng.randint(1, 6))) + f"</{box}>"
    if chance(0.15):
        comments = f'<ol class="{named("responses", "comment-list", "commentlist")}">' + "".join(f"<li>{named('<p>{}</p>', '{}').format(words(3, 60))}</li>" for _ in range(rng.randint(1, 6))) + "</ol>"
    before = "".join(around[k]() for k in rng.sample(["header", "nav", "ad", "notice", "form", "side"], rng.randint(0, 4)))
    after = "".join(around[k]() for k in rng.sample(["side", "ad", "nav", "notice", "form"], rng.randint(0, 3)))
    within = chance(0.1)
    after = (comments if not within and chance(0.4) else "") + after
    footer = f"<footer>{named('', menu())}{named(rights(), '<p>' + rights() + '</p>')}</footer>" if chance(0.7) else f'<div class="{named("footer", "copyright")}">{rights()}</div>' if chance(0.6) else named("", f"<p>&copy; {words(1, 6)}</p>")

    blocks, layout = body(), rng.random()
    if layout < 0.18:  # no wrapper: each block of the text stands among the others
        labelled = [b if b.startswith("<p><b>") or "data-label" in b.split(">", 1)[0] else re.sub(r"^<(\w+)", r'<\1 data-label="content"', b) for b in blocks]
        inner = "".join(b.replace("<p>", '<p data-label="content">', 1) if b.startswith("<p><b>") else b for b in labelled)
        page = before + (f"<div{named('', ' class=' + named('page', 'wrapper', 'container'))} data-label=content>{inner}</div>" if chance(0.25) else inner) + after + footer
    elif layout < 0.28:  # a table makes the columns
        cells = [f"<td>{menu()}</td>", f'<td data-label="content">{"".join(blocks)}</td>', *([f"<td>{named(menu(), words(3, 20))}</td>"] if chance(0.4) else [])]
        page = f"<table>{named('', '<tr><td>' + words(1, 6) + '</td></tr>')}<tr>{''.join(cells)}</tr>{named('', '<tr><td>' + rights() + '</td></tr>')}</table>{named('', footer)}"
    else:
        main = named("article", "article", "main", "div", "div", "section")
        attribute = f' class="{named("content", "post", "entry-content", "article-body", "story", "main-text", "content-with-sidebar", "post has-ads")}"' if main in ("div", "section") or chance(0.3) else ""
        inner = "".join(blocks) + (comments.replace(">", ' data-label="other">', 1) if within else "")
        page = f'<{main}{attribute} data-label="content">{inner}</{main}>'
        if chance(0.3):
            around_it = named("content-with-sidebar", "has-sidebar", "wrapper", "layout two-columns", "site-content with-ads", "main-wrap", "container", "page", "nav-open page", "body", "site", "site-main", "site-content")
            page = f'<div class="{around_it}">{named("", around["side"]())}{page}{named("", around["side"](), around["ad"]())}</div>'
        page = before + page + after + footer
    if chance(0.03):
        return f'<div data-label="content">{" ".join(words(5, 60) for _ in range(rng.randint(1, 4)))}</div>'
    if chance(0.05):
        page = f'<form id="{named("form1", "aspnetForm", "page")}">{page}</form>'
    return f"<html><body>{page}</body></html>"


#: Labelled pages made for training, and their seed; both fixed, whatever is extracted later.
LABELLED, SEED = 2000, 11


def labelled_pages(spark: SparkSession, n: int = LABELLED, seed: int = SEED) -> DataFrame:
    """A bounded sample of n labelled pages (html): made, not taken from any corpus."""
    rng = random.Random(seed)
    return spark.createDataFrame([(labelled_page(rng),) for _ in range(n)], "html string").repartition(8)


def extracted(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """A row each row of pages (page_id, url, html): page_id, url, text, n_chars, n_blocks, certainty.

    text joins the blocks by one newline; character references are decoded, white space in a block is one blank,
    `<br>` counts as white space.  Null and empty pages and pages without content give the empty text; a page without tags is one block.  A block at a
    probability of just one half is left out; repeated rows are extracted each for itself; pages are read as wholes, in time that grows with
    their length, however deep they nest.  labelled:
    pages to train on, with data-label="content" or "other" on elements; by default labelled_pages().
    """
    spark = pages.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(labelled_pages(spark) if labelled is None else labelled))

    @F.pandas_udf("text string, n_chars bigint, n_blocks bigint, certainty double")
    def extract(texts: pd.Series) -> pd.DataFrame:
        tidy()
        rows = [model.value.text(t) for t in texts]
        return pd.DataFrame([(t, len(t), n, c) for t, n, c in rows], columns=["text", "n_chars", "n_blocks", "certainty"])

    return pages.select("page_id", "url", extract(F.col("html").cast("string")).alias("x")).select("page_id", "url", "x.*")


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extracted(table(spark, sf_dir, "pages"))
