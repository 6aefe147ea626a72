"""Main text of web pages by a tree-structured graphical model.

Each block element is a node that is content or not. What a node says about
itself (its tag, the words of its class, id and role, the share of its text
that is links, how much text it has) gives its own potential; a potential
between parent and child carries the judgement along the tree. Sum-product
messages go up from the leaves and down from the root once, which gives each
node's exact marginal; text under nodes above one half is the main text. Both
potentials are counted on labelled pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.labelled_pages import PAGES, named_parts

# fixed values: element kinds of HTML, and words of class, id and role attributes
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template textarea iframe svg math object canvas audio video title head select option datalist".split())
RAW = set("script style textarea title iframe noscript template".split())
ENDS = {  # an opening tag ends these open elements
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
NO_PARAGRAPH = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "p": NO_PARAGRAPH - {"p"} | {"td", "th", "li", "body"}}
KINDS = {
    "article": "article main", "section": "section", "div": "div center", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li dt dd",
    "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset button dialog legend", "table": "table thead tbody tfoot tr td th caption",
    "quote": "blockquote pre", "figure": "figure figcaption", "page": "body html", "head": "head title",
}
KIND = {tag: kind for kind, tags in KINDS.items() for tag in tags.split()}
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense banner",
    "comments": "comment comments disqus reply replies respond discussion",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe subscription paywall toast dialog",
    "nav": "nav navigation navbar menu menus breadcrumb breadcrumbs pager pagination toc tabs toolbar",
    "side": "sidebar aside related recommended recommendations widget widgets complementary trending popular tags",
    "foot": "footer foot copyright legal contentinfo imprint",
    "head": "header masthead logo topbar branding",
    "form": "login signin signup search form register",
    "share": "share sharing social follow",
    "hidden": "hidden invisible",
    "content": "article content post entry story main body text articlebody",
}
HINT = {word: hint for hint, words in HINTS.items() for word in words.split()}
RANK = {hint: i for i, hint in enumerate(HINTS)}  # the first one counts

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ROOT = "body"


def parse(page: str):
    """Nodes (parent, tag, attributes) in page order, and chunks (node, text, characters under links)."""
    parents, tags, attributes = [-1], [ROOT], [""]
    chunks: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements (tag, own or nearest block node)
    parts: list[str] = []
    node, links, hidden, linked = 0, 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            chunks.append((node, text, linked))
        parts.clear()
        linked = 0

    def close(upto: int):
        """Ends the open elements from place `upto` on."""
        nonlocal node, links, hidden
        for tag, _ in stack[upto:]:
            links -= tag == "a"
            hidden -= tag in HIDDEN
        if any(tag not in INLINE for tag, _ in stack[upto:]):
            flush()
        del stack[upto:]
        node = stack[-1][1] if stack else 0

    def last(wanted: set[str], fence: set[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in wanted:
                return i
            if stack[i][0] in fence:
                break
        return -1

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if not hidden and not text.startswith(("<!", "<?")):
                text = entities.unescape(text) if "&" in text else text
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        tag = tag.lower()
        if m[1]:
            i = last({tag}, set())
            if i >= 0:
                close(i)
            continue
        if tag in NO_PARAGRAPH and tag not in ENDS and (i := last({"p"}, FENCE["p"])) >= 0:
            close(i)
        if tag in ENDS and (i := last(ENDS[tag], FENCE.get(tag, set()))) >= 0:
            close(i)
        if tag in EMPTY:
            if tag in ("br", "hr"):
                parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if m[3].endswith("/") and tag in ("svg", "iframe", "object"):
            continue
        if tag not in INLINE:
            flush()
            parents.append(node)
            tags.append(tag)
            attributes.append(m[3])
            node = len(parents) - 1
        stack.append((tag, node))
        links += tag == "a"
        hidden += tag in HIDDEN
        if tag in RAW:  # no markup inside
            stop = re.compile(f"</{tag}", re.I).search(page, at)
            at = stop.start() if stop else end
    close(0)
    flush()
    return parents, tags, attributes, chunks


def hint(attributes: str) -> str:
    """The telling word group of an element's class, id, role and the like."""
    found = []
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            found.append("hidden")
        elif name in ("class", "id", "role", "itemprop", "aria-label"):
            found += [HINT[w] for x in WORD.findall(value) if (w := x.lower()) in HINT]
    return min(found, key=RANK.__getitem__, default="none")


def features(parents, tags, attributes, chunks) -> list[tuple[str, ...]]:
    """What each node says about itself."""
    n = len(parents)
    own, below, linked = [0] * n, [0] * n, [0] * n
    for node, text, inside in chunks:
        own[node] += len(text)
        below[node] += len(text)
        linked[node] += min(inside, len(text))
    for i in range(n - 1, 0, -1):
        below[parents[i]] += below[i]
        linked[parents[i]] += linked[i]
    out = []
    for i in range(n):
        density = linked[i] / below[i] if below[i] else 0
        out.append((
            "kind " + KIND.get(tags[i], "other"),
            "hint " + (hint(attributes[i]) if attributes[i] else "none"),
            "links " + ("some" if 0 < density < 0.4 else "many" if density else "no"),
            "own " + ("none" if not own[i] else "short" if own[i] < 60 else "long" if own[i] < 200 else "very long"),
        ))
    return out


def labels(parents, attributes) -> list[int]:
    """Labels of a training page's nodes, from the nearest data-y around each."""
    label: list[int] = []
    for parent, own in zip(parents, attributes, strict=True):
        mark = re.search(r'data-y="([01])"', own)
        label.append(int(mark[1]) if mark else label[parent] if label else 0)
    return label


def holder(told: tuple[str, ...]) -> str:
    """What a node is to its children: its kind, or an article if its name says so."""
    return "article" if told[1] == "hint content" else told[0].removeprefix("kind ")


class Model:
    """Potentials counted on labelled pages."""

    def __init__(self, pages: list[str]):
        own: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
        pair = defaultdict(lambda: np.full((2, 2), 0.5))
        total = [1.0, 1.0]
        for page in pages:
            parents, tags, attributes, chunks = parse(page)
            label = labels(parents, attributes)
            for i in range(len(parents) - 1, 0, -1):  # what holds content is on the way to it
                label[parents[i]] |= label[i]
            told = features(parents, tags, attributes, chunks)
            for i, parent in enumerate(parents):
                total[label[i]] += 1
                for f in told[i]:
                    own[f][label[i]] += 1
                if i:
                    for kind in (holder(told[parent]), "any"):
                        pair[kind][label[parent], label[i]] += 1
        self.own = {f: (c[0] / total[0], c[1] / total[1]) for f, c in own.items()}
        self.own["kind page"] = (1e-6, 1.0)  # the page as a whole holds whatever content there is
        prior = np.array(total) / sum(total)
        # by the parent's kind, leaning on all kinds where it is rare
        shared = pair["any"] / pair["any"].sum(axis=1, keepdims=True)
        self.pair = {kind: (c := counts + 4 * shared) / c.sum(axis=1, keepdims=True) for kind, counts in pair.items()}
        self.pair = {kind: rows.tolist() for kind, rows in self.pair.items()}
        self.prior = prior.tolist()

    def marginals(self, parents: list[int], told: list[tuple[str, ...]]) -> list[float]:
        """P(content) of each node given the whole tree: messages up, then down."""
        n = len(parents)
        here = []  # own potential times the messages of the children so far
        for fs in told:
            a = b = 1.0
            for f in fs:
                p = self.own.get(f, (1.0, 1.0))
                a, b = a * p[0], b * p[1]
            here.append([a / (a + b), b / (a + b)])
        between = [self.pair.get(holder(fs), self.pair["any"]) for fs in told]
        up = [None] * n
        for i in range(n - 1, 0, -1):
            a, b = here[i]
            (k00, k01), (k10, k11) = between[parents[i]]
            m0, m1 = k00 * a + k01 * b, k10 * a + k11 * b
            up[i] = (m0, m1)
            p = here[parents[i]]
            p0, p1 = p[0] * m0, p[1] * m1
            s = p0 + p1
            p[0], p[1] = p0 / s, p1 / s
        out = [0.0] * n
        belief: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n):
            a, b = here[i]
            if i:
                (k00, k01), (k10, k11) = between[parents[i]]
                q0, q1 = belief[parents[i]]  # without what came from here
                q0, q1 = q0 / up[i][0], q1 / up[i][1]
                a, b = a * (q0 * k00 + q1 * k10), b * (q0 * k01 + q1 * k11)
            else:
                a, b = a * self.prior[0], b * self.prior[1]
            belief[i] = (a / (a + b), b / (a + b))
            out[i] = belief[i][1]
        return out

    def text(self, page: str | None) -> str:
        parents, tags, attributes, chunks = parse(page or "")
        marginal = self.marginals(parents, features(parents, tags, attributes, chunks))
        return "\n".join(text for node, text, _ in chunks if marginal[node] > 0.5)


def train() -> Model:
    return Model(PAGES + named_parts({hint: words for hint, words in HINTS.items() if hint != "content"}, HINTS["content"]))


def _extracted(model):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            texts, done, size = [], 0, 0
            for i, page in enumerate(batch.column(2)):
                texts.append(model.text(page.as_py()))
                size += len(texts[-1])
                if size > 16_000_000 or i == batch.num_rows - 1:
                    part = batch.slice(done, i + 1 - done)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema=schema)
                    texts, done, size = [], i + 1, 0

    return run, "page_id long, url string, text string"


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of pages(page_id, url, html, ...): page_id, url, text.

    Blocks of the main text stand in page order, a line each, with character
    references decoded and white space as single spaces. A null or empty page,
    or one without main text, has an empty text. Pages are read whole, broken
    markup included. Repeated rows and null ids keep their rows. Other columns
    are not looked at. An empty table gives an empty result.
    """
    run, schema = _extracted(model or train())
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, schema)
