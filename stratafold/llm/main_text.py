"""Main text of web pages by site template removal.

Two passes. The first hashes every element subtree (its tags, attributes and text) and Spark counts,
per host, the pages that hold it. The second deletes the subtrees that recur across many pages of
their host, and those whose tag or class says that they are no article, and joins the blocks that
are left.

Articles can be copies of each other, so inside an article (or main) element only subtrees without
running text are compared with the host's other pages, and what holds an article is never compared.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratafold.operators.lookup import lookup_join
from stratafold.session import stage

# fixed values: HTML element names by role
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr",
}
DROPPED = RAW | {
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "canvas", "object",
    "audio", "video", "math", "map", "fieldset", "datalist", "input",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "ul", "dd", "dt",
}
#: An open element of the left name ends where one of the right names begins.
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "p": CLOSES_P,
}
#: Words of class, id or role that name something other than the article.
NAMED = {
    "ad", "ads", "adslot", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "commentlist", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup",
    "promo", "promoted", "promotion", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
#: A class with one of these words tells how a page or its main part is laid out, not what it is.
LAYOUT = {"with", "without", "no", "not", "has", "have", "main", "content", "layout"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies"}
ARTICLE = {"article", "main"}
#: Elements of running text; a subtree inside an article that holds one is never template.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "figure", *ARTICLE}
#: Deeper elements become neighbours of their parents' last child, as in browsers.
DEEPEST = 400

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class TemplateLimits:
    """A subtree recurs if it stands on at least ``pages`` pages of its host and on at least ``share``
    of them."""

    pages: int = 5
    share: float = 0.2


class Node:
    """An open or closed element: its name, role and what it holds (texts and elements)."""

    __slots__ = ("name", "mark", "parts", "boilerplate", "plain", "article")

    def __init__(self, name: str, mark: str, boilerplate: int):
        self.name, self.mark, self.boilerplate = name, mark, boilerplate
        self.parts: list = []  # boilerplate: 1 by its class, id or role, 2 by its element or as hidden
        self.plain = name not in RUNNING  # holds no running text
        self.article = name in ARTICLE  # is or holds an article

    def digest(self, wanted: list | None = None, inside: bool = False) -> bytes:
        """Hash of the subtree. ``wanted`` collects (node, hash) of those that may be template."""
        inside = inside or self.name in ARTICLE
        summary = blake2b(self.mark.encode("utf-8", "replace"), digest_size=8)
        for part in self.parts:
            if isinstance(part, str):
                summary.update(b"\x00" + _SPACE.sub(" ", part).strip().encode("utf-8", "replace"))
            else:
                summary.update(b"\x01" + part.digest(wanted, inside))
                self.plain = self.plain and part.plain
                self.article = self.article or part.article
        found = summary.digest()
        frame = self.name in INLINE or self.name in {"#page", "html", "body"} or self.article
        if wanted is not None and not frame and (self.plain or not inside):
            wanted.append((self, found))
        return found


def _pairs(attributes: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'").lower()) for name, value in _ATTRIBUTE.findall(attributes)]


def _names(token: str, words: set[str]) -> bool:
    """Whether a class is one of ``words`` or begins or ends with one."""
    parts = _WORD.findall(token)
    return bool(parts) and LAYOUT.isdisjoint(parts) and (parts[0] in words or parts[-1] in words)


def _named(attributes: str, words: set[str] = NAMED) -> bool:
    return any(
        _names(token, words) for name, value in _pairs(attributes) if name in {"class", "id", "role"} for token in value.split()
    )


def _hidden(attributes: str) -> bool:
    return any(
        name == "hidden" or (name == "aria-hidden" and value == "true")
        or (name == "style" and "display:none" in value.replace(" ", ""))
        for name, value in _pairs(attributes)
    )


def parse(html: str) -> Node:
    """A tree of the whole page. Missing ends are implied, stray ends ignored, raw text kept unread."""
    root = Node("#page", "", 0)
    open_nodes, at, raw_until, has_article = [root], 0, None, False
    for match in _TAG.finditer(html):
        start, end, name, attributes = match.start(), match.group(1), match.group(2), match.group(3)
        if start < at:
            continue
        if raw_until is not None and not (end and name and name.lower() == raw_until):
            continue
        if raw_until is None and start > at:
            open_nodes[-1].parts.append(unescape(html[at:start]))
        at, raw_until = match.end(), None
        if not name:
            continue
        name = name.lower()
        if end:
            for depth in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[depth].name == name:
                    del open_nodes[depth:]
                    break
            continue
        if name not in INLINE:
            while len(open_nodes) > 1 and _implied_end(open_nodes, name):
                pass
        tested = bool(attributes) and name not in {"html", "body"}
        hidden, named = tested and _hidden(attributes), tested and _named(attributes)
        node = Node(name, name + " " + attributes, 2 if name in DROPPED or hidden else int(named))
        if name in ARTICLE and not named and not hidden and not has_article:
            # what holds the first article is no boilerplate, whatever its class says, but for comments
            has_article = not any(_named(holder.mark, COMMENTS) for holder in open_nodes)
            for holder in open_nodes if has_article else ():
                holder.boilerplate = 2 if holder.name in DROPPED else 0
        open_nodes[-1].parts.append(node)
        if name in RAW:
            raw_until = name
        if name not in VOID and not attributes.endswith("/") and len(open_nodes) < DEEPEST:
            open_nodes.append(node)
    if raw_until is None and at < len(html):
        open_nodes[-1].parts.append(unescape(html[at:]))
    return root


def _implied_end(open_nodes: list[Node], name: str) -> bool:
    """Close the nearest block element if ``name`` ends it, with the inline elements left open in it."""
    for depth in range(len(open_nodes) - 1, 0, -1):
        holder = open_nodes[depth].name
        if name in IMPLIED.get(holder, ()):
            del open_nodes[depth:]
            return True
        if holder not in INLINE:
            return False
    return False


def blocks(root: Node, deleted: set[int], least: int = 1) -> list[str]:
    """Text blocks in page order, without boilerplate of degree ``least`` and the ``deleted`` nodes (by ``id``).

    Blocks outside of articles are left out if the articles hold more text than they, or if the page
    has one main element and that has text: then those outside of it are.
    """
    everything: list[tuple[bool, list[str]]] = [(False, [])]
    mains: list[Node] = []

    def seek(node: Node) -> None:
        for part in node.parts if node.boilerplate < least and id(node) not in deleted else ():
            if not isinstance(part, str):
                if part.name == "main" and part.boilerplate < least and id(part) not in deleted:
                    mains.append(part)
                else:
                    seek(part)

    seek(root)
    only = mains[0] if len(mains) == 1 else None

    def walk(node: Node, inside: bool) -> None:
        if node.boilerplate >= least or id(node) in deleted:
            return
        inside = inside or (node is only if only is not None else node.name in ARTICLE)
        block = node.name not in INLINE
        if block:
            everything.append((inside, []))
        for part in node.parts:
            if isinstance(part, str):
                everything[-1][1].append(part)
            elif part.name == "br":
                everything[-1][1].append(" ")
            elif part.name not in RAW:
                walk(part, inside)
                if part.name not in INLINE:
                    everything.append((inside, []))

    walk(root, False)
    if only is not None and not any(inside and "".join(parts).strip() for inside, parts in everything):
        only, everything = None, [(False, [])]
        walk(root, False)
    texts = [(inside, _SPACE.sub(" ", "".join(parts)).strip()) for inside, parts in everything]
    texts = [(inside, text) for inside, text in texts if text]
    within, outside = (sum(len(text) for inside, text in texts if inside is side) for side in (True, False))
    if within and (only is not None or within > outside):
        texts = [pair for pair in texts if pair[0]]
    return [text for _, text in texts]


def subtree_hashes(html: str) -> list[int]:
    """Distinct hashes of the page's subtrees that may be template, as signed 64-bit numbers."""
    wanted: list = []
    parse(html).digest(wanted)
    return list({int.from_bytes(found, "little", signed=True) for _, found in wanted})


def main_text(html: str, template: set[int]) -> str:
    """The page's text blocks, joined by an empty line."""
    root, wanted = parse(html), []
    if template:
        root.digest(wanted)
    deleted = {id(node) for node, found in wanted if int.from_bytes(found, "little", signed=True) in template}
    # a page that holds nothing but what its classes name is no boilerplate, whatever they say; one of
    # which nothing is left is itself copied across the host: not template, but text
    return "\n\n".join(blocks(root, deleted) or blocks(root, deleted, 2) or blocks(root, set()) or blocks(root, set(), 2))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_COUNTS = pa.schema([("host", pa.string()), ("h", pa.int64()), ("n", pa.int64())])


def template_subtrees(pages: DataFrame, html: str = "html", url: str = "url", limits: TemplateLimits = TemplateLimits()) -> DataFrame:
    """``host`` and ``hashes``: the subtrees that recur across the host's pages.

    Each task sums per host before the shuffle. A recurring subtree stands on a fixed share of the
    host's pages, so a host has at most (subtrees of a page) / share of them. Pages without a host
    are not compared.
    """
    def counted(batches):
        for batch in batches:
            sums: dict[tuple[str, int], int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found in subtree_hashes(page.as_py() or ""):
                    sums[host, found] = sums.get((host, found), 0) + 1
            hosts, hashes = [k[0] for k in sums], [k[1] for k in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(list(sums.values()), pa.int64())], schema=_COUNTS
            )

    named = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host <> ''")
    sums = named.mapInArrow(counted, "host string, h bigint, n bigint")
    counts = sums.groupBy("host", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= limits.pages)
    totals = named.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    recurring = counts.join(totals, "host").where(F.col("n") >= limits.share * F.col("pages"))
    return stage(recurring.groupBy("host").agg(F.collect_list("h").alias("hashes")), "template-subtrees")


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", limits: TemplateLimits = TemplateLimits()
) -> DataFrame:
    """One row per row of ``pages``: its key, ``url``, ``text`` and ``n_chars`` (code points).

    A missing html counts as empty and gives an empty text; a page without a host keeps what the
    element names leave; missing and repeated keys stay row by row; other columns are not read.
    """
    templates = template_subtrees(pages, html, url, limits)
    rows = pages.select(F.col(key), F.col(url), F.col(html).alias("_html"))
    ready = lookup_join(rows, templates, {"host": host_of(F.col(url))}, population=rows, spread=key)
    types = [pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()]

    def extracted(batches):
        for batch in batches:
            texts = []
            for page, hashes in zip(batch.column(2), batch.column(3)):
                listed = hashes.as_py() or []
                texts.append(main_text(page.as_py() or "", set(listed)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [key, url, "text", "n_chars"],
            )

    chosen = ready.select(key, url, "_html", "hashes")
    return chosen.mapInArrow(extracted, f"`{key}` {types[0]}, `{url}` {types[1]}, text string, n_chars bigint")
