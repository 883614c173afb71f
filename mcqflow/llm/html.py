"""HTML extraction with site style trees.

The element trees of a host's pages are merged: an element is known by its path of tags and
classes. For each path the merged tree holds on how many different pages it stands and how
often each content stands there. A path whose content differs from page to page is important
(1), one that holds the same everywhere is not (0): importance is 1 less the entropy of the
pages over equal contents, to the base of the number of pages. Tags and classes that say
what a branch is for (menus, adverts, scripts, ...) have no importance, the article's own
branch has all. A class or id counts as a whole, and neither it nor a form makes noise of a
branch with more than half of the page's text. What is below the threshold is cut out of each page; then the text of the
article is read off, or of the whole body where no article is marked.

Pages with equal html count once in the merged tree, so copies don't make their article
unimportant, and a branch is only cut out of an article, or of a page without one, if it holds
no more than half of its text: where mirrors repeat a story beside other menus, the story stays. The merged tree is built by aggregation over (host, path, content): a host with a
third of all pages is no single group. Html is read twice and not exchanged unless the
list of unimportant paths is too long to broadcast.

A null html is empty and gives an empty text; so does a page without text. Broken or cut
markup is read as far as it goes. Repeated rows give repeated results, null ids and urls are
kept, an empty table gives an empty one, extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mcqflow.llm.common import checkpointed, text_of

THRESHOLD = 0.2
LEAST_PAGES = 5  # of a host with an element before its importance counts
BROADCAST_PATHS = 200_000  # of 8 bytes and a host name of at most 253

# The roles of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe object svg canvas"
    " audio video dialog menu input label fieldset".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary"
    " table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("div section aside nav header footer ul ol table form article main details figure".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPES = frozenset("ul ol dl table article section div body html main td th blockquote".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menubar nav navbar"
    " navigation breadcrumb breadcrumbs sidebar side-bar footer header masthead topbar toolbar cookie cookies consent"
    " notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended recommendations trending comment comments disqus respond replies reader-comments pagination"
    " pager widget widgets toc skip-link search searchbox copyright legal disclaimer tags taglist".split()
)
# Words that with one of the above still name noise, as in share-bar or site-footer.
FURNITURE = frozenset(
    "bar bars box list wrapper wrap block container section links link item items area inner panel module unit slot button"
    " buttons form site main page top bottom left right global primary secondary".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[a-zA-Z/][^>]*\Z|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


@dataclass
class Node:
    tag: str
    path: str
    noise: bool
    soft: bool = False  # noise by a word list or as a form, which the branch's share of the text can overrule
    children: list[Node | str] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        if value[:1] in "\"'":
            value = value[1:-1]
        out.setdefault(name.lower(), entities.unescape(value))
    return out


def _is_noise(tag: str, attributes: dict[str, str]) -> bool:
    if tag in GONE or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in NOISE_ROLES:
        return True
    if tag in ("body", "html", "article", "main", "p", "h1"):
        return False
    names = attributes.get("class", "") + " " + (attributes.get("id", "") if tag not in HEADINGS else "")
    return any(map(_names_noise, names.lower().split()))


@functools.lru_cache(maxsize=100_000)
def _names_noise(name: str) -> bool:
    """Whether the whole of a class or id stands for noise, not a piece of it."""
    words = [w for w in re.split(r"[-_\d]+", name) if w]
    return name in NOISE_WORDS or (
        any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in FURNITURE for w in words)
    )


def _is_soft(tag: str, attributes: dict[str, str]) -> bool:
    """Noise for no better reason than a name, or being a form."""
    bare = {k: v for k, v in attributes.items() if k not in ("class", "id")}
    return not _is_noise("div" if tag == "form" else tag, bare)


def _overrule(root: Node) -> None:
    """Names don't make noise of a branch with more than half of the text that isn't noise for certain."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and (c.soft or not c.noise))
    if not any(n.soft for n in order):
        return
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = sum(len(c.strip()) if isinstance(c, str) else size.get(id(c), 0) for c in node.children)
    for node in order:
        if node.soft and 2 * size[id(node)] > size[id(root)]:
            node.noise = False


def parse(html: str) -> Node:
    """The element tree, with the end tags that authors leave out."""
    root = Node("#root", "", False)
    stack = [root]
    position, end = 0, len(html)
    while position < end:
        match = _TOKEN.match(html, position)
        position = match.end()
        token = match.group()
        tag = match.group(2)
        if tag is None:
            if token[0] != "<" or token == "<":
                stack[-1].children.append(entities.unescape(token))
            continue
        tag = tag.lower()
        if match.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag in ("p", "li", "b", "i", "a", "span", "em", "strong"):
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",))
        if tag in CLOSED_BY:
            _close(stack, CLOSED_BY[tag])
        attributes = _attributes(match.group(3)) if match.group(3).strip() else {}
        label = tag
        if tag in CONTAINERS and attributes:
            label += "." + ".".join(sorted(attributes.get("class", "").split())) if attributes.get("class") else ""
            label += "#" + re.sub(r"\d+", "0", attributes["id"]) if attributes.get("id") else ""
        parent = stack[-1]
        node = Node(tag, f"{parent.path}/{label}" if tag in CONTAINERS or tag in ("body", "html") else parent.path, _is_noise(tag, attributes))
        node.soft = node.noise and _is_soft(tag, attributes)
        parent.children.append(node)
        if tag in RAW and not token.endswith("/>"):
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, position)
            body = html[position : close.start() if close else end]
            if tag in ("title", "textarea"):
                node.children.append(entities.unescape(body))
            position = html.find(">", close.end()) + 1 if close else end
            if close and position == 0:
                position = end
        elif tag not in VOID:
            stack.append(node)
    _overrule(root)
    return root


def _close(stack: list[Node], tags: tuple[str, ...]) -> None:
    """End an open element with one of the tags, looking no further than the next scope."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in SCOPES:
            return


def _large(root: Node) -> set[int]:
    """Ids of the nodes that hold more than half of the text below a node."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.noise)
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = sum(len(c.strip()) if isinstance(c, str) else size.get(id(c), 0) for c in node.children)
    return {i for i, n in size.items() if 2 * n > size[id(root)]}


def blocks_of(node: Node, cut: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks below a node, in page order; branches to cut go unless they hold most of it."""
    kept = _large(node) if cut else set()
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item is not node and (item.noise or (cut and item.tag in CONTAINERS and path_key(item.path) in cut and id(item) not in kept)):
            if item.tag in BLOCKS:
                flush()
        elif item.tag == "br":
            run.append(" ")
        else:
            if item.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return out


@functools.lru_cache(maxsize=100_000)
def path_key(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8).digest(), "little", signed=True)


def _find(root: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag that aren't inside noise."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == tag:
            out.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.noise)
    return out


def main_text(html: str, cut: set[int] | frozenset[int] = frozenset()) -> str:
    """The article's blocks, two line breaks between them."""
    root = parse(html)
    roots = _find(root, "article") or _find(root, "main")
    if roots:
        out = []
        for r in roots:
            whole = blocks_of(r)
            left = blocks_of(r, cut) if cut else whole
            out += left if 2 * sum(map(len, left)) >= sum(map(len, whole)) else whole
        return "\n\n".join(out)
    return "\n\n".join(blocks_of(root, cut))


def contents(root: Node) -> dict[str, int]:
    """Digest of the text of each container path of a page; elements of one path are merged."""
    texts: dict[str, list[str]] = {}
    stack: list[tuple[Node | str, tuple[str, ...]]] = [(root, ())]
    while stack:
        node, open_paths = stack.pop()
        if isinstance(node, str):
            if node.strip():
                for p in open_paths:
                    texts[p].append(node)
            continue
        if node.tag in ("script", "style", "head"):
            continue
        if node.tag in CONTAINERS and node.path not in open_paths:
            open_paths = (*open_paths, node.path)
            texts.setdefault(node.path, [])
        stack.extend((c, open_paths) for c in reversed(node.children))
    return {p: path_key.__wrapped__(" ".join("".join(t).split())) for p, t in texts.items()}


_NODES = pa.schema([("host", pa.string()), ("path", pa.int64()), ("content", pa.int64()), ("page", pa.int64())])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        host, path, content, page = [], [], [], []
        for h, text, digest in zip(b.column("host").to_pylist(), b.column("html"), b.column("page").to_pylist(), strict=True):
            for p, c in contents(parse(text.as_py())).items():
                host.append(h)
                path.append(path_key(p))
                content.append(c)
                page.append(digest)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip((host, path, content, page), _NODES, strict=True)], schema=_NODES
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [
            main_text(t.as_py(), frozenset(c or ()))
            for t, c in zip(b.column("html"), b.column("cut").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages with it and its importance, over all pages of the host."""
    read = pages.select(host_of().alias("host"), text_of("html").alias("html")).withColumn("page", F.xxhash64("html"))
    nodes = read.mapInArrow(_nodes, "host string, path bigint, content bigint, page bigint")
    different = nodes.distinct()
    content = different.groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("n"))
    paths = content.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    importance = F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.ln("pages"))).otherwise(F.lit(1.0))
    return paths.select("host", "path", "pages", importance.alias("importance"))


def extract(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, the main text and its number of characters."""
    low = style_tree(pages).where((F.col("pages") >= least_pages) & (F.col("importance") < threshold))
    cut = checkpointed(low.groupBy("host").agg(F.collect_list("path").alias("cut"), F.count(F.lit(1)).alias("n")))
    paths = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = cut.drop("n")
    read = pages.select("page_id", "url", text_of("html").alias("html")).withColumn("host", host_of())
    joined = read.join(F.broadcast(cut) if paths <= BROADCAST_PATHS else cut, "host", "left")
    return joined.select("page_id", "url", "html", "cut").mapInArrow(
        _extract, "page_id bigint, url string, text string, n_chars bigint"
    )
