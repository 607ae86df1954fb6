"""Main text of web pages by a site style tree.

1. Every page is parsed into a tree. An element's style path is the chain of
   tags, classes and roles from the root to it, and for containers (div, section,
   table, list, ...) their place among siblings of one style, so that a menu and
   an article in two plain divs are two nodes; elements of one path in one page
   are one node.
2. The trees of a host are merged by style path. A node's presentation is the
   sequence of its children's styles (repeats in a row count once), its content
   the text below it; each has an entropy
   over the host's distinct pages, relative to log(pages): 0 if all pages
   agree, 1 if all differ. Importance = PRESENTATION * presentation entropy
   + (1 - PRESENTATION) * content entropy. Nodes on at least MIN_PAGES distinct
   pages with an importance below LOW are noise on that host.
3. A page's text is taken from its article (or main) elements, or from the body
   where it has none, without low-importance branches, without elements that
   are never content (scripts, navigation, forms, ...), without branches whose
   class, id or role names boilerplate, and, outside articles, without lists
   and blocks that are mostly links. A branch around an article is never
   removed, nor are by entropy alone an article's own paragraphs and headings,
   html, body, and a path that holds over half of the page's prose.

Blocks are the stretches of text between block-level tags; character
references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by two line ends.

Merging is a grouping by (host, path, value) with partial counts, so a host of
a third of all pages is as good as many; what comes back to a page is the list
of its host's low-importance paths.

Without an article the tree alone tells menus from texts: an element is as
important as the most varied part below it, since its content is all its text.

Defined cases: null html is an empty page with an empty text; a null url is
the empty host; pages of one text on a host count once, whatever their scripts,
titles and comments; pages that repeat a
page_id give a row each; unclosed and cut-off markup is read to its end, a tag
cut off by the end of the page is dropped; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common

MIN_PAGES = 5
LOW = 0.3
PRESENTATION = 0.1
LINK_SHARE = 0.6
BROADCAST_BYTES = 32 << 20  # of the hosts' lists, names and paths; longer lists are joined by a shuffle
PLACES = 8          # places among equal siblings that are told apart; later ones share the last

NEVER = frozenset("script style noscript template iframe object embed svg math canvas audio video nav footer aside "
                  "form button select option textarea input label fieldset dialog menu head title map applet".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                  "summary table tbody tfoot thead tr ul caption title".split())
PLACED = frozenset("address article aside blockquote center details div dl fieldset figure footer form header main menu nav "
                   "ol section table ul".split())
CLOSES_P = BLOCK - {"body", "html", "title", "tbody", "tfoot", "thead", "tr", "caption", "legend"}
SIBLINGS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dd", ("dl",)), "dd": ("dd", ("dl",)),
            "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table")),
            "option": ("option", ("select",))}
ALIKE = {"dt": "dd", "th": "td"}
P_SCOPE = ("table", "td", "th", "button", "object")
# The elements that close an earlier one of their kind: kind of each, and the kinds
# whose earlier elements an element hides.
_KIND = {"p": "p", **{t: kind for t, (kind, _) in SIBLINGS.items()}}
_HIDES: dict[str, list[str]] = {}
for _kind, _scope in {"p": P_SCOPE, **dict(SIBLINGS.values())}.items():
    for _t in _scope:
        _HIDES.setdefault(_t, []).append(_kind)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong u span a br code q cite small sub sup mark".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|"
                   r"cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|sidebars?|"
                   r"widgets?|related|recommended|share|sharing|social|comments?|commentlist|disqus|respond|replies|"
                   r"breadcrumbs?|pagination|pager|menus?|nav|navbar|navigation|footer|masthead|topbar|toolbar|login|"
                   r"signin|signup|search|skip|complementary|contentinfo|alert|dialog)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
                  r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
                  re.S)
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_USED = frozenset(("class", "id", "role", "style", "aria-hidden", "hidden"))


@dataclass(slots=True)
class Node:
    tag: str
    parent: "Node | None"
    path: int
    noise: bool = False          # by tag, name or style
    article: bool = False        # is one or holds one
    inside: bool = False         # is in an article
    style: str = ""              # class and role
    kinds: dict | None = None    # containers so far by (tag, style)
    parts: list = field(default_factory=list)  # texts and child nodes in order


def _path(parent: int, tag: str, style: str) -> int:
    """A 62-bit hash of a style path, the same in every process."""
    h = parent ^ 0x345678
    for c in f"{tag} {style}".encode():
        h = (h ^ c) * 0x100000001B3 & 0x3FFFFFFFFFFFFFFF
    return h


_PATHS: dict[tuple[int, str, str], int] = {}


def _known_path(parent: int, tag: str, style: str) -> int:
    key = (parent, tag, style)
    if key not in _PATHS:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        _PATHS[key] = _path(*key)
    return _PATHS[key]


def parse(page: str) -> Node:
    root = Node("#root", None, 0)
    top = root
    at = 0
    size = len(page)

    def text(a: int, z: int) -> None:
        if z > a:
            top.parts.append(page[a:z])

    opened: dict[str, int] = {}  # open elements by tag
    shown = {kind: [0] for kind in _KIND.values()}  # by kind, those an element of the kind may close

    def push(n: Node) -> None:
        opened[n.tag] = opened.get(n.tag, 0) + 1
        if n.tag in _KIND:
            shown[_KIND[n.tag]][-1] += 1
        for kind in _HIDES.get(n.tag, ()):
            shown[kind].append(0)

    def close_to(tags) -> None:
        """Close elements up to the innermost one of ``tags``, which is open: each
        element is passed once in all."""
        nonlocal top
        done = False
        while not done:
            done = top.tag in tags
            opened[top.tag] -= 1
            for kind in _HIDES.get(top.tag, ()):
                shown[kind].pop()
            if top.tag in _KIND:
                shown[_KIND[top.tag]][-1] -= 1
            top = top.parent

    find = _TAG.search
    while at < size:
        m = find(page, at)
        if m is None:
            text(at, size)
            break
        text(at, m.start())
        at = m.end()
        closed = m.group(2) is not None
        name = m.group(2) if closed else m.group(5)
        if name is None:  # a comment, a doctype
            continue
        if not closed and page[m.end() - 1:m.end()] != ">":
            break  # cut off by the end of the page
        tag = name.lower()
        if m.group(1) if closed else m.group(4):
            if opened.get(tag):
                close_to((tag,))
            continue
        if tag in CLOSES_P and shown["p"][-1]:
            close_to(("p",))
        if tag in SIBLINGS and shown[_KIND[tag]][-1]:
            close_to([t for t, kind in _KIND.items() if kind == _KIND[tag]])
        attrs = m.group(3) if closed else m.group(6)
        style, noise = "", tag in NEVER
        if "=" in attrs or "hidden" in attrs:
            got = {}
            for k, a, b, c in _ATTR.findall(attrs):
                k = k.lower()
                if k in _USED:
                    got.setdefault(k, a or b or c)
            if got:
                style = f"{got.get('class', '')} {got.get('role', '')}".strip()
                names = f"{got.get('class', '')} {got.get('id', '')} {got.get('role', '')}"
                noise = (noise or "hidden" in got or got.get("aria-hidden") == "true"
                         or bool(HIDDEN.search(got.get("style", "")))
                         or tag not in ("html", "body") and bool(NOISE.search(names)))
        own = style
        if tag in PLACED:
            top.kinds = top.kinds or {}
            k = top.kinds[tag, style] = top.kinds.get((tag, style), -1) + 1
            own = f"{style} #{min(k, PLACES - 1)}"
        n = Node(tag, top, _known_path(top.path, tag, own), noise)
        n.style = style
        n.inside = top.inside or top.tag in ("article", "main")
        if tag == "header":
            n.noise = n.noise or not n.inside
        top.parts.append(n)
        if tag in ("article", "main") and not n.noise:
            up = n
            while up is not None and not up.article:
                up.article = True
                up = up.parent
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            stop = end.start() if end else size
            n.parts.append(page[at:stop])
            at = stop
            if end:
                close = page.find(">", stop)
                at = size if close < 0 else close + 1
            continue
        if tag not in VOID:  # a self-closing slash does not close an HTML element
            top = n
            push(n)
    return root


def style_nodes(page: str | Node) -> dict[int, tuple[int, int]]:
    """Per style path of the page (or its tree): (presentation, content) as hashes."""
    root = parse(page) if isinstance(page, str) else page
    children: dict[int, list[str]] = {}
    content: dict[int, list[str]] = {}
    # postorder, each node's text passed up once
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(x for x in n.parts if isinstance(x, Node))
    digest: dict[int, int] = {}
    for n in reversed(order):
        own = [x if isinstance(x, str) else digest.get(id(x), 0) for x in n.parts]
        own = [" ".join(x.split()) if isinstance(x, str) else x for x in own]
        digest[id(n)] = _stable(repr([x for x in own if x])) if n.tag not in RAW else 0
        styles = [f"{x.tag} {x.style}" for x in n.parts if isinstance(x, Node)]
        children.setdefault(n.path, []).extend(x for k, x in enumerate(styles) if not k or x != styles[k - 1])
        content.setdefault(n.path, []).append(str(digest[id(n)]))
    return {p: (_stable(",".join(children[p])), _stable(" ".join(content[p]))) for p in children if p}


def _stable(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) >> 1


def page_text(root: Node) -> str:
    """All text of a page but that of scripts, titles and the like."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in RAW:
            stack.extend(reversed(n.parts))
    return " ".join("".join(out).split())


def _bulk(root: Node, low: frozenset[int]) -> set[int]:
    """The paths of ``low`` that hold over half of the page's prose."""
    chars: dict[int, int] = {}
    held: dict[int, int] = {}
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(x for x in n.parts if isinstance(x, Node) and not (x.noise and not x.article))
    for n in reversed(order):
        k = sum(len(x) - x.count(" ") if isinstance(x, str) else chars.get(id(x), 0) for x in n.parts)
        chars[id(n)] = k
        if n.path in low:
            held[n.path] = held.get(n.path, 0) + k
    return {p for p, k in held.items() if 2 * k > chars[id(root)]}


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """The text of a page's article given its host's low-importance paths."""
    root = parse(page)
    bulk = _bulk(root, low) if low else set()
    linked = _mostly_links(root)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            t = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if t:
                blocks.append(t)

    def removed(n: Node, kept: bool) -> bool:
        if n.article:
            return False
        if n.noise:
            return True
        if n.path in low and not (kept or n.inside and n.tag in PROSE or n.tag in ("html", "body") or n.path in bulk):
            return True
        return not n.inside and n.tag in ("ul", "ol", "dl", "div", "section", "table", "p", "li") and id(n) in linked

    stack: list = [(root, root.article, False)]  # (node or text, whether outside all articles, in a branch of the bulk)
    while stack:
        top = stack.pop()
        if top is None:
            flush()
            continue
        n, outside, kept = top
        if isinstance(n, str):
            if not outside:
                held.append(n)
            continue
        block = n.tag in BLOCK
        if removed(n, kept):
            flush() if block else held.append(" ")
            continue
        if block:
            flush()
            stack.append(None)
        elif n.tag in ("br", "td", "th", "img"):
            held.append(" ")
        outside = outside and n.tag not in ("article", "main")
        kept = kept or n.path in bulk and n.tag not in ("html", "body")
        stack.extend((part, outside, kept) for part in reversed(n.parts))
    flush()
    return "\n\n".join(blocks)


def _mostly_links(root: Node) -> set[int]:
    """The ids of the nodes whose text is mostly that of two or more links."""
    counts: dict[int, tuple[int, int, int]] = {}  # all characters, linked ones, links
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.tag not in RAW:
            order.append(n)
            stack.extend(x for x in n.parts if isinstance(x, Node))
    for n in reversed(order):
        total, linked, links = 0, 0, int(n.tag == "a")
        for x in n.parts:
            if isinstance(x, str):
                total += len(x) - x.count(" ")
            elif x.tag not in RAW:
                t, k, a = counts[id(x)]
                total, linked, links = total + t, linked + k, links + a
        counts[id(n)] = (total, total if n.tag == "a" else linked, links)
    return {i for i, (total, linked, links) in counts.items() if links >= 2 and 0 < total and linked >= LINK_SHARE * total}


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def low_importance(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` to (host, low): paths of low importance per host."""

    def nodes(batches):
        for b in batches:
            out: list[tuple] = []
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tree = parse(page)
                copy = _stable(page_text(tree))
                out.extend((h, p, copy, a, c) for p, (a, c) in style_nodes(tree).items())
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string())] + [pa.array(c, pa.int64()) for c in cols[1:]],
                                             ["host", "path", "copy", "presentation", "content"])

    n = (pages.mapInArrow(nodes, "host string, path long, copy long, presentation long, content long")
         .groupBy("host", "path", "copy").agg(F.min("presentation").alias("presentation"), F.min("content").alias("content")))
    values = n.select("host", "path", F.posexplode(F.array("presentation", "content")).alias("what", "value"))
    c = values.groupBy("host", "path", "what", "value").agg(F.count(F.lit(1)).alias("c"))
    pages_ = F.sum(F.when(F.col("what") == 1, F.col("c")))
    clogc = lambda k: F.sum(F.when(F.col("what") == k, F.col("c") * F.log("c")))
    m = c.groupBy("host", "path").agg(pages_.alias("m"), clogc(0).alias("s0"), clogc(1).alias("s1")).where(F.col("m") >= MIN_PAGES)
    entropy = lambda s: 1 - F.col(s) / F.col("m") / F.log("m")
    importance = PRESENTATION * entropy("s0") + (1 - PRESENTATION) * entropy("s1")
    return m.where(importance < LOW).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages(page_id, url, html)``."""
    p = pages.select("page_id", "url", common.text_or_empty("html").alias("html"), host(F.col("url")).alias("host"))
    low = common.written(low_importance(p.select("host", "html")), "style-tree")
    held = low.agg(F.sum(F.octet_length("host") + 8 * F.size("low") + 64)).first()[0] or 0
    if held <= BROADCAST_BYTES:  # a host's list holds the few noisy branches of its template
        low = F.broadcast(low)

    def run(batches):
        for b in batches:
            texts = [main_text(h, frozenset(paths or ()))
                     for h, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return (p.join(low, "host", "left").select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "low")
            .mapInArrow(run, "page_id long, url string, text string"))


def op6_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(common.table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
