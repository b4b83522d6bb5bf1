"""Main text of web pages by composite text density.

A page is read into a tree of elements, leniently (implied ends, stray ends, raw text of scripts). Every node gets its
link-adjusted characters per tag

    CTD = C / T * log_b((C / LC) * (T / LT)),    b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

(C, T: characters and tags below it; LC, LT: those in links; b: of the body; zeros count as one), and the sum of its
children's densities. The node with the largest sum holds the article; the least density on its path to the body is the
threshold that a sibling of that path must reach to belong to it. A sibling within an article or main element on that
path, or one that is such an element, needs no density but more text than links; so do first and second headings need
none. Elements whose name, role or class says that they are menus, headers, footers, sidebars, notices, adverts, forms,
scripts or comments take no part. A class that speaks of what an element has or lacks ("has-sidebar", "no-comments") says
nothing of the element itself; and a form, or an element marked by role or class, that holds the page is let back: one with
half of the body's unlinked text and the first heading or the main element in it, or with nine tenths of that text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import read

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption option select title".split()
)
CLOSES_P = BLOCK - set("html body head option select title caption tbody td tfoot th thead tr".split())
IMPLIED = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
BOILERPLATE = set("head title nav footer aside script style noscript template form button select option textarea input iframe object svg canvas dialog menu map noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments commentlist "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended disqus respond reply replies skip pagination pager toolbar".split()
)
#: First words of class names that tell what an element has, lacks or does, not what it is.
MODIFIERS = set("has have with without no not hide hides hidden show shows shown is off on below above after before under over".split())
#: Why an element is outside: what it says may be wrong of one that holds the page.
STAYS, MAY_RETURN = 1, 2


class Node:
    __slots__ = ("name", "up", "down", "text", "tags", "links", "link_chars", "link_tags", "chars", "density", "total", "out")

    def __init__(self, name: str, up: "Node | None", out: int):
        self.name, self.up, self.out = name, up, out
        self.down: list = []  # nodes and texts, in page order
        if up is not None:
            up.down.append(self)


def named_so(value: str) -> bool:
    """Whether one of the names in a class or id attribute is one of NAMES, or is made up of words one of which is."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if NAMES.intersection(words) and words[0] not in MODIFIERS:
            return True
    return False


def outside(name: str, attributes: str, up: Node) -> int:
    """Whether an element takes no part, and if so, why."""
    if name in BOILERPLATE:
        return MAY_RETURN if name == "form" else STAYS
    if name == "header":
        while up is not None and up.name not in ("article", "main"):
            up = up.up
        return STAYS if up is None else 0
    if name in ("html", "body") or not attributes.strip("/ \t\r\n"):
        return 0
    why = 0
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (values[0] or values[1] or values[2]).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return STAYS
        if key in ("class", "id") and name not in ("article", "main") and named_so(value) or key == "role" and value in ROLES:
            why = MAY_RETURN
    return why


def tree(page: str) -> Node:
    root = here = Node("#root", None, 0)
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            here.down.append(page[at:])
            break
        if m.start() > at:
            here.down.append(page[at : m.start()])
        at = m.end()
        if m.group().startswith("<![CDATA["):
            here.down.append(m.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in ("body", "html"):  # what follows the end of the body still belongs to it
                continue
            node = here
            while node.up is not None and node.name != name and (name in BLOCK or node.name not in BLOCK):
                node = node.up
            if node.name == name:
                here = node.up
            continue
        if name in CLOSES_P:
            node = here
            while node.up is not None and node.name != "p" and (node.name not in BLOCK):
                node = node.up
            here = node.up if node.name == "p" else here
        if name in IMPLIED:
            names, scope = IMPLIED[name]
            node, last = here, None
            while node.up is not None and node.name not in scope:
                last = node if node.name in names.split() else last
                node = node.up
            here = last.up if last is not None else here
        attributes = m[3] if m[2] else m[6]
        child = Node(name, here, outside(name, attributes, here))
        if name in VOID:
            continue
        if name in _RAW:
            stop = _RAW[name].search(page, at)
            at = stop.start() if stop else end
            if stop and (close := _TAG.match(page, at)):
                at = close.end()
            continue
        here = child
    return root


def squeezed(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def order(root: Node) -> list[Node]:
    """Nodes with parents before children; a loop, since pages nest as deep as they like."""
    nodes = [root]
    for node in nodes:
        nodes += [x for x in node.down if isinstance(x, Node)]
    return nodes


def measure(nodes: list[Node], whole: bool) -> None:
    """chars, tags, link_chars, link_tags of each node; whole: with what stands outside."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        if node.out and not whole:
            continue
        node.chars = len(squeezed([x for x in node.down if isinstance(x, str)]))
        for x in node.down:
            if isinstance(x, Node) and (whole or not x.out):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1


def let_back(nodes: list[Node], body: Node) -> None:
    """Elements that hold the page take part, whatever their class; needs what measure() tells of the whole page."""
    unlinked = lambda x: x.chars - x.link_chars
    marked = [x for x in nodes if x.out == MAY_RETURN and x.chars and 2 * unlinked(x) >= unlinked(body)]
    if not marked:
        return
    first = next((x for x in nodes if x.name == "main"), None) or next((x for x in nodes if x.name == "h1"), None)
    above = set()
    while first is not None:
        above.add(id(first))
        first = first.up
    for x in marked:
        if id(x) in above or 10 * unlinked(x) >= 9 * unlinked(body):
            x.out = 0


def density(node: Node, share: float) -> float:
    c, t = node.chars, node.tags or 1
    if not c:
        return 0.0
    base = math.log(c / ((c - node.link_chars) or 1) * node.link_chars + share * c + math.e)
    ratio = c / (node.link_chars or 1) * t / (node.link_tags or 1)
    return c / t * (math.log(ratio) / math.log(base) if base > 1 + 1e-12 else 1.0)


def content(root: Node) -> list[Node]:
    """The subtrees that make up the article, in page order."""
    nodes = order(root)
    measure(nodes, whole=True)
    body = next((x for x in nodes if x.name == "body"), root)
    share = body.link_chars / (body.chars or 1)
    let_back(nodes, body)
    measure(nodes, whole=False)
    for node in reversed(nodes):
        node.density = 0.0 if node.out else density(node, share)
        node.total = sum(x.density for x in node.down if isinstance(x, Node) and not x.out)
    live = [body]
    for node in live:
        live += [x for x in node.down if isinstance(x, Node) and not x.out]
    best = max(live, key=lambda x: x.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].up)
    least = min(x.density for x in path)

    def belongs(x: Node, inside: bool) -> bool:
        """By density; a heading, and what stands in an article or is one, by holding more text than links."""
        return x.density >= least or x.name in ("h1", "h2") or ((inside or x.name in ("article", "main")) and 2 * x.link_chars < x.chars)

    # The article (or main) around the densest node is kept together, without the parts beside its path that don't belong.
    whole = next((i for name in ("article", "main") for i, x in enumerate(path) if x.name == name), 0)
    for child, node in zip(path, path[1 : whole + 1]):
        for x in node.down:
            if isinstance(x, Node) and x is not child and not x.out and x.chars:
                x.out = 0 if belongs(x, True) else STAYS
    best, path = path[whole], path[whole:]
    chosen = {id(best)}
    for child, node in zip(path, path[1:]):
        chosen |= {id(x) for x in node.down if isinstance(x, Node) and x is not child and not x.out and x.chars and belongs(x, False)}
    if best is body:
        return [body]
    found, stack = [], [body]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            found.append(node)
            continue
        stack += [x for x in reversed(node.down) if isinstance(x, Node) and not x.out]
    return found


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by two line feeds; empty if there is none."""
    if not page:
        return ""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held and (block := squeezed(held)):
            blocks.append(block)
        held.clear()

    for top in content(tree(page)):
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x.out:
                continue
            elif x.name == "br":
                held.append(" ")
            else:
                is_block = x.name in BLOCK or x is top
                if is_block:
                    flush()
                    stack.append(None)
                stack += reversed(x.down)
        flush()
    return "\n\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row. Null or empty html gives an empty text; null ids and urls are kept, repeated rows
    repeated, other columns dropped; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([extract(x) for x in batch.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType())]))


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
