"""Text density against its definition, and pages whose wrappers are named like boilerplate."""

import math
import random

import pytest

from talkweave.llm import html_extract as H

ARTICLE = "<article><h1>On rivers</h1>" + "".join(f"<p>The river number {i} flows past a quiet town and on to the sea, as rivers do.</p>" for i in range(9)) + "</article>"
TEXT = "\n\n".join(["On rivers", *[f"The river number {i} flows past a quiet town and on to the sea, as rivers do." for i in range(9)]])
MENU = '<nav><a href="/">Home</a> <a href="/a">About</a></nav>'
SIDE = '<div class="sidebar"><p>Most read this week, and other things that nobody asked for.</p></div>'
COMMENTS = '<div id="comments"><p>First!</p><p>I do not agree with the second river at all, as I wrote last year.</p></div>'


@pytest.mark.parametrize(
    "before, after",
    [
        ('<div class="layout has-sidebar">', "</div>"),
        ('<div id="page" class="with-banner">', "</div>"),
        ('<div class="post no-comments">', "</div>"),
        ('<form id="f" action="/" method="post">', "</form>"),
        ('<div class="page-sidebar-wrap"><div class="related-layout">', "</div></div>"),
        ('<form><div role="form">', "</div></form>"),
        ('<section class="hide-footer"><div class="is-navbar-open">', "</div></section>"),
    ],
)
def test_wrappers_keep_their_page(before, after):
    assert H.extract(f"<html><body>{before}{MENU}{ARTICLE}{SIDE}{COMMENTS}{after}<footer>© all rights</footer></body></html>") == TEXT


def test_marked_parts_stay_out():
    long = "<p>Another reader says very much about this and that, and then again the same at length.</p>" * 12
    page = f'<html><body><div class="wrap">{ARTICLE}</div><div class="comments-area">{long}</div><form><p>Write to us.</p></form></body></html>'
    assert H.extract(page) == TEXT
    assert H.extract(f"<body><div hidden>{ARTICLE}</div><p>Short.</p></body>") == "Short."


def definition(node, body):
    """CTD from the counts of the text below a node, taken anew for each node."""
    c = t = lc = lt = 0
    stack = [(x, False) for x in node.down]
    own = [x for x in node.down if isinstance(x, str)]
    c += len(H.squeezed(own))
    stack = [(x, node.name == "a") for x in node.down if not isinstance(x, str)]
    inside = node.name == "a"
    lc += c if inside else 0
    lt += 1 if inside else 0
    while stack:
        x, link = stack.pop()
        if x.out:
            continue
        link = link or x.name == "a"
        n = len(H.squeezed([y for y in x.down if isinstance(y, str)]))
        c, t = c + n, t + 1
        lc, lt = lc + n * link, lt + link
        stack += [(y, link) for y in x.down if not isinstance(y, str)]
    return c, t, lc, lt


def test_density_is_its_definition():
    rng = random.Random(6)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["some words here", "x", "", "a longer run of words & marks"])
        name = rng.choice(["div", "p", "a", "span", "section", "ul"])
        return f"<{name}>" + "".join(part(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{name}>"

    for _ in range(60):
        root = H.tree("<body>" + "".join(part(4) for _ in range(4)) + "</body>")
        nodes = H.order(root)
        H.measure(nodes, whole=False)
        body = next(x for x in nodes if x.name == "body")
        share = body.link_chars / (body.chars or 1)
        for x in nodes:
            c, t, lc, lt = definition(x, body)
            assert (x.chars, x.tags) == (c, t)
            if any(y.name == "a" for y in H.order(x)[1:] if any(z.name == "a" for z in H.order(y)[1:])):
                continue  # links in links: counted once by characters
            assert x.link_chars == lc
            if c:
                base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                want = c / (t or 1) * (math.log(c / (lc or 1) * (t or 1) / (x.link_tags or 1)) / math.log(base) if base > 1 + 1e-12 else 1)
                assert H.density(x, share) == pytest.approx(want)
