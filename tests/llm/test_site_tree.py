"""Main text of pages: shapes of single pages, the tree of a site against a plain loop, odd tables."""

import html as entities
import math
import random
import re
from collections import defaultdict

import pytest

from evenhand.llm import queries, site_tree
from evenhand.llm.common import cut

TITLE, ONE, TWO = "A title &amp; more", "First paragraph of the text, with <b>bold</b> and a <a href='/x'>link</a>.", "Second one: a &lt; b &mdash; done"
WANT = "A title & more\nFirst paragraph of the text, with bold and a link.\nSecond one: a < b — done"
BODY = f"<h1>{TITLE}</h1><p>{ONE}</p><p>{TWO}</p>"
LINKS = "".join(f'<li><a href="/{i}">Menu {i}</a></li>' for i in range(6))
COMMENTS = '<section id="comments"><h3>2 comments</h3><article class="comment"><p>I like this very much indeed.</p></article><p>So do I.</p></section>'

SHAPES = {
    "article": f"<nav><ul>{LINKS}</ul></nav><article>{BODY}</article><footer>&copy; us</footer>",
    "unclosed": f"<nav><ul>{LINKS}</ul></nav><div class=ad>Buy</div><article><h1>{TITLE}</h1><p><b>{ONE.replace('<b>', '').replace('</b>', '')}<br><p>{TWO}",
    "inside": f'<article><header><h1>{TITLE}</h1></header><p>{ONE}</p><div class="ad-slot ads">Buy now</div><aside>See also</aside><p>{TWO}</p><form><label>Name</label><input></form>{COMMENTS}<footer>Tags</footer></article>',
    "main": f'<header class="site-header"><h1>Site</h1></header><main><div class="breadcrumbs">Home / News</div>{BODY}<div class="share-buttons">Share</div></main>{COMMENTS}',
    "named": f'<div id="cookie-notice">We use cookies</div><div class="wrap has-sidebar"><div class="post-content">{BODY}</div><div class="sidebar widget-area"><h4>Recent</h4></div></div><div class="site-footer">Imprint</div>',
    "unnamed": f"<div><ul>{LINKS}</ul></div><div>{BODY}</div>",
    "scripts": f"<article>{BODY}<script>if (a < b) document.write('<p>no</p>')</script><style>p > a {{}}</style><noscript>Turn it on</noscript><!-- <p>not this</p> --><template><p>nor this</p></template></article>",
    "around": f'<form id="f" action="/"><input type=hidden><main>{BODY}</main></form>',
    "table": f"<article><table><tr><td><h1>{TITLE}</h1><tr><td><p>{ONE}<td>{TWO}</table></article>",
    "cased": f"<DIV CLASS='Sidebar'>x</DIV><ARTICLE title='a > b'><H1>{TITLE}</H1>\n<P>\t{ONE}\n</P><P>{TWO}&nbsp;</P></ARTICLE>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes_of_pages(shape):
    for page in (f"<!DOCTYPE html><html><head><title>No</title></head><body>{SHAPES[shape]}</body></html>", f"<title>No</title>{SHAPES[shape]}"):
        assert site_tree.main_text(page) == WANT


def test_odd_pages():
    assert [site_tree.main_text(x) for x in ("", "<", "<p", "<!-- a", "<script>x", "</p></div>", "plain", "a < b & c", "<p>x<p>y", "<p>a\n\tb</p>  c")] == ["", "<", "", "", "", "", "plain", "a < b & c", "x\ny", "a b\nc"]
    assert site_tree.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    long = "word " * 200_000
    assert site_tree.main_text(f"<article><p>{long}</p><p>{'<b>x</b> ' * 50_000}</article>") == f"{long.strip()}\n{('x ' * 50_000).strip()}"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def site(rng, n):
    """Pages of a site whose markup has no telling name: two bars and a box recur, the middle differs."""
    terms = [words(rng, 12) for _ in range(3)]
    for i in range(n):
        title, text = words(rng, 6), [words(rng, rng.randint(8, 60)) for _ in range(rng.randint(1, 6))]
        page = f'<html><body><div class="q1"><div class="q9">{terms[0]}</div></div><div class="q2"><h1>{title}</h1>{"".join(f"<p>{t}</p>" for t in text)}</div>'
        yield page + f'<div class="q3"><p>{terms[1]}</p><p>{terms[2]}</p></div><div class="q4">{terms[i % 3]}</div>', "\n".join([title, *text])


def test_a_site_of_no_telling_names(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for host, n in (("big.example", 40), ("small.example", 5)):
        for i, (page, text) in enumerate(site(rng, n)):
            rows.append((len(rows), f"http://{host}/{i}", page))
            want[len(rows) - 1] = text
    copy = rows[3]
    rows += [(100 + i, f"http://big.example/copy{i}", copy[2]) for i in range(60)]  # one article most of whose pages are copies
    want |= {100 + i: want[3] for i in range(60)}
    got = {r.page_id: r for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_furniture_against_a_plain_loop(spark):
    rng = random.Random(9)
    pages = [(f"h{k}.example", p) for k, n in enumerate((30, 7, 3, 2)) for p, _ in site(rng, n)]
    rows = cut(site_tree.statistics(spark.createDataFrame(pages, "host string, whole string").repartition(3)), "test-site")
    got = {r.host: (set(r.low or ()), set(r.common or ())) for r in site_tree.furniture(rows).collect()}
    want = {}
    for host in {h for h, _ in pages}:
        found = [site_tree.page_features(site_tree.Page(p), host) for h, p in pages if h == host]
        articles = {f[3] for f in found}
        if len(articles) < site_tree.LEAST_PAGES:
            continue
        importance = defaultdict(float)
        for k in {k for f in found for k in f[0]}:
            having = [f for f in found if k in f[0]]
            m, styles = len(having), [f[0][k][1] for f in having]
            own = 1.0
            if m >= site_tree.LEAST_PAGES:
                share = [styles.count(s) / m for s in set(styles)]
                entropies = []
                for x in {x for f in having for n, x in f[1] if n == k}:
                    counts = [f[1].get((k, x), 0) for f in having]
                    entropies.append(-sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts if c))
                content = 1 - sum(entropies) / len(entropies) / math.log(m) if entropies else 0
                own = max(content, (1 - site_tree.DECAY ** (len(share) - 1)) * -sum(s * math.log(s) for s in share) / math.log(m))
            for a in having[0][0][k][0]:
                importance[a] = max(importance[a], own)
        texts = {t for f in found for t in f[2]}
        carry = {t: len({f[3] for f in found if t in f[2]}) for t in texts}
        want[host] = {k for k, v in importance.items() if v < site_tree.LEAST}, {t for t, n in carry.items() if n >= max(site_tree.LEAST_PAGES, site_tree.COMMON * len(articles))}
    assert got == {h: v for h, v in want.items() if v[0] or v[1]}
    assert len(got) == 3 and all(low and common for low, common in got.values())


def test_odd_tables(spark):
    rows = [(1, None, "<p>no url</p>"), (2, "no scheme", "<p>x</p>"), (3, "http://a.example/", None), (3, "http://a.example/", ""), (None, "http://a.example/", "<p>same</p>"), (None, "http://a.example/", "<p>same</p>")]
    pages = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, text string, host int")
    got = site_tree.extract(pages)
    assert got.columns == ["page_id", "url", "host", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, "same"), (0, "same"), (1, "no url"), (2, "x"), (3, ""), (3, "")]
    assert site_tree.extract(pages.limit(0)).count() == 0


def test_registered_query_on_the_given_pages(spark, sf_dir):
    """The given pages hold one article each, whose blocks can be cut out by patterns."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.QUERIES["op11_main_text"](spark, sf_dir).collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)(?:</article>|$)", pages[r.page_id])[1])
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b)
