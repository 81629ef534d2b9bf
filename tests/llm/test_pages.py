import html
import itertools
import math
import random
import re

import pytest

from parcelworks.llm import pages as P
from parcelworks.llm.common import table


@pytest.fixture(scope="module")
def model(spark):
    return P.train(P.labelled_pages(spark))


def blocks(page):
    return [t for _, t in P.parse(page)[1]]


def test_parser():
    assert blocks("<p>a &amp; b&nbsp;\n c<p>d<br>e <b>f</b>g</p>h") == ["a & b c", "d e fg", "h"]
    assert blocks('<script>var t="</p>";x("<b>")</script>x<style>p{}</style><!-- <p>no -->y') == ["x y"]
    assert blocks("<head><title>t</title><meta></head>body 3 < 4 &am &lt;i&gt;") == ["body 3 < 4 &am <i>"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><div>e</section>f") == ["a", "b", "c", "d", "ef"]
    assert blocks("<div title='a>b' class=x>in<!-- open") == ["in"]
    assert blocks("") == [] and blocks("plain") == ["plain"] and blocks("<p") == [] and blocks("<<p>x</p>") == ["<", "x"]
    assert blocks("x" * 200_000)[0] == "x" * 200_000


def test_marginals_equal_enumeration(model):
    page = "<body><nav><ul><li><a>x</a></ul></nav><article><p>some text here</p></article><div class=ad>b</div></body>"
    nodes, _ = P.parse(page)
    seen = P.features(nodes)
    total, content = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        weight = -20.0 * states[0]
        for i, n in enumerate(nodes):
            weight += sum(model.seen[f][states[i]] for f in seen[i] if f in model.seen)
            if i:
                weight += model.edge(nodes, i)[states[n.parent]][states[i]]
        total += (w := math.exp(weight))
        for i, s in enumerate(states):
            content[i] += w * s
    assert model.marginals(nodes) == pytest.approx([c / total for c in content])


TITLE, FIRST, SECOND = "The title of it", "First paragraph of the story, with enough words to count as text.", "Second paragraph, also with a good number of words in it."
ARTICLE = f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p>"
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav>"
LAYOUTS = {
    "no wrapper": f"<body>{ARTICLE}</body>",
    "no wrapper, menu and footer": f"<html><head><title>x</title></head><body>{MENU}{ARTICLE}<footer>&copy; 2020 Foo</footer></body></html>",
    "a sidebar word in the wrapper": f"<body>{MENU}<div class='content-with-sidebar'><article>{ARTICLE}</article><div class=sidebar><ul><li><a>Popular</a><li><a>Other</a></ul></div></div></body>",
    "a sidebar word in the content's class": f"<body>{MENU}<div class='content-with-sidebar'>{ARTICLE}</div><footer>x y</footer></body>",
    "a head without end": f"<html><head><title>t</title><meta x>{MENU}<article>{ARTICLE}</article>",
    "a head without end or body": f"<head><title>t</title>{ARTICLE}",
    "the head's end in a script": f"<head><script>var s=\"</head>\"; x='<p>no</p>'</script></head><body><article>{ARTICLE}</article></body>",
    "a header in the article": f"<body>{MENU}<article><header><h1>{TITLE}</h1></header><p>{FIRST}</p><p>{SECOND}</p></article></body>",
    "a table for columns": f"<body><table><tr><td><a href=/>Home</a> <a href=/b>Blog</a></td><td>{ARTICLE}</td></tr></table></body>",
    "a select without end in a form": f"<body><form><select><option>a<option>b</form><article>{ARTICLE}</article></body>",
    "a select without end": f"<body><select><option>a<option>b<article>{ARTICLE}</article></body>",
    "a drawing without end": f"<body><svg><path><article>{ARTICLE}</article></body>",
    "one form round the page": f"<body><form id=aspnetForm>{MENU}<div id=main>{ARTICLE}</div></form></body>",
    "divs alone": f"<body><div class=header>Site</div><div id=wrapper><div id=content>{ARTICLE}</div><div id=sidebar><p>About me</p></div></div><div id=footer>Copyright</div>",
    "notice and comments, no wrapper": f"<body><div class=cookie-banner><p>We use cookies to make the site better for you.</p></div>{ARTICLE}<div id=comments><div class=comment><p>Nice article, I did like it very much</p></div></div></body>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(model, name):
    assert model.text(LAYOUTS[name])[0].split("\n") == [TITLE, FIRST, SECOND]


def test_pages_that_lack_or_nest_markup(model):
    plain = f"{FIRST} {SECOND} " * 3
    assert model.text(plain)[0] == plain.strip()
    comments = "<ol class='responses'><li><p>Nice article, I did like it very much</p><li><p>So did I, and my friends as well</p></ol>"
    assert model.text(f"<body>{MENU}<main>{ARTICLE}</main>{comments}</body>")[0].split("\n") == [TITLE, FIRST, SECOND]
    for comment in ("<!-->", "<!--->", "<!-- x --!>"):
        assert blocks(f"<p>a</p>{comment}<p>b</p><!-- c --><p>d</p>") == ["a", "b", "d"]
    linked = f"<body>{MENU}<main><h1>{TITLE}</h1><p>{FIRST}</p><p><a href=/x>{SECOND}</a></p></main></body>"
    assert model.text(linked)[0].split("\n") == [TITLE, FIRST, SECOND]
    wordpress = f"<body class='site'><div id=page class=site><header class=site-header><p class=site-title><a>Blog</a></p></header><main class=site-main><article class='post type-post'><header class=entry-header><h1>{TITLE}</h1><div class=entry-meta>May 5 <a>me</a></div></header><div class=entry-content><p>{FIRST}</p><p>{SECOND}</p></div></article></main><footer class=site-footer>&copy; 2020</footer></div></body>"
    assert model.text(wordpress)[0].split("\n") == [TITLE, FIRST, SECOND]


def test_deep_nesting_takes_linear_time(model):
    import time

    began = time.time()
    for n in (50_000,):
        model.text("<div>" * n + "x</p>" * n + "<li>y" + "</div>" * n)
    assert time.time() - began < 30


def test_held_out_labelled_pages(model):
    rng = random.Random(99)
    right = wrong = 0
    for _ in range(300):
        nodes, pieces = P.parse(P.labelled_page(rng))
        p, states = model.marginals(nodes), P.labels(nodes)
        for i, t in pieces:
            right, wrong = right + (same := (p[i] > 0.5) == bool(states[i])), wrong + (not same)
    assert right / (right + wrong) > 0.97


def test_every_page_is_its_article(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1|ul|li)>", inner)]
        want[r.page_id] = "\n".join(y for x in parts if (y := re.sub(r"\s+", " ", x).strip()))
    got = {r.page_id: (r.text, r.n_chars) for r in P.op5(spark, sf).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "", "t"), (2, None, "<nav><a>x</a></nav>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in P.extracted(docs, P.labelled_pages(spark, 50)).collect()) == [(1, "", 0), (1, "", 0), (2, "", 0)]
    clash = docs.withColumn("x", P.F.lit(1)).withColumn("n_chars", P.F.lit("y"))
    assert P.extracted(clash, P.labelled_pages(spark, 50)).columns == ["page_id", "url", "text", "n_chars", "n_blocks", "certainty"]
    assert P.extracted(docs.limit(0), P.labelled_pages(spark, 20)).count() == 0
