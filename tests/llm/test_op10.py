import html
import random
import re
import time

import pytest

from seqprep.llm.op10_extraction import _marks, html_extraction, main_text

LONG = "A long paragraph of running text that says something about the matter at hand, again and again, in many words."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<b>b</b>c<br>d", "abc d"),
        (f"<nav><a href=1>x</a></nav><article><h1>T</h1><p>{LONG}<p>{LONG}</article><footer>f</footer>", f"T {LONG} {LONG}"),
        (f"<div id=main><h2>T</h2><p>{LONG}</p><ul><li>one<li>two</ul></div><div class='comments'><p>{LONG} {LONG}</p></div>", f"T {LONG} one two"),
        (f"<div><div class=sidebar>{LONG}</div><div class='entry'><p>{LONG}</p><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div></div>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><form><input>Send</form><div class='ad'>Buy</div><p>end</p></article>", f"{LONG} end"),
        ("<article><script>var t = '</p>';</script><p>x &lt;b&gt; &copy; &#233;&nbsp;y</p><!-- <p>no</p> --></article>", "x <b> © é y"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
        ("<article><p>x &am</p></article>", "x &am"),
        ("<article><p title='a > b'>quoted</p></article>", "quoted"),
        ("a < b and c > d", "a < b and c > d"),
        ("<article><p>unclosed <b>bold <i>both</p><p>next", "unclosed bold both next"),
        ("<style>p{}</style><p hidden>secret</p><p style='display: none'>no</p>" + f"<p>{LONG}</p>", LONG),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><nav><a href=1>x</a></nav><div class='content no-sidebar'><p>{LONG}</p><p>{LONG}</p></div><footer>foot</footer></body>", f"{LONG} {LONG}"),
        (f"<body class=has-sidebar><div class='ad-free'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div></body>", f"T {LONG} {LONG}"),
        (f"<body><div class=share><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class=footer>foot</div></body>", f"T {LONG} {LONG}"),
        (f"<body><div id=top><a href=1>Home</a> <a href=2>About us</a></div><div><h1>T</h1><p>{LONG}</p><p>so</p><p>{LONG}</p><div class=comments><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div></body>", f"T {LONG} so {LONG}"),
        ("<p>Q&<em>not</em></p>", "Q&not"),
        ("<p>a &lt;<b>b</b></p>", "a <b"),
        ("<p>text</p><!-- left open <p>no", "text"),
        ("<p>text</p><![CDATA[ &amp; ]]>", "text &amp;"),
    ],
)
def test_density_decides(page, want):
    """No element is taken for its name, and no dense subtree leaves for a class name."""
    assert main_text(page) == want


def brute(page):
    """The densest subtree of a well-formed page, by the formulas and nothing else: sums over all pairs of a node and a child."""
    import math
    import xml.etree.ElementTree as tree

    body = tree.fromstring(page).find("body")
    blocks = {"div", "p", "h1", "ul", "li", "section", "article"}
    squash = lambda x: " ".join((x or "").split())
    own = lambda e: [squash(e.text), *(squash(k.tail) for k in e)]
    chars = lambda e: sum(len(t) for x in e.iter() for t in own(x))
    linked = lambda e: sum(chars(x) for x in e.iter("a"))
    share = linked(body) / chars(body)

    def density(e):
        n, m = chars(e), linked(e)
        tags, links = len(list(e.iter())) - 1, len([x for x in e.iter("a") if x is not e])
        return n / max(tags, 1) * math.log(n / max(m, 1) * max(tags, 1) / max(links, 1) + 1) / math.log(n / max(n - m, 1) * m + share * n + math.e) if n else 0.0

    best = max((e for e in body.iter()), key=lambda e: sum(density(k) for k in e if k.tag in blocks))
    return squash(" ".join(t for x in best.iter() for t in (x.text or "", x.tail or "") if x is not best or t is x.text)), sum(density(k) for k in best if k.tag in blocks)


def test_selection_equals_brute_force():
    """Random well-formed pages: the node that was selected first is the one of maximum density sum."""
    from seqprep.llm.op10_extraction import _measure, parse

    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(n))

    def block(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind == 0:
            return f"<p>{words(rng.randrange(1, 60))} <b>{words(2)}</b></p>"
        if kind == 1:
            return "<ul>" + "".join(f"<li><a>{words(2)}</a></li>" for _ in range(rng.randrange(1, 6))) + "</ul>"
        if kind == 2:
            return f"<h1>{words(4)}</h1>"
        return f"<{(tag := rng.choice(['div', 'section', 'article']))}>" + "".join(block(depth - 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    for _ in range(200):
        page = "<html><body>" + "".join(block(3) for _ in range(rng.randrange(1, 5))) + "</body></html>"
        nodes = _measure(parse(page))
        assert max(x.sum for x in nodes) == pytest.approx(brute(page)[1])


@pytest.mark.parametrize("page", ["<a " * 333_000, '<a href="' * 120_000, '<a href="' * 120_000 + ">", "<b>" * 20_000 + "<p>x</p>" * 20_000, "<div>" * 20_000 + "</span>" * 20_000, "<a '\">" * 100_000, "<" * 500_000, "<!--" * 100_000, '<a "<a >" ' * 50_000 + "'x>"])
def test_broken_markup_is_read_once(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 5


def test_deep_and_broken_pages_end():
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 19_999 + "<p>after</p>") == "deep after"
    assert main_text("<p " * 20_000)
    assert len(main_text("<p>word</p>" * 20_000)) == 20_000 * 5 - 1


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = html_extraction(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


def test_edges(spark):
    schema = "page_id long, url string, html string, text string"
    df = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>t</p>", ""), (1, "u", "<p>t</p>", "")], schema)
    assert sorted(map(str, html_extraction(df).collect())) == sorted(map(str, [*html_extraction(df.where("page_id = 1")).collect(), *html_extraction(df.where("page_id is null")).collect()]))
    assert [(r.page_id, r.text, r.n_chars) for r in html_extraction(df).collect() if r.page_id is None] == [(None, "", 0)]
    assert html_extraction(spark.createDataFrame([], schema)).collect() == []


OTHER = "Another paragraph, of other words and about as long, which goes on with the matter in a second block of the page."
LINKS = "<div>" + "<a href=1>one link and</a> <a href=2>the next</a> " * 5 + "</div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body>{LINKS}<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><h2>B</h2><p>{OTHER}</p><p>{OTHER}</p></article></body>", f"{LONG} {LONG} {LONG} B {OTHER} {OTHER}"),
        (f"<body><div><article><p>{LONG}</p><p>{LONG}</p></article>{LINKS}<article><p>{OTHER}</p></article></div></body>", f"{LONG} {LONG} {OTHER}"),
        (f"<body>{LINKS}<main><h1>T</h1><article><p>{LONG}</p><p>{LONG}</p></article><section><p>{OTHER}</p></section><h2>U</h2><p>{OTHER}</p></main></body>", f"T {LONG} {LONG} {OTHER} U {OTHER}"),
        (f"<body><section><p>{OTHER}</p></section><main><p>{LONG}</p><p>{LONG}</p></main>{LINKS}</body>", f"{OTHER} {LONG} {LONG}"),
    ],
)
def test_text_beside_an_article(page, want):
    assert main_text(page) == want


def test_text_outside_the_body():
    assert main_text(f"<div><p>{LONG}</p><p>{OTHER}</p></div><body></body>") == f"{LONG} {OTHER}"


@pytest.mark.parametrize(
    "inner",
    [
        "<svg class=i viewBox='0 0 1 1'/>",
        "<math display='block' />",
        "<svg><title/><style/><path d='M0 0'/></svg>",
        "<svg><title>drawn</title><g><text>drawn</text></g></svg>",
        "<svg><foreignObject><div><p>drawn</p></div></foreignObject></svg>",
        "<math><mi>x</mi><mo>=</mo></math>",
        "<template><p>later</p></template>",
        "<svg><path d='M0 0'>",
        "<math><mrow>",
        "<div><template><p>later</p></div>",
    ],
)
def test_drawings_and_templates_end(inner):
    """No text after a drawing, formula or template that is self-closed or left open is lost."""
    assert main_text(f"<body><article><p>{LONG}</p>{inner}<p>{LONG}</p></article></body>") == f"{LONG} {LONG}"


SENTENCE = "The crew left the harbour at dawn and found the boat before noon, {} miles out."


def test_labels_name_boilerplate_as_a_whole():
    story = " ".join(SENTENCE.format(k) for k in range(3))
    page = f'<body><div class="search-and-rescue story"><p>{story}</p></div><div><p>{SENTENCE.format(9)}</p></div></body>'
    assert main_text(page) == f"{story} {SENTENCE.format(9)}"
    marked = {"search", "search-form", "site-footer", "post-comments", "comment-list", "ad-2", "cookie_banner"}
    plain = {"search-and-rescue", "no-sidebar", "has-sidebar", "ad-free", "sharecropper", "story", "main", "commentary"}
    assert {x for x in marked | plain if _marks(x)} == marked


def test_short_article_before_long_comments():
    comments = "".join(f"<p>{SENTENCE.format(k)} I was there, too, and saw all of it.</p>" for k in range(60))
    article = SENTENCE.format(40)
    for wrap in ("<div>{}</div>", "<article><p>{}</p></article>", "<div><p>{}</p></div>", "<main><div><p>{}</p></div></main>"):
        page = f'<body>{wrap.format(article)}<div class="comments">{comments}</div></body>'
        assert main_text(page) == article
    inside = f'<body><main><p>{article}</p><section id="comment-list">{comments}</section></main></body>'
    assert main_text(inside) == article


def test_marked_text_stays_where_there_is_no_other():
    text = " ".join(SENTENCE.format(k) for k in range(5))
    body = f'<div class="widget"><p>{text}</p><p>{text}</p></div>'
    assert main_text(f"<body>{body}</body>") == f"{text} {text}"
    assert main_text(f"<body><h1>Found</h1>{body}</body>") == f"Found {text} {text}"
