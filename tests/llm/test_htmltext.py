import random

import pytest

from tonarium.llm import htmltext

TREE = htmltext.default_tree()


def text(page):
    return " ".join(htmltext.main_text(page, TREE)[0])


def test_tree_learns_its_table():
    x, y = htmltext.labelled_blocks()
    assert ((TREE.predict(x) > 0.5) == y).mean() > 0.97 and 100 < len(y) < 600


PAGES = [
    ('<body><nav><a href=1>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three<p>f<b>ou</b>r</article><footer>&copy; x</footer>', "T & U One two three four"),
    ('<article><p>Good.</p><div class="ad">Buy now, it is a very good thing to buy.</div><p>Text.</p><section id="comments"><p>I like this text very much, thank you.</p></section></article>', "Good. Text."),
    ('<article><p>a<script>var t="</p><p>no";</script>b<style>p{}</style></p><!-- <p>no</p> --><form><p>Name</p></form><aside>Side</aside><p>c', "ab c"),
    ('<header><h1>Site</h1></header><main><p>x &quot;y&quot; &#8364; &am</p></main><div class="cookie-banner"><p>We use cookies here and there.</p></div>', 'x "y" € &am'),
    ('<div class="post-header"><h1>Big news of the day</h1></div><article><div class="header"><h2>Part</h2></div><figure><figcaption>A boat</figcaption></figure><p hidden>no</p><p style="display: none">no</p><ins class="adsbygoogle">x</ins><p>En<span class="x">d</span> <span class="ad">buy</span></p></article>', "Part A boat End"),
    ('<div class="layout with-sidebar"><article><h1>A</h1><p>Text of it.</p></article><div class="sidebar"><p>Side words here.</p></div></div>', "A Text of it."),
    ('<div class="no-sidebar"><main class="has-comments"><p>Text of it.</p><section class="comments"><p>Nice text.</p></section></main></div>', "Text of it."),
    ('<form id="aspnetForm"><nav>x</nav><article><h1><a href=1>A title</a></h1><p><a href=2>All of this is a link</a></p><p>End.</article></form>', "A title All of this is a link End."),
    ('<div class="has-comments-sidebar"><div><p>The bells were cast in the year of the great flood and hung in the spring that followed it, when the roads were dry.</p><p>They ring.</p></div><div class="comments"><p>My cat hates them.</p></div></div>',
     "The bells were cast in the year of the great flood and hung in the spring that followed it, when the roads were dry. They ring."),
    ("", ""), ("<", "<"), ("<p", ""), ("<article><p>cut off <a href='x", "cut off"), ("<article></b></p></div><p>ok</article>", "ok"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    got = text(page)
    assert got == want or (want == "<" and got == "")


def test_any_page_is_read():
    rng = random.Random(0)
    bits = ["<p>", "</p>", "<a href=x>", "</a>", "<", ">", "&amp", "&#0;", '"', "'", "<!--", "-->", "<script>", "</script>", "words here", "<article>", "</article>", "<div class='ad'>", "\x00", "é", "<![CDATA[", "/"]
    for _ in range(500):
        text("".join(rng.choice(bits) for _ in range(rng.randrange(40))))
    assert text("<div>" * 3000 + "<p>deep and long enough to be read as text of some page</p>") != None  # noqa: E711


def test_frame(spark):
    rows = [(1, "u", PAGES[0][0], "x"), (1, "u", PAGES[0][0], "x"), (2, None, None, "x"), (None, "v", "", "x")]
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", PAGES[0][1]), ("1", PAGES[0][1]), ("2", ""), ("None", "")]
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("depth", [10, 600, 50_000])
def test_containers_and_closing_tags_at_any_depth(depth):
    deep = "<div>" * depth + '<div class="ad"><p>Buy now, it is a very good thing to buy.</p></div>' + "</div>" * depth
    page = f"<body><article><p>Good words.</p>{deep}<p>Text after it.</p></article><footer><p>Made by hand.</p></footer></body>"
    assert text(page) == "Good words. Text after it."
    rows = "<ul>" + "<li><div>x" * depth + '<nav><a href="1">Home</a></nav></ul><p>End of the text.</p>'
    found = htmltext.blocks(f"<article>{rows}</article>" + "</p>" * depth)
    assert [b.aside for b in found if b.text in ("Home", "End of the text.")] == [True, False]
    assert found[-1].article and not found[-1].listed


def test_neighbours_decide_where_nothing_is_named():
    split = {htmltext.NAMES[f] for f in TREE.feature if f >= 0}
    assert split & {"before_words", "after_words"} or split & {"before_density", "after_density"}
    assert split & {"words", "density"} and split & {"named", "share"}
    long = "The ferry leaves the pier at seven in the morning and comes back when the tide lets it, which is seldom before noon."
    page = f"<div><a href=1>Home</a> <a href=2>Map</a></div><div>Since then</div><div><a href=3>Log in</a></div><div>{long}</div><div>It is slow.</div><div>{long}</div><div><a href=4>Older</a></div>"
    assert text(page) == f"{long} It is slow. {long}"
    # the same short block beside links is no text, beside text it is
    got = [(b.text, s > 0.5) for b, s in zip(htmltext.blocks(page), htmltext.main_text(page, TREE)[1], strict=True)]
    assert ("Since then", False) in got and ("It is slow.", True) in got


def test_deep_wrappers_and_long_pages():
    inner = "<article><p>Good words.</p></article>"
    for k in range(300):
        inner = f'<div class="with-sidebar level{k}">{inner}</div><div class="sidebar">x</div>'
    assert text(inner) == "Good words."
    assert text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("word") == 20_000


LONG = "The bells were cast in the year of the great flood and hung in the spring that followed it, when the roads were dry."


@pytest.mark.parametrize("parts", [[LONG] * 3, [LONG, "Yes."], ["Yes.", LONG, "No.", LONG, "Yes."], [LONG], [LONG, LONG, "End."]])
def test_last_and_one_word_blocks_are_kept(parts):
    assert text("<body><nav><a href=1>Home</a></nav>" + "".join(f"<p>{p}</p>" for p in parts) + "</body>") == " ".join(parts)


@pytest.mark.parametrize("tag", ["select", "object", "svg", "canvas", "template"])
def test_raw_content(tag):
    assert text(f"<article><p>Before.</p><{tag}><x>label<p>After it.</p><p>{LONG}</p></article>") == f"Before. After it. {LONG}"
    assert text(f"<article><p>Before.</p><{tag}><{tag}>label</{tag}>more</{tag}><p>After it.</p></article>") == "Before. After it."
    assert text(f"<article><p>Before.</p><{tag}>a</{tag}><p>Middle.</p><{tag}><{tag}>b</{tag}><p>After it.</p></article>").startswith("Before. Middle.")


def test_formulas_and_noscript_are_text():
    assert text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><noscript><p>Shown at once.</p></noscript></article>") == "So x=2 holds. Shown at once."


def test_pages_without_their_elements_and_names():
    import re
    from collections import Counter

    import duckdb

    pages = [r[0] for r in duckdb.sql("SELECT html FROM read_parquet('/root/testdata/sf0.01/pages.parquet') WHERE html IS NOT NULL").fetchall()]
    div = lambda p: re.sub(r"(?i)(</?)(?:article|main)\b", r"\1div", p)
    bare = lambda p: re.sub(r"""(?i)\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", div(p))
    both = want = got = 0
    for page in pages:
        whole = text(page)
        assert text(div(page)) == whole
        a, b = Counter(whole.split()), Counter(text(bare(page)).split())
        both, want, got = both + sum((a & b).values()), want + sum(a.values()), got + sum(b.values())
    assert both / got > 0.95 and both / want > 0.99
