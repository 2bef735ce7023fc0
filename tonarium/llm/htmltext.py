"""Main text of HTML pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags; inline markup stays inside
a block.  A block's features are its own and its neighbours' word counts and
link densities, and what encloses it: heading, list, article, elements of
menus, headers and footers, and named containers, those whose class, id or role
speaks of adverts, notices or reader comments, with their share of the page's
words.  A named container that an article or the page's main part stands in is
a wrapper ("with-sidebar") and counts for nothing.  A decision tree grown on a
small labelled table (LABELLED below, blocks of hand-written pages) says which
blocks are text; where a page has no telling elements or names, its neighbours
say what a short block is.

Scripts, styles and other raw content never become blocks; raw content that is
never closed ends at the next block-level tag.  Character
references are decoded as HTML 5 does; white space in a block becomes one
space; the chosen blocks are joined in page order by a space.

Cases: null and empty pages give an empty text; broken markup (unclosed or
stray tags, pages cut off inside a tag or reference) is read as far as it goes;
very long pages are read whole; repeated rows each get their row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mrow mfrac msup msub msqrt mtext".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = set("script style template iframe object svg canvas textarea select title head".split())
TEXT_ONLY = ("script", "style", "textarea", "title", "iframe")
#: Tags that end raw content which the page never closes.
ENDS_RAW = set("p div section article main h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure header footer nav aside form body hr".split())
ASIDE = set("nav header footer aside menu dialog button fieldset".split())
WORDS = re.compile(
    r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|aside|ads?|adsby\w*|advert\w*|adbox|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|respond|footer|foot|header|masthead|copyright|legal|toolbar|widget|pagination|pager|tags|toc|skip)(?:[^a-z]|$)"
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
LABEL = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: A header of an article, not of a page.
OWN_HEADER = re.compile(r"(?:article|post|entry|story|content)[-_ ]*header")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
MARK = re.compile(r"\bdata-text\s*=\s*\"([01])\"")
NAMES = ("words", "density", "before_words", "before_density", "after_words", "after_density", "aside", "article", "heading", "list", "outside", "named", "share")


class Block:
    __slots__ = ("text", "words", "linked", "aside", "article", "heading", "listed", "mark", "box", "named", "share")

    def __init__(self, text: str, words: int, linked: int, state: tuple):
        self.text, self.words, self.linked = text, words, linked
        self.aside, self.article, self.heading, self.listed, self.mark, self.box = state
        self.named, self.share = False, 1.0


def _labels(attributes: str) -> str:
    return " ".join(x or y or z for x, y, z in LABEL.findall(attributes)).lower() if "=" in attributes else ""


def _is_aside(attributes: str) -> bool:
    """Does an inline element's name or its being hidden set it apart?"""
    return bool(WORDS.search(_labels(attributes)) or HIDDEN.search(attributes))


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    # name, in an aside element, in an article, in a heading, in a list, mark, box
    stack: list[tuple] = [("", False, False, False, False, None, -1)]
    # named containers: the one around it, is it a wrapper, its words, is it in an article
    boxes: list[list] = []
    # open elements by name, so that a stray closing tag searches nothing
    opened: dict[str, int] = {}
    links = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(text.split(" ")), linked, stack[-1][1:]))
            parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.split())

    at, raw, depth, last = 0, None, 0, -1
    closes: dict[str, int] = {}  # where each raw element is closed for the last time
    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if raw is None:
            put(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1])
        if raw is not None:
            if last < 0 and (name in ENDS_RAW or closing and opened.get(name)):
                raw = None  # never closed: what follows is the page again
            else:
                if name == raw and not (m[3] or "").rstrip().endswith("/"):
                    depth += -1 if closing else 1
                    if depth == 0 or m.start() == last:
                        raw = None
                continue
        if not closing and name in RAW:
            if name in ("head", "title"):
                close()
            if (m[3] or "").rstrip().endswith("/"):
                continue
            if name in TEXT_ONLY:  # raw text: nothing in it is a tag
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name != "head":
                if name not in closes:
                    closes[name] = max((x.start() for x in re.finditer(rf"</{name}(?![^\s/>])", page, re.I)), default=-1)
                raw, depth, last = name, 1, closes[name] if closes[name] > m.start() else -1
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in INLINE and not (stack[-1][0] == name if closing else m[3] and name not in VOID and _is_aside(m[3])):
            continue
        close()
        if name in VOID:
            continue
        if closing:
            links = 0
            while opened.get(name):
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
            stack.pop()
            opened[name] -= 1
        _, aside, article, heading, listed, mark, box = stack[-1]
        attributes = m[3] or ""
        labels = _labels(attributes)
        main = name in ("article", "main")
        inner_header = name == "header" and article
        labels = OWN_HEADER.sub(" ", labels.replace("header", " ") if article else labels)
        aside |= name in ASIDE and not inner_header
        aside |= bool(attributes) and bool(HIDDEN.search(attributes))
        named = name == "form" or bool(WORDS.search(labels))
        if main and not (name == "article" and any(w.startswith(("comment", "repl", "respon")) for w in labels.split())):
            around = box
            while around >= 0 and not boxes[around][1]:
                boxes[around][1] = True
                around = boxes[around][0]
        if named and not main and name not in ("body", "html"):
            boxes.append([box, False, 0, article])
            box = len(boxes) - 1
        found = MARK.search(attributes)
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, aside, article or main, name in ("h1", "h2", "h3", "h4", "h5", "h6"), listed or name in ("ul", "ol", "dl", "menu"), found[1] if found else mark, box))
    if raw is None:
        rest = page[at:]
        put(rest if not re.match(r"</?[a-zA-Z!]", rest) else "")
    close()
    _name_blocks(out, boxes)
    return out


def _name_blocks(found: list[Block], boxes: list[list]) -> None:
    """Give each block its innermost named container that is no wrapper, as the
    container's share of all words (0 for one inside an article)."""
    total = sum(b.words for b in found)
    for b in found:
        if b.box >= 0:
            boxes[b.box][2] += b.words
    for around, _, words, _ in reversed(boxes):  # inner containers come later
        if around >= 0:
            boxes[around][2] += words
    telling: list[int] = []
    for k, (around, wraps, _, _) in enumerate(boxes):
        telling.append(k if not wraps else telling[around] if around >= 0 else -1)
    for b in found:
        if b.box >= 0 and telling[b.box] >= 0:
            _, _, words, inner = boxes[telling[b.box]]
            b.named, b.share = True, 0.0 if inner else words / total


def block_features(found: list[Block]) -> np.ndarray:
    """One row a block, columns as in NAMES."""
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(min(1.0, b.linked / b.words) for b in found), 0], float)
    any_article = any(b.article for b in found)
    own = np.array([(b.aside, b.article, b.heading, b.listed, any_article and not b.article, b.named, b.share) for b in found], float).reshape(-1, 7)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], own])


#: Hand-written pages; data-text says whether the blocks inside are text.
LABELLED = (
    '<body><nav data-text="0"><ul><li><a href=a>Home</a><li><a href=b>News and views</a><li><a href=c>About us today</a></ul></nav><div class="ad" data-text="0">Buy one of our very good watches at half the price this week only.</div>'
    '<article data-text="1"><h1>A storm over the coast</h1><p>Rain fell all night on the small towns along the coast and the rivers rose by more than a metre before the morning came.<p>Then it stopped.<p>People walked out to look at what was left of the harbour wall, and many of them stayed until the evening to help.<ul><li>Two bridges are closed<li>The road to the north is open</ul><p>Read <a href=x>our report</a> on the last storm, which was worse.</article>'
    '<footer data-text="0">&copy; Coast Daily. All rights reserved by the publisher of this page.</footer></body>',
    '<body><header data-text="0"><h1>The Valley Post</h1><p>News from the valley since the year of the flood</p></header><main data-text="1"><article><h2>Bread</h2><p>Yes.</p><p>Flour, water and salt are all that it takes, and a long evening in which nothing else has to be done.</p><blockquote>Patience is the only spice.</blockquote></article></main>'
    '<aside data-text="0"><h3>Also read</h3><p>Our cook tells how to bake a cake in the time that a kettle takes to boil.</p></aside><section class="comments" data-text="0"><h3>Comments</h3><p>I have baked this bread three times now and it came out well each time, thank you so much for it.</p><p>Nice!</p></section></body>',
    '<body><div class="cookie-notice" data-text="0"><p>We use cookies so that this page works well for you and for all our partners.</p><button>Accept</button></div><div class="menu" data-text="0"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div data-text="1"><h1>The clock tower</h1><p>The tower was built in nine years, by forty men and their families, who lived in huts around it until the last stone was laid.</p><p>It leans a little, as towers do, and the town has grown fond of the way in which it points at the mill.</p></div>'
    '<div data-text="0"><a href=5>Older posts</a> <a href=6>Newer posts</a></div><form data-text="0"><p>Write your name and your address here and we will send you a letter every week.</p></form><div class="footer" data-text="0">Contact</div></body>',
    '<body><table data-text="0"><tr><td><a href=1>Index</a><td><a href=2>Search the site</a></table><p data-text="1">A page from the early days of the web has no more structure than a few paragraphs, and a rule between them.<p data-text="1">Still it can be read, which is more than can be said of many pages that came after it and had far more to them.<hr><p data-text="0"><a href=1>Back to the index of this site</a></body>',
    '<body><article data-text="1"><header><h1>Two wheels</h1></header><p>He rode to work on a red bicycle for thirty years.<p>Never once was he late.<div class="advert" data-text="0"><p>Bicycles of every colour are on sale in our shops until the end of the month.</div><p>When he retired, the bicycle did too.<aside data-text="0"><p>Ten roads that you should ride in spring before the crowds come out.</aside><form data-text="0">Subscribe to this column <input type=text></form><p>Both are well.</article>'
    '<div id="comments" data-text="0"><p>My father had one like it, he would have liked this story a lot I think.</div></body>',
    '<body><div role="navigation" data-text="0">Start &gt; Science &gt; Stars</div><main data-text="1"><h1>Light</h1><p>The light of the nearest star takes four years to reach us.</p><h2>Why it matters</h2><p>Because we see what was.</p><ol><li>Look up<li>Wait for four years<li>Look again</ol></main><div class="related" data-text="0"><ul><li><a href=1>Why the moon looks larger near the ground</a><li><a href=2>How to buy a telescope</a></ul></div><div class="social" data-text="0">Share this page with your friends</div></body>',
    '<body><div data-text="0"><a href=1>A</a> | <a href=2>B</a> | <a href=3>C</a> | <a href=4>D</a></div><div data-text="1">A notice by the council says that the well in the market square will be closed for repairs from the first of the month, and that water can be had from the well behind the church.</div><div data-text="1">The repairs are expected to last until the harvest, though the mason has been known to take his time over such work.</div><div data-text="0"><a href=9>Print this page</a></div></body>',
    '<body><article data-text="1"><h1>Names</h1><p>Ann.<p>Bob.<p>Cleo.<p>And all the others who were there that day and whose names nobody wrote down in time.</article><p data-text="0">This page was made by hand and is kept by the friends of the parish.</p><p data-text="0">Visits: 1204</p></body>',
    # a wrapper's name says nothing; no article element
    '<body><div class="layout with-sidebar"><div data-text="1"><h1>The ferry</h1><p>It crosses the strait four times a day and has done so, in all but the worst weather, for a hundred and ten years.<p>The captain is the fifth of his family.<p>Nobody who lives on the island has ever owned a boat that was large enough to take a cow to the market on the other side.</div><div class="sidebar" data-text="0"><p>Times and prices are shown on the board at the pier.</p><a href=1>All lines</a></div></div></body>',
    '<body class="has-comments"><div id="no-sidebar-page"><div data-text="1"><h1>Salt</h1><p>Before there was ice there was salt, and whole towns were built on the trade in it between the coast and the hills.<p>Few of them are left.<p>Their store houses have become dwellings, and in one of them there is a school whose walls are still white after rain.</div><div class="comments-list" data-text="0"><p>My aunt went to that school and she told us about those walls.<p>Lovely.</div></div></body>',
    '<body><form action="page.aspx"><div data-text="1"><h2>Minutes of the meeting</h2><p>The treasurer read out the accounts of the past year, which were found to be in good order by both of the members who had looked at them.<p>There were no questions.<p>It was agreed that the roof of the hall should be mended before the winter, and that two offers should be asked for.</div><div data-text="0"><a href=1>Print</a> <a href=2>Back</a></div></form></body>',
    '<body><div class="page-header-fixed"><article data-text="1"><h1>Owls</h1><p>They hear a mouse under the snow at a distance of sixty steps.<p>We do not.</article><div class="share-bar" data-text="0">Send this to someone who would like it</div></div></body>',
    # an article may link
    '<body><div data-text="0"><a href=1>Home</a></div><article data-text="1"><h1><a href=p>The bridge at noon</a></h1><p>At noon the bridge is closed for as long as the tall ships need to pass.<p><a href=q>The harbour office has the times of all ships.</a><p>Come early.<ul><li><a href=r>North bank</a><li><a href=s>South bank</a><li><a href=t>The island between them</a></ul><p><a href=u>Here</a> is a drawing of it.<nav data-text="0"><a href=v>Next story</a></nav></article><div data-text="0"><a href=2>Terms</a> <a href=3>Contact</a></div></body>',
    '<body><main data-text="1"><h2><a href=p>Nine songs</a></h2><p><a href=q>The first song</a><p><a href=r>The second song is sung at dusk</a><p>All the others are lost.</main><div data-text="0"><a href=2>Songs by year</a></div></body>',
    # no telling elements and no names: what stands beside a short block tells what it is
    '<body><div data-text="0"><a href=1>Front page</a> <a href=2>Weather</a></div><div data-text="0">Issue 41</div><div data-text="0"><a href=3>Letters to the editor</a></div><div data-text="1">The mill at the upper end of the valley was sold on Friday to a family from the coast who mean to grind flour there again.</div><div data-text="1">They start in May.</div><div data-text="1">The wheel will have to be made new, for the old one lay in the stream for twenty years and is rotten through.</div><div data-text="0"><a href=4>Older issues of this paper</a></div><div data-text="0">Printed weekly</div><div data-text="0"><a href=5>Top of page</a></div></body>',
    '<body><p data-text="0"><a href=1>Home</a> <a href=2>Plants</a> <a href=3>Seeds</a><p data-text="0">Spring list<p data-text="0"><a href=4>Order by post</a><p data-text="1">Sow the beans in rows a hand apart once the nights are mild, and cover them with as much soil as the bean is thick.<p data-text="1">Water them well.<p data-text="1">After ten days the first leaves show, and from then on the slugs are the only thing that you have to fear.<p data-text="1">Good luck.<p data-text="1">When the pods rattle they are ripe, and you may keep the best of them for the year to come in a dry and dark place.<p data-text="0"><a href=5>More plants for sale</a><p data-text="0">Open daily<p data-text="0"><a href=6>How to find us</a></body>',
    '<body><div data-text="0"><a href=1>Start</a></div><div data-text="0">Welcome, guest</div><div data-text="0"><a href=2>Log in</a> <a href=3>Register</a></div><div data-text="1">My grandfather kept bees</div><div data-text="1">He had eleven hives behind the barn and talked to them every evening, because bees that are told nothing fly away, as everyone in his village knew.</div><div data-text="1">They never flew away.</div><div data-text="1">When he died my father went out to tell them, hat in hand, and stood there for as long as it took, which was the whole of an afternoon.</div><div data-text="0"><a href=4>Previous entry</a> <a href=5>Next entry</a></div><div data-text="0">Powered by a small machine</div><div data-text="0"><a href=6>Imprint</a></div></body>',
)

#: Further rows of the labelled table, page by page: a block is its number of
#: words, with a if all are linked and ! if it is text; before it stands r in an
#: article, o outside of the page's article, s in an element of menus or such,
#: n in a small named container, w in a named one that holds most of the page,
#: h in a heading, l in a list.
LAYOUTS = (
    "s3a s4a s2 o31 o8 rh6! r40! r3! r28! r7a! r2! r64! o27 o12 s35 s6 s2a",
    "o2a o3a o44 rh4a! r5! r90! rl2! rl3a! rl6! r33! r1! n45 n3 n26 o60 o1 s14",
    "s28 s4 rh9! r22! r4! r5! r3! r70! r12! n8 r15! r6! o23 o38 s3a",
    "o25 rh3! r2! r4! r1! s30 o41 o36 n52 n4 n33",
    "2a 4a 3 2a h5! 31! 4! 55! 2! 38! 6! 3a 2 4a",
    "3a 1a 2 5a 3a 24! 60! 3! 2! 41! 5! 7a 3 2a",
    "1a 6 2a 3a 47! 4! 29! 33! 8! 2a 11a 4 5a",
    "4a 2a h7! 26! 3! 44! l5! l2! l4! 27! 4! n28 n3 n41",
    "s2 s5a h4! 36! 5! 30! 2! s24 s40 s3a",
    "w3a wh5! w34! w4! w52! w3! w29! n30 n2 n4a",
    "w2a w1a w4 w3a w41! w6! w25! w2! w48! w5! n26 n5",
    "2a 3 5a 2a 70! 3! 3a 1 6a 2 3a",
    "n34 n6 3a 2a 28! 5! 39! 4! n31 n2 s27 s9 2a 3",
    "1a 3a 5 4a 7! 33! 5! 62! 3! 2a 6 1a 2",
    "o6 o33 o2a wr7! wr31! wr3! wr9a! wr44! n24 o29 s4 s30",
    "3a 2a 5a 4 27a 3a 30! 4! 58! 2! 25a 3 4a 2a",
    # pages that end with text, or with one word of either kind
    "2a 3a 1a h6! 38! 45! 61!",
    "1a 1a 2a n9 h4! 27! 1! 52! 33!",
    "s2a s1a h5! 44! 6! 39! s1",
    "2a 1a 4a 31! 48! 5! 66!",
    "s3a s2a s1a h3! 24! 1! 29! 1! 71! s12",
    "1a 2a h8! 35! 3! 28! 4! s1a",
    "s1a s2a s1a n8 h9! 35! 17! 49! 90! s1",
    "n7 s1a s1a h12! 20! 18! 1! 30! 1! s1",
    "s2a s4a h2! 22! 57! 12! s11",
    "45! 50! 3! 62!",
    "29! 1! 34! 1!",
    "64!",
    "s1a s1a n12 n30 h4! 120! 8! 1! s3",
    "or1 s1a rh7! r40! r1! r55! s1",
    "s2a rh5! r20! r1! r30! r1!",
)


def layout_blocks(layout: str) -> list[Block]:
    """The blocks of one of LAYOUTS."""
    out = []
    for kinds, words, end in re.findall(r"([a-z]*)(\d+)(\S*)", layout):
        b = Block("", int(words), int(words) if "a" in end else 0, ("s" in kinds, "r" in kinds, "h" in kinds, "l" in kinds, "1" if "!" in end else "0", -1))
        b.named, b.share = "n" in kinds or "w" in kinds, 0.15 if "n" in kinds else 0.85 if "w" in kinds else 1.0
        out.append(b)
    return out


class Tree:
    """A binary decision tree by Gini impurity; leaves hold the share of text."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
        self.feature, self.cut, self.low, self.high, self.share = [], [], [], [], []
        self._grow(x, y, depth, least)
        self.feature, self.cut, self.low, self.high, self.share = map(np.array, (self.feature, self.cut, self.low, self.high, self.share))

    def _grow(self, x, y, depth, least) -> int:
        node = len(self.share)
        for column, value in ((self.feature, -1), (self.cut, 0.0), (self.low, -1), (self.high, -1), (self.share, float(y.mean()))):
            column.append(value)
        if depth == 0 or y.min() == y.max():
            return node
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                n = left.sum()
                if min(n, len(y) - n) < least:
                    continue
                gini = sum(p * (1 - p) * m for p, m in ((y[left].mean(), n), (y[~left].mean(), len(y) - n)))
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, cut)
        if best is None or best[0] >= y.mean() * (1 - y.mean()) * len(y) - 1e-12:
            return node
        _, f, cut = best
        left = x[:, f] <= cut
        self.feature[node], self.cut[node] = f, cut
        self.low[node] = self._grow(x[left], y[left], depth - 1, least)
        self.high[node] = self._grow(x[~left], y[~left], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while len(x) and (inner := self.feature[node] >= 0).any():
            at = node[inner]
            node[inner] = np.where(x[inner, self.feature[at]] <= self.cut[at], self.low[at], self.high[at])
        return self.share[node]


def labelled_blocks(pages=LABELLED, layouts=LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for found in (*map(blocks, pages), *map(layout_blocks, layouts)):
        x.append(block_features(found))
        y += [b.mark == "1" for b in found]
    return np.concatenate(x), np.array(y, float)


def default_tree() -> Tree:
    return Tree(*labelled_blocks())


def main_text(page: str, tree: Tree) -> tuple[list[str], list[float]]:
    """The blocks that are text, and every block's share."""
    found = blocks(page)
    shares = tree.predict(block_features(found))
    return [b.text for b, s in zip(found, shares, strict=True) if s > 0.5], shares.tolist()


def extract_text(pages: DataFrame, tree: Tree | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, blocks (array: the blocks the text is joined from)."""
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [main_text(p, tree)[0] if p else [] for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([" ".join(x) for x in found], pa.string()), pa.array(found, pa.list_(pa.string()))], ["page_id", "url", "text", "blocks"])

    kinds = dict(pages.dtypes)
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, blocks array<string>")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
