"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its number of words and its
share of words in links, the same of its neighbours, where it lies as seen from the home of the page's text, how its tags and
their names speak of it (not at all, in passing, or as something else than main text; a name that most of a page goes by counts
as in passing), and whether it is a heading. The home is the deepest element that holds most words outside links; words of an
article or main element count eight times, so a page without one has a home too, and an article of few words beside a long text is
not one. A decision tree, grown from the labelled pages below, tells main text from the rest.

Pages are scanned by hand, in time that grows with their length whatever they hold: a search that failed once is not made again.

Defined cases: null and empty pages have the empty text; comments, scripts and tags that are not closed end with
the page; a quoted attribute without its closing quote ends at the next ">"; a self-closed svg is empty, and so is any other such
element without a later end tag; what is no tag is text; hidden blocks are left out; character references are decoded once, after
the tags are taken apart. White space is what Python's str.split() cuts at. Pages are independent: repeated rows give repeated
results. A page of any length is read as a whole. Extra columns are kept; those named like a new one are replaced.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Attributes whose words name a block.
NAMES = ("class", "id", "role", "aria-label")

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe svg textarea select object canvas title".split())
#: Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that may hold blocks and are followed until they end.
CONTAINERS = frozenset("address article aside blockquote body button center details dialog div dl fieldset figure footer form head header html li main menu nav ol section table tbody td tfoot th thead tr ul".split())
#: Containers that do not hold main text by what they are.
OTHER = frozenset("aside button dialog fieldset footer form head menu nav".split())
#: Words in class, id, role or aria-label that name a block as something else than main text.
OTHER_NAMES = frozenset(
    # in English, and names of services
    "ad ads adv advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright disclaimer discuss discussion disqus dropdown feedback footer gdpr masthead menu modal navbar nav navigation newsletter notice notices notification overlay pagination pager popup promo promotion promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets outbrain taboola addthis sharethis adsense".split()
    # in German, French, Spanish, Italian and Portuguese, without accents
    + "anzeige anzeigen fusszeile hinweis hinweise kommentar kommentare kopfzeile navigationsleiste seitenleiste teilen werbung".split()
    + "commentaire commentaires partager publicite publicites".split()
    + "anuncio anuncios aviso avisos comentario comentarios compartir publicidad".split()
    + "commenti condividi navigazione pubblicita".split()
    + "compartilhar navegacao publicidade rodape".split()
)
#: Names of readers and of what they leave: together, in this order, they name comments.
READERS, VOICES = frozenset("customer guest reader readers user users visitor visitors".split()), frozenset("answers opinion opinions posts reactions reviews thoughts voices".split())
#: What follows the word that matters in a name: a cookie-notice-box is a notice, a market-share-report is a report.
HOLDERS = frozenset("area articles bar block body box button buttons container content cta element entries entry field footer form group head header headline heading holder icon icons inner item items label left link links list main message module outer overlay page panel placeholder posts region right row section slot stories text title top unit wrap wrapper zone bereich bloc bloque bloques boite caja contenedor kasten leiste lista liste seccion".split())
#: Words that make a name tell of a page's layout, not of the block itself.
LAYOUT = frozenset("about has hide how layout no non of on show the to why with without".split())
#: Names that a page's head and an article's head share: they count outside articles only, and not where one names the article's.
HEADS, OWN_HEADS = frozenset({"header"}), frozenset("article entry post section story".split())
#: Tags that end a block but hold nothing.
BREAKS = frozenset("br col embed hr input link meta source track".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose start ends an open element of the same kind.
CLOSES_ITSELF = frozenset("li td th tr".split())

#: How a block is named: not as something else, in passing, as something else.
PLAIN, PASSING, ELSE = range(3)
#: Where a block lies: in the home of the page's text, loose in an element around it, in an element beside it, beside an article that has most text.
HOME, AROUND, BESIDE, OUTSIDE = range(4)
#: Elements that can be a home, those whose words count more, how much more, and the share of all that a home has.
HOMES, ARTICLES, MORE, MOST = frozenset("article body center div main section td".split()), frozenset({"article", "main"}), 8, 0.7
#: A block with so many words outside links is taken for text when a page's text is counted.
LONG = 10
#: Sizes that labelled pages come in, and the fewest blocks of a leaf.
SIZES, LEAST = (1, 0.8, 1.5, 3), 5


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    named: int
    top: int  # number of the outermost element that is named as something else, or 0
    article: bool
    heading: bool
    element: int  # number of the innermost open container


@dataclass(slots=True)
class Open:
    tag: str
    named: int = PLAIN
    top: int = 0
    hidden: bool = False
    article: bool = False
    element: int = 0


@dataclass(slots=True)
class Elements:
    """The containers of a page by number: what they stand in, always of a smaller number, and their tags. Number 0 is the page."""

    parents: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: ["body"])


def attributes(rest: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(rest)}


def naming(attrs: dict[str, str], in_article: bool) -> int:
    """What the names in a tag's attributes make of it."""
    out = PLAIN
    names = " ".join(attrs.get(a, "") for a in NAMES)
    if not names.isascii():
        names = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", names))
    for token in names.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
        hits = [i for i, w in enumerate(words) if w in OTHER_NAMES or w in VOICES and READERS & set(words[:i]) or w in HEADS and not in_article and not OWN_HEADS & set(words)]
        if hits:
            sure = not LAYOUT & set(words[: hits[-1]]) and all(w in HOLDERS for w in words[hits[-1] + 1 :])
            out = max(out, ELSE if sure else PASSING)
    return out


def is_hidden(attrs: dict[str, str]) -> bool:
    return attrs.get("hidden", "until-found") != "until-found" or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in re.sub(r"\s", "", attrs.get("style", "")).lower()


@dataclass
class Scanner:
    """The parts of a page in order: texts as ("", text, ""), tags as (name, "" or "/", attributes); raw elements come as a break, without what they hold."""

    page: str
    gone: set[str] = field(default_factory=set)  # what does not come again

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of(self, name: str, at: int) -> int:
        """Where the end tag of a raw element begins, or -1."""
        key = f"</{name}"
        if key in self.gone:
            return -1
        m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.page, at)
        if m is None:
            self.gone.add(key)
            return -1
        return m.start()

    def tag_end(self, at: int) -> int:
        """Where the ">" is that ends a tag; those in quoted values do not. -1: nowhere."""
        page, close = self.page, self.find(">", at)
        while close >= 0:
            equals = page.find("=", at, close)
            while equals >= 0:
                i = equals + 1
                while i < close and page[i].isspace():
                    i += 1
                if i < close and page[i] in "\"'":
                    break
                equals = page.find("=", i, close)
            if equals < 0:
                return close
            shut = self.find(page[i], i + 1)
            if shut < 0:
                return close
            at = shut + 1
            if at > close:
                close = self.find(">", at)
        return -1

    def parts(self) -> Iterator[tuple[str, str, str]]:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            low = page.find("<", at)
            if low < 0:
                yield "", page[at:], ""
                return
            if low > at:
                yield "", page[at:low], ""
            nxt = page[low + 1 : low + 2]
            if page.startswith("<!--", low):
                close = self.find("-->", low + 4)
                at = n if close < 0 else close + 3
            elif nxt in ("!", "?") and nxt:
                close = self.find(">", low)
                at = n if close < 0 else close + 1
            elif m := NAME.match(page, low + 2 if nxt == "/" else low + 1):
                close = self.tag_end(m.end())
                if close < 0:
                    return
                name, slash, attrs = m[0].lower(), "/" if nxt == "/" else "", page[m.end() : close]
                at = close + 1
                if name in RAW:
                    if not slash and not (attrs.endswith("/") and (name == "svg" or self.end_of(name, at) < 0)):
                        begin = self.end_of(name, at)
                        close = self.find(">", begin) if begin >= 0 else -1
                        at = n if close < 0 else close + 1
                    yield "hr", "", ""
                else:
                    yield name, slash, attrs
            elif nxt == "/":
                close = self.find(">", low)
                at = n if close < 0 else close + 1
            else:
                yield "", "<", ""
                at = low + 1


def blocks(page: str) -> tuple[list[Block], Elements]:
    """The text blocks of a page in order, and its elements; blocks without a word and hidden ones are left out."""
    out: list[Block] = []
    elements = Elements()
    stack = [Open("")]
    count: Counter[str] = Counter()  # open elements by tag
    now = stack[0]  # what the text that comes next stands in
    texts: list[str] = []
    linked, in_link, heading, tops = 0, False, False, 0

    def flush() -> None:
        nonlocal linked
        if texts:
            words = "".join(texts).split()
            if words and not now.hidden:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), now.named, now.top, now.article, heading, now.element))
            texts.clear()
        linked = 0

    for tag, slash, rest in Scanner(page).parts():
        if not tag:
            text = html.unescape(slash) if "&" in slash else slash
            texts.append(text)
            if in_link:
                linked += len(text.split())
            continue
        if tag == "a":
            in_link = not slash
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in BREAKS:
            continue
        in_link = in_link and tag not in CONTAINERS
        if tag in HEADINGS:
            heading = not slash
        elif tag == "p" or tag in CONTAINERS:
            heading = False
        if slash:
            while count[tag]:
                gone = stack.pop().tag
                count[gone] -= 1
                if gone == tag:
                    break
            now = stack[-1]
            continue
        if tag in CLOSES_ITSELF and stack[-1].tag == tag:
            count[stack.pop().tag] -= 1
        above = now = stack[-1]
        if tag in CONTAINERS or "=" in rest or "hidden" in rest:
            attrs = attributes(rest) if rest else {}
            named = ELSE if tag in OTHER or tag in HEADS and not above.article else PLAIN
            if attrs and tag not in ("body", "html", "article", "main"):
                named = max(named, naming(attrs, above.article))
            top = above.top
            if named == ELSE and not top:
                top = tops = tops + 1
            now = Open(tag, max(above.named, named), top, above.hidden or bool(attrs) and is_hidden(attrs), above.article or tag in ARTICLES and above.named < ELSE, above.element)
            if tag in CONTAINERS:
                now.element = len(elements.tags)
                elements.parents.append(above.element)
                elements.tags.append(tag)
                stack.append(now)
                count[tag] += 1
    flush()
    return out, elements


#: The statistics that the tree may split at.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "place", "named", "heading")

#: Labelled pages in outline: a number stands for as many words, "+" for main text.
LABELLED = (
    # an article between a menu, an advert and a footer
    "<nav><ul><li><a>1</a><li><a>1</a><li><a>2</a></ul></nav><div class=ad>8</div><article><h1>9+</h1><p>9+<p>30+<p>1+<p>45+<p>3+<p>22+</article><footer>9</footer>",
    "<nav><a>1</a></nav><div class=ad>6</div><article><h1>1+</h1><p>1+</article><footer>12</footer>",
    "<nav><a>1</a></nav><div class=ad>30</div><article><h1>3+</h1><p>4+<p>2+<p>5+</article><footer>25</footer>",
    "<nav><a>1</a></nav><article><h1><a>6+</a></h1><p>40+<p><a>9+</a><p>50+<a>8+</a><p>12+<a>5+</a><ul><li><a>3</a><li><a>4</a><li><a>2</a></ul></article><footer>9<a>2</a></footer>",
    "<article><h1><a>2+</a></h1><p>12+<p><a>12+</a><p>30+</article>",
    "<article><h1>5+</h1><p>60+<h2>2+</h2><p>50+<ul><li>3+<li>4+<li>2+</ul><p>20+<section class=comments><h3>1</h3><p>18<p>70<p>3</section></article>",
    "<article><h1>5+</h1><p>60+<aside><p>12</aside><p>50+<div class=share>2<a>4</a></div></article><div class=x><p>40<p>12</div>",
    "<div><p>12<p>30</div><article><p>20+<p>25+</article><div><h3>2</h3><p>18<p>5</div>",
    "5<main><h2>4+</h2><p>35+<p>6+<p>40+<table><tr><td>1+<td>2+<tr><td>3+<td>1+</table></main>18",
    "<div><a>2</a></div><main><article><p>30+</article><article><p>28+<p>3+</article></main><div>25</div>",
    "<article><p>30+<p>4+</article><div>15</div><article><p>35+</article>",
    "<article><p>40+<div class=no-sidebar><p>30+<p>9+</div><p>3+</article>",
    # articles of short blocks
    "<nav><a>2</a></nav><div class=ad>9</div><article><h1>9+</h1><p>9+<p>12+<p>11+<p>10+<p>14+<p>1+<p>8+<p>17+</article><footer>14</footer>",
    "<article><h1>12+</h1><p>11+<p>13+<p>7+<p>10+<p>10+<p>4+<p>12+</article><div>4</div>",
    "<article><h2>11+</h2><p>75+<p>12+<p>30+<p>10+<p>120+<p>15+</article><div>6<a>3</a></div>",
    # an article that is a teaser beside a long text
    "<div><h1>6+</h1><p>260+<p>150+<p>3+<p>9+<p>270+</div><article><h3><a>5</a></h3><p>12</article><article><h3><a>4</a></h3><p>9</article>",
    # pages without an article: a text between lists of links, short lines and notices of any name
    "<div><a>1</a><a>1</a></div><div><h1>5+</h1><p>30+<p>25+<p>2+<p>40+</div><div>6</div>",
    "<ul><li><a>1</a><li><a>1</a><li><a>2</a></ul><div>3</div><div><h1>4+</h1><p>20+<p>8+<p>16+</div><div><p>12</div><div>4</div>",
    "<div><p>14</div><div><h2>3+</h2><p>9+<p>8+<p>7+<p>9+<p>8+<p>9+</div><ul><li><a>3</a><li><a>2</a></ul>",
    "<div>5</div><div><p>8+<p>8+<p>8+</div><div>4</div>",
    "<div><a>2</a></div><div><p>6+<p>9+<p>5+</div><div><a>1</a></div>",
    "<div>2<a>3</a></div><div><h1>2+</h1><p>45+<ul><li>3+<li>5+<li>4+</ul><p>60+</div><div>9<a>2</a></div><div>18</div>",
    "<div><div><h3>2</h3><ul><li><a>3</a><li><a>4</a></ul><p>12</div><div><h1>6+</h1><p>50+<p>1+<p>35+<blockquote>9+</blockquote><p>30+</div></div><div>8</div>",
    "<div><h1>7+</h1><div><p>40+<p>50+<p>60+</div></div><div>15</div>",
    "<div><h1>3+</h1><p>12+<div><p>40+<p>50+</div><p>4+</div><div>5</div>",
    "<div><div><h1>4+</h1></div><div><p>30+<p>25+<p>40+</div><div><h4>2</h4><p>12</div></div><div>9</div>",
    "<div><h1>2+</h1></div><div><p>45+<p>20+</div><div><h3>1</h3><p>10<p>14</div>",
    "<div><p>30+<p>45+</div><div><p>35+<p>40+</div><div><p>25+<p>5+</div>",
    "<h1>4+</h1><p>30+<p>8+<p>3+<p>40+<p>16+",
    "<a>1</a><p><a>1</a><h1>5+</h1><p>22+<p>6+<p>9+<p>30+<p><a>2</a><p><a>3</a>",
    "<h1>3+</h1><p>5+<p>4+",
    "12+",
    "<p>3+",
    "30+<br>9+<br>2+<br>40+",
    "<div><a>1</a> | <a>1</a></div><table><tr><td><a>2</a><br><a>2</a><td><h2>4+</h2><p>40+<p>9+<p>50+<td>8</table>",
    "<center><p>20+<p>2+<p>25+</center><div><a>5</a></div>",
    "<div>9</div><div><p>45+<p>70+<p>8+</div>",
    "<div><p>14</div><div>80+<br>60+</div><div>6</div>",
    "<div>5<a>1</a></div><div><p>90+<p>50+<h2>2+</h2><p>12+</div>",
    "<div><a>4</a></div><div>22</div><div><p>120+<p>66+</div><div><p>3</div>",
    "<div><h1>6+</h1></div><div><p>70+<p>50+<p>90+</div>",
    "<div>3</div><div><h2>9+</h2></div><div><p>90+<p>8+<p>60+</div>",
    # links in texts, and texts of links
    "<div><a>2</a> <a>1</a></div><div><h1><a>3+</a></h1><p>25+<p>2+<p>40+</div>",
    "<div><a>1</a><a>2</a></div><h1><a>5+</a></h1><p>30+<p>18+<h2><a>4+</a></h2><p>60+",
    "<div><a>1</a></div><article><h2><a>6+</a></h2><p>20+</article><div>9<a>2</a></div>",
    "<ul><li><a>1</a><li><a>3</a></ul><div><h2><a>4+</a></h2><p>16+<p>70+<h2><a>7+</a></h2><p>50+</div>",
    "<article><h1>4+</h1><p>35+<p><a>9+</a><p>40+<p><a>12+</a><p>30+<p>20+</article>",
    "<div><p>45+<p><a>7+</a><p>25+<p><a>11+</a><p>35+<p><a>6+</a><p>45+</div>",
    "<article><p>20+<p><a>8+</a><p>50+<ul><li><a>3</a><li><a>7</a><li><a>9</a></ul><p>30+</article>",
    "<div><p>30+<a>10+</a><p>20+<a>15+</a><p>6+<a>4+</a><p>40+<p><a>7+</a><p>35+</div><div>3<a>9</a></div>",
    "<div><h1>5+</h1><p>50+<p>40+<ul><li><a>5</a><li><a>6</a><li><a>4</a></ul></div>",
    "<div><h1><a>5+</a></h1><p>50+<p>4+<h3>2</h3><ul><li><a>5</a><li><a>9</a></ul></div>",
    "<div><a>1</a><a>1</a><a>2</a><p>1<a>4</a><p>45+<p>7+<p>30+<p>1<a>3</a><p><a>8</a><p><a>7</a></div>",
    "<div><ul><li><a>3</a><li><a>3</a><li><a>8</a><li><a>11</a><li><a>14</a></ul><p>60+<p>12+</div>",
    "<a>1</a><p>2<a>8</a><p><a>5</a>",
    # sections beside a long text: long ones are text, short ones not
    "<div><h1>5+</h1><p>200+<p>150+</div><div><p>60+<p>50+</div>",
    "<div><h1>5+</h1><p>100+<p>150+<p>120+</div><div><p>18<p>25<p>4</div><div><p>30</div>",
    "<div><h2>5+</h2><p>300+</div><div><h2>3+</h2><p>70+</div><div><h3>2</h3><p>20</div>",
    # what names tell, on pages without an article
    "<div class=menu><a>1</a>2</div><div class=cookie><p>35</div><div><h1>4+</h1><p>30+<p>8+<p>25+</div><div class=comments><h3>2</h3><p>60<p>45<p>3</div>",
    "<header><h2>3</h2><p>9</header><div><p>12+<p>9+</div><form>4<p>9</form><aside><h3>2</h3><p>25</aside><footer>20</footer>",
    "<div class=sidebar><p>80<p>2</div><h1>4+</h1><p>40+<p>3+<div class=promo>6</div><p>25+<div class=share>2<a>3</a></div>",
    "<nav><a>1</a><a>2</a></nav><div class=layout-sidebar><h1>3+</h1><p>40+<p>4+<p>30+<a>2+</a><p>16+</div>",
    # pages that are all in one element that was never closed or is named oddly
    "<nav><a>1</a> <a>2</a><h1>3+</h1><p>45+<p>1+<p>60+",
    "<div class=menu><h1>5+</h1><p>30+<p>4+<p>20+</div>",
    "<div class=sidebar><p><a>1</a><p>50+<p>15+<p><a>3</a></div>",
)

Tree = bool | tuple[int, float, "Tree", "Tree"]


def grow(rows: Sequence[tuple[float, ...]], least: int = LEAST) -> Tree:
    """A decision tree by Gini impurity, each leaf of at least so many rows: (feature, threshold, at most, above), or the label of a leaf."""
    n, ones = len(rows), sum(r[-1] for r in rows)
    best = None
    for f in range(len(FEATURES) if 0 < ones < n else 0):
        ordered = sorted(rows, key=lambda r: r[f])
        k = 0
        for i, (a, b) in enumerate(zip(ordered, ordered[1:], strict=False), 1):
            k += a[-1]
            if a[f] < b[f] and least <= i <= n - least:
                impure = k * (i - k) / i + (ones - k) * (n - i - ones + k) / (n - i)
                if best is None or impure < best[0] - 1e-9:
                    best = impure, f, (a[f] + b[f]) / 2
    if best is None or ones * (n - ones) / n - best[0] < 1e-9:
        return 2 * ones > n
    _, f, t = best
    low, high = grow([r for r in rows if r[f] <= t], least), grow([r for r in rows if r[f] > t], least)
    return low if isinstance(low, bool) and low == high else (f, t, low, high)


def places(found: list[Block], elements: Elements) -> list[int]:
    """Where each block lies as seen from the home of the page's text."""
    parents, tags = elements.parents, elements.tags
    own = [(100 * (b.words - b.linked) + b.linked) * (MORE if b.article else 1) if b.named < ELSE else 0 for b in found]
    weight = [0] * len(tags)
    for b, w in zip(found, own, strict=True):
        weight[b.element] += w
    for e in range(len(tags) - 1, 0, -1):
        weight[parents[e]] += weight[e]
    enough = MOST * weight[0]
    home = deepest = 0
    for e in range(1, len(tags) if enough else 0):
        if parents[e] == deepest and weight[e] >= enough and tags[home] != "article":
            deepest = e
            home = e if tags[e] in HOMES else home
    inside, around = [home == 0] * len(tags), {home}
    for e in range(1, len(tags)):
        inside[e] = e == home or inside[parents[e]]
    e = home
    while e:
        e = parents[e]
        around.add(e)
    believed = sum(w for b, w in zip(found, own, strict=True) if b.article) >= enough > 0
    several = believed and not any(b.article for b in found if b.element in around) and not any(tags[e] in ARTICLES for e in around)
    out = []
    for b in found:
        if believed:
            out.append(HOME if (b.article if several else inside[b.element]) else OUTSIDE)
        else:
            out.append(HOME if inside[b.element] else AROUND if b.element in around else BESIDE)
    return out


def features(found: list[Block], elements: Elements) -> list[tuple[float, ...]]:
    size = [(b.words, b.linked / b.words) for b in found]
    beyond = [(0, 0.0), *size, (0, 0.0)]
    has_article = any(b.article and b.named < ELSE for b in found)
    # where hardly any text stands outside of what is named as something else, and most of the page in one such element, that name tells little
    text = sum(b.words - b.linked for b in found if b.named < ELSE and b.words - b.linked >= LONG)
    in_top = Counter[int]()
    for b in found:
        in_top[b.top] += b.words
    most = 0.6 * sum(in_top.values())
    if not has_article and text < 2 * LONG:
        found = [replace(b, named=PASSING) if b.named == ELSE and in_top[b.top] >= most else b for b in found]
    return [(*beyond[i + 1], *beyond[i], *beyond[i + 2], place, b.named, b.heading) for i, (b, place) in enumerate(zip(found, places(found, elements), strict=True))]


def is_main(tree: Tree, x: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[3] if x[tree[0]] > tree[1] else tree[2]
    return tree


def labelled(pages: Iterable[str] = LABELLED, sizes: Sequence[float] = SIZES) -> list[tuple[float, ...]]:
    """The blocks of labelled pages in the order of FEATURES, and then 1 for main text, 0 for anything else; each once. Pages come in several sizes: longer blocks grow and shrink."""
    rows = {}
    for size in sizes:
        words = lambda m: ("+ " if m[2] else "- ") * int(int(m[1]) * (size if int(m[1]) >= LONG and m[2] else 1))  # noqa: B023, E731
        for page in pages:
            found, elements = blocks(re.sub(r"(\d+)(\+?)(?![^<]*>)", words, page))
            rows.update({(*x, int(b.text[0] == "+")): None for b, x in zip(found, features(found, elements), strict=True)})
    return list(rows)


TREE = grow(labelled())


def main_text(page: str | None, tree: Tree = TREE) -> str:
    found, elements = blocks(page or "")
    return " ".join(b.text for b, x in zip(found, features(found, elements), strict=True) if is_main(tree, x))


def extracted(df: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """df, without the column page, with text (string) and n_chars (long)."""
    keep = [c for c in df.columns if c not in (page, text, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["row", "text", "n_chars"])

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(page).cast("string").alias("page"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return out.select("row.*", F.col("text").alias(text), "n_chars")
