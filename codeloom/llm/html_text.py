"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block's features are
its word count and link density, those of its neighbours, and one hint: whether the
containers around it are named or tagged as content or as boilerplate. A decision tree, trained on the
blocks of the labelled pages below, says which blocks are main text. Names that speak for
both sides, or deny what they name (has-sidebar), give no hint, and on pages without hints
word counts and link densities decide alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_columns
from codeloom.runtime import prepare

# Tags by what they do to text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head title style script noscript template iframe object svg math canvas audio video select textarea button datalist".split())
BOILERPLATE_TAGS = set("nav footer aside menu dialog".split())
#: Boilerplate around inputs, but some systems put the whole page into one.
WRAPPER_TAGS = {"form", "fieldset"}
CONTENT_TAGS = {"article", "main"}
FOREIGN_TAGS = {"svg", "math"}
# Open elements that a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
# Words in class, id or role attributes.
BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice alert sidebar side comment comments reply replies "
    "menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended newsletter subscribe signup login popup modal widget "
    "toolbar pagination pager complementary contentinfo disclaimer copyright masthead".split()
)
CONTENT_WORDS = set("article content story post entry body main text".split())
# A name that begins so speaks about the page, not about what is inside.
ABOUT_WORDS = set("has with without no is show hide".split())
# What may stand in a head, whose end tag can be left out, and blocks that hold text and no other blocks.
HEAD_TAGS = set("head html base basefont bgsound link meta title style script noscript template".split())
TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 p pre blockquote dt figcaption caption summary".split())

# a quote opens a value only after an equals sign, and possessive repeats keep a broken tag linear
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+)(?:>|\Z)|([^<]+|<)""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "template")}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: The labelled table: blocks of small pages, each with + (main text) or - before its text
#: and numbers in braces for so many words. The features are read off the pages.
LABELLED_PAGES = [
    # an article in its container, with what usually stands around and inside it
    """<header><a href=/>-{2}</a><p>-{9}</p></header><nav><ul><li><a href=/a>-{1}</a><li><a href=/b>-{2}</a></ul></nav><div class="ad">-{12}</div>
    <article><h1>+{7}</h1><p>+{80}</p><p>+{1}</p><h2>+{3}</h2><p>+{45} <a href=x>{6}</a></p><ul><li><a href=y>+{4}</a><li>+{5}</ul><aside>-{30}</aside>
    <form>-{4}</form><p>+{60}</p><div class="share"><a href=t>-{1}</a></div><div class="comments"><h3>-{2}</h3><p>-{70}</p><p>-{25}</p></div></article>
    <div id="cookieNotice">-{18}</div><footer>-{11}</footer>""",
    """<body class="has-sidebar"><div class="top menu"><a href=/>-{3}</a></div><main><h1>+{5}</h1><p>+{12}</p><blockquote>+{25}</blockquote><p><a href=z>+{9}</a></p>
    <div class="newsletter"><p>-{22}</p></div><table><tr><td>+{2}<td>+{1}</table><p>+{3}</p></main><div class="sidebar"><h3>-{2}</h3><p>-{90}</p></div><div class="footer"><p>-{40}</p></div>""",
    """<div class="cookie-banner"><p>-{35}</p></div><div class="post"><p>+{2}</p><p>+{6}</p><p>+{150}</p><p>+{2}</p></div><div class="related"><a href=q>-{8}</a><a href=r>{9}</a></div>
    <section id="comments"><p>-{120}</p><p>-{4}</p></section>""",
    # short and linked blocks of articles, right after and before menus
    """<nav><ul><li><a href=/a>-{2}</a><li><a href=/b>-{1}</a></ul></nav><article><h1>+{6}</h1><h2>+{3}</h2><p>+{4}</p><p>+{2}</p></article><footer><a href=/i>-{2}</a></footer>""",
    """<nav><a href=/a>-{3}</a></nav><article><p>+{1}</p></article><div class="related"><a href=/x>-{6}</a></div>""",
    """<nav><a href=/a>-{1}</a></nav><div class="story"><h1>+{9}</h1><h2>+{5}</h2><p>+{33}</p><h3>+{1}</h3><p><a href=/t>+{2}</a></p><p><a href=/u>+{25}</a></p><h3>+{2}</h3></div><div class="nav"><a href=/n>-{4}</a></div>""",
    """<div class="ad"><a href=/a>-{8}</a></div><main><h2>+{2}</h2><h3>+{4}</h3><p>+{14}</p><ul><li><a href=1>+{1}</a><li><a href=2>+{3}</a><li><a href=3>+{11}</a></ul></main><div class="footer">-{5}</div>""",
    """<div class="menu"><a href=/a>-{2}</a></div><article><h1>+{3}</h1><p><a href=1>+{40}</a></p><p>+{18}</p><p><a href=2>+{5}</a></p><p>+{2}</p></article><nav><a href=/n>-{3}</a><a href=/m>{3}</a></nav>""",
    # articles that end a page, down to one short block
    """<nav><a href=/>-{2}</a></nav><article><h1>+{5}</h1><p>+{64}</p><p>+{6}</p><p>+{3}</p></article>""",
    """<nav><a href=/>-{1}</a></nav><article><p>+{28}</p><p>+{9}</p></article>""",
    """<nav><a href=/a>-{2}</a> <a href=/b>{1}</a></nav><main><p>+{12}</p></main>""",
    """<article><h1>+{2}</h1><p>+{5}</p></article>""",
    """<article><p>+{3}</p></article>""",
    """<div class="entry"><p>+{52}</p><p>+{77}</p><p>+{1}</p></div>""",
    """<div class="post"><p>+{1}</p><p>+{1}</p></div>""",
    """<main><p>+{120}</p><p>+{11}</p><p>+{13}</p></main>""",
    """<article><h2>+{4}</h2><p>+{95}</p><p><a href=k>+{3}</a></p></article>""",
    # containers whose names say little or too much
    """<form><div><a href=/>-{1}</a></div><div><a href=/b>-{1}</a></div><article><h1>+{6}</h1><p>+{70}</p><p>+{9}</p><p>+{40}</p></article><p>-{3}</p></form>""",
    """<div id="menu-wrapper"><a href=/>-{2}</a><br><article><h1>+{4}</h1><p>+{55}</p><p>+{30}</p><p>+{7}</p><p>+{65}</p></article></div>""",
    """<form><article><h1>+{2}</h1><p>+{85}</p></article></form>""",
    """<div class="menu-page"><article><p>+{30}</p><h2>+{3}</h2><p>+{62}</p><p>+{4}</p><p>+{38}</p></article><div class="comments"><p>-{66}</p><p>-{31}</p></div></div>""",
    """<form><div class="content"><h1>+{8}</h1><p>+{48}</p><p>+{9} <a href=k>{3}</a></p><p>+{58}</p><div class="comment"><p>-{2}</p><p>-{44}</p></div></div></form>""",
    """<div class="widget"><article><a href=1>-{6}</a></article><article><a href=2>-{8}</a></article><article><a href=3>-{5}</a></article></div>""",
    """<div class="related"><article><h3><a href=1>-{5}</a></h3><p>-{9}</p></article><article><h3><a href=2>-{7}</a></h3><p>-{10}</p></article></div>""",
    # pages without any hint
    """<div><a href=/>-{1}</a></div><div><a href=/a>-{1}</a></div><div><a href=/b>-{2}</a></div><h1>+{6}</h1><p>+{70}</p><p>+{52}</p><p>+{90} <a href=x>{4}</a></p><div><a href=/n>-{2}</a></div><p>-{6}</p>""",
    """<h1>+{4}</h1><p>+{60}</p><p>+{3}</p><p>+{60}</p>""",
    """<p><a href=/>-{3}</a> <a href=/a>{3}</a></p><h1>+{9}</h1><p>+{35}</p><h2>+{3}</h2><p>+{48}</p><p>+{8}</p><p>+{41}</p><p><a href=/c>-{5}</a></p><p>-{4}</p>""",
    """<div><a href=/>-{2}</a></div><p>-{5}</p><div><a href=/x>-{12}</a></div><h1>+{5}</h1><p>+{110}</p><p>+{20}</p><p>+{64}</p><p>+{16}</p><div><a href=/y>-{3}</a></div><p>-{9}</p><div><a href=/z>-{2}</a></div>""",
    """<div><a href=/>-{1}</a></div><div>-{2}</div><div><a href=/q>-{6}</a></div><p>+{28}</p><p>+{31}</p><p>+{26}</p><div><a href=/r>-{4}</a></div><div>-{3}</div>""",
    """<div><a href=/>-{1}</a> <a href=/b>{2}</a></div><p>-{4}</p><h1>+{8}</h1><p>+{44}</p><p>+{72}</p><p>+{57}</p><p>-{5}</p>""",
    """<div><a href=/>-{3}</a></div><h1>+{5}</h1><p>+{66}</p><p>+{31}</p><p>-{7}</p>""",
    """<div><a href=/>-{2}</a></div><div><a href=/c>-{1}</a></div><p>-{6}</p><p>+{38}</p><p>+{83}</p><p>+{24}</p><p>-{4}</p><div><a href=/d>-{2}</a></div>""",
    """<p>-{3}</p><p><a href=/>-{1}</a></p><h1>+{7}</h1><p>+{29}</p><p>+{97}</p><p>-{3}</p><p>-{6}</p>""",
    """<div><a href=/>-{2}</a></div><div><a href=/b>-{1}</a></div><p>+{63}</p><p>+{49}</p><div><a href=/c>-{1}</a></div><p>+{71}</p>""",
    """<p>+{140}</p>""",
    """<p>+{25}</p><p>+{18}</p>""",
    """<h1>+{2}</h1><p>+{22}</p>""",
    """<p><a href=/>-{4}</a></p><p>-{2}</p>""",
    """<ul><li><a href=/1>-{4}</a><li><a href=/2>-{7}</a><li><a href=/3>-{30}</a><li><a href=/4>-{6}</a></ul><p>-{8}</p>""",
    """<div>-{3}</div><div><a href=/1>-{2}</a></div><div>-{7} <a href=/2>{9}</a></div><h1>+{8}</h1><p>+{75}</p><p>+{12}</p><p>+{50}</p>""",
]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    content: bool
    boilerplate: bool  # also inside the innermost content container
    outer: bool  # boilerplate around that container

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0

    @property
    def hint(self) -> int:
        """1 in content, -1 in boilerplate, 0 where containers say nothing or both."""
        return -1 if self.boilerplate else int(self.content and not self.outer)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order.

    Linear in the page: what the open elements mean is counted, and each element is opened
    and closed once, however many are open.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # open elements and what they mean: "c", "b", "B", "h" or ""
    names: Counter[str] = Counter()  # of the open elements
    kinds: Counter[str] = Counter()  # of their meanings
    good, bad = [], []  # depths of content and of boilerplate containers
    parts: list[tuple[str, bool]] = []
    link = 0  # open elements when the link began, and one

    def close() -> None:
        text = "".join(p for p, _ in parts)
        words = len(text.split())
        if words:
            linked = sum(len(p.split()) for p, a in parts if a)
            out.append(Block(" ".join(text.split()), words, min(linked, words), bool(good), bool(bad) and (not good or bad[-1] > good[-1]), bool(bad and good) and bad[0] < good[-1]))
        parts.clear()

    def push(tag: str, kind: str) -> None:
        if kind in ("c", "b", "B"):
            (good if kind == "c" else bad).append(len(stack))
        stack.append((tag, kind))
        names[tag] += 1
        kinds[kind] += 1

    def pop() -> None:
        nonlocal link
        tag, kind = stack.pop()
        if kind in ("c", "b", "B"):
            (good if kind == "c" else bad).pop()
        names[tag] -= 1
        kinds[kind] -= 1
        if link > len(stack) + 1:
            link = 0

    at = 0
    while m := _TOKEN.match(page, at):
        if m.end() == at:
            break
        at = m.end()
        if stack and stack[-1][0] == "head" and (m[4].strip() if m[4] is not None else m[2] and m[1] != "/" and m[2].lower() not in HEAD_TAGS):
            pop()
        if m[4] is not None:
            if not kinds["h"]:
                parts.append((entities.unescape(m[4]), link > 0))
            continue
        if not m[2]:
            continue
        tag, closing, attributes = m[2].lower(), m[1] == "/", m[3] or ""
        foreign = tag in FOREIGN_TAGS or names["svg"] or names["math"]
        if foreign and not closing and attributes.endswith("/"):
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else len(stack) + 1
            elif tag in ("br", "img"):
                parts.append((" ", False))
            continue
        close()
        if closing:
            while names[tag]:
                last = stack[-1][0]
                pop()
                if last == tag:
                    break
        elif tag in _RAW_END and not foreign:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            while stack and (stack[-1][0] == "p" or stack[-1][0] in ENDS.get(tag, ())):
                pop()
            push(tag, _meaning(tag, attributes, names, kinds))
    close()
    return out


def _meaning(tag: str, attributes: str, names: Counter[str], kinds: Counter[str]) -> str:
    """What an element says of the text in it: "h" hidden, "B" boilerplate by its tag, "b"
    boilerplate by name (or a form), which an article inside can outweigh, "c" content."""
    if tag in HIDDEN:
        return "h"
    if tag in BOILERPLATE_TAGS or (tag == "header" and not names["article"]):
        return "B"
    if tag in ("body", "html"):
        return ""
    tokens = [(a.lower(), [w for w in _SPLIT.split(_CAMEL.sub("-", x).lower()) if w]) for a, v in _ATTRIBUTE.findall(attributes) for x in v.strip("\"'").split()]
    bad, good = set(), set()
    for a, words in tokens:
        if not words or words[0] in ABOUT_WORDS:
            continue
        low, high = BOILERPLATE_WORDS.intersection(words), CONTENT_WORDS.intersection(words)
        # the id of a section of the article is its topic, unless it says nothing but boilerplate
        if a == "id" and tag == "section" and kinds["c"] and set(words) - BOILERPLATE_WORDS:
            continue
        bad |= low
        # of words for both sides in one name the last says what it is
        if high and (not low or words[-1] in high):
            good |= high
    if bad and tag not in TEXT_TAGS and len(good) < len(bad):
        return "b"
    if tag in CONTENT_TAGS:
        return "" if kinds["B"] else "c"
    if tag in WRAPPER_TAGS:
        return "b"
    return "c" if len(good) > len(bad) and not kinds["B"] else ""


def vectors(found: list[Block]) -> list[tuple[float, ...]]:
    out = []
    for i, b in enumerate(found):
        before = (found[i - 1].words, found[i - 1].density) if i else (0, 0.0)
        after = (found[i + 1].words, found[i + 1].density) if i + 1 < len(found) else (0, 0.0)
        out.append((b.words, b.density, *before, *after, b.hint))
    return out


def labelled(pages: list[str] = LABELLED_PAGES) -> list[tuple[tuple[float, ...], int]]:
    """(features, main text or not) of all blocks of labelled pages."""
    rows = []
    for page in pages:
        marked = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        if any(b.text[0] not in "+-" for b in marked):
            raise ValueError("a block without a label")
        rows += [(x, int(b.text[0] == "+")) for b, x in zip(marked, vectors(marked), strict=True)]
    return rows


def train(rows: list[tuple[tuple[float, ...], int]], depth: int = 8):
    """A binary decision tree by Gini impurity: a label, or (feature, threshold, left, right)."""
    labels = [y for _, y in rows]
    share = sum(labels) / len(labels)
    if depth == 0 or share in (0, 1):
        return int(share >= 0.5)
    best = None
    for f in range(len(rows[0][0])):  # of equal splits, the one on the first feature: words before hints
        values = sorted({x[f] for x, _ in rows})
        for lo, hi in zip(values, values[1:], strict=False):
            t = (lo + hi) / 2
            left, right = [y for x, y in rows if x[f] <= t], [y for x, y in rows if x[f] > t]
            impurity = sum(2 * sum(s) * (1 - sum(s) / len(s)) for s in (left, right)) / len(rows)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, t)
    if best is None:
        return int(share >= 0.5)
    _, f, t = best
    return (f, t, train([r for r in rows if r[0][f] <= t], depth - 1), train([r for r in rows if r[0][f] > t], depth - 1))


def classify(tree, x: tuple[float, ...]) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree) -> str:
    """Main blocks joined by an empty line; nothing for a null or empty page."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, x in zip(found, vectors(found), strict=True) if classify(tree, x))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text (empty if none), n_chars.

    A null or empty html gives an empty text, null ids and urls stay null, repeated rows
    give repeated results, and other columns are ignored, whatever their names. A page of
    any length and depth is one row's work, linear in its length. An empty table gives no rows.
    """
    prepare(pages.sparkSession)
    tree = train(labelled())

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, urls, sources in batches:
            texts = [main_text(s, tree) for s in sources]
            yield [ids, urls, texts, [len(t) for t in texts]]

    return map_columns(pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)), f"`{id_col}` long, `{url_col}` string, text string, n_chars long", run)
