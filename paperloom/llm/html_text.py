"""HTML extraction by two-pass block rules.

Pass one decides blocks by themselves: blocks inside menus, headers, footers, sidebars, forms, adverts, notices and
reader comments (by element, class, id or role) or, outside of an article, made of links are boilerplate; long blocks
with enough stop words are text, and so are those in a script that the stop words aren't of, for which length and links
decide; link-free long blocks without stop words are boilerplate outside of an article. Everything else is ambiguous:
short blocks, headings, and whatever an article holds that isn't boilerplate, links included.
A class or id counts only by whole names of a closed list (`sidebar`, `site-nav`; not `with-sidebar`), not around a main
element, and, if no article or main is outside of such names, not around most of the page's text (except for reader
comments). If pass one finds no text at all, the text is every block that isn't boilerplate by place or links (of the
article, if there is one).
Pass two gives ambiguous blocks the label of the nearest decided neighbour (inside an article: of the neighbours in it
only, and text if there is none); between a text and a boilerplate neighbour at one distance the block is text if it
shares its parent element with the text one.

Character references are decoded once, white space inside a block (no-break spaces and line breaks too) becomes one
space, blocks are trimmed and joined by one newline in page order. Null, empty or markup-only pages give an empty
text; unclosed and stray tags, unclosed comments and truncated pages are read as far as they go, in time linear in the
page however deep its elements are nested. Repeated rows get equal texts; an empty table gives an empty table; extra columns stay, except namesakes of the result columns.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, namedtuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.common import extended, lean, put_columns

SHORT, DENSE, LINKED = 60, 0.25, 0.5

#: Frequent function words.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "als auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht nur oder sich sie sind so um und von vor war wie wird zu zum zur "
    "al como con del el ella en entre era es esta este fue ha la las lo los más me mi muy no o para pero por que se ser si sin sobre su sus también un una y ya".split()
)
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul caption iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD = frozenset("nav footer aside form head title button select option menu dialog iframe".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = "script|style|noscript|template|textarea|noembed|noframes"
#: Words of class and id names of boilerplate, and words that may stand beside them. A name is a hint if it has one of
#: the former and nothing but these: `site-nav` is, `with-sidebar`, `has-comments` and `tag-travel` aren't. Those
#: of PLAIN and REPLIES are what is to go anywhere: menus, headers, footers, sidebars, notices, adverts, forms, reader
#: comments. Those of AROUND are lists and boxes about a page, and count outside of an article only.
REPLIES = frozenset("comment comments commentlist replies disqus".split())
PLAIN = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts popup "
    "newsletter subscribe subscription signup paywall login sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer footers masthead skiplink".split()
)
AROUND = frozenset("banner banners share sharing social related recommended recommendation recommendations modal overlay widget widgets tag tags".split())
HINTS = REPLIES | PLAIN | AROUND
BESIDE = frozenset("site main top bottom left right primary secondary page post global container wrapper wrap box bar list block area section inner outer side mast head skip link links buttons row slot unit 1 2 3 4".split())
JOINED = frozenset("side-bar mast-head skip-link".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAME = re.compile(r"[-_]+")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[^\W\d_]+")
OTHER_SCRIPTS = "\u0370"  # letters from here on are Greek, Cyrillic and further scripts


class _Block:
    __slots__ = ("parts", "linked", "bad", "article", "parent", "heading", "text", "label", "hints", "outer")

    def __init__(self, bad, hints, article, outer, parent, heading):
        self.parts, self.linked, self.bad, self.hints, self.article, self.outer, self.parent, self.heading, self.label = [], 0, bad, hints, article, outer, parent, heading, None


def hinted(value: str) -> str:
    """What a class or id value says by a whole name: `replies`, `plain`, `around` or nothing."""
    said = set()
    for name in value.lower().split():
        words = [w for w in NAME.split(name) if w]
        if name.replace("_", "-") in JOINED:
            said.add("plain")
        elif all(w in HINTS or w in BESIDE for w in words):
            said.update(kind for kind, names in (("replies", REPLIES), ("plain", PLAIN), ("around", AROUND)) if any(w in names for w in words))
    return next((kind for kind in ("replies", "plain", "around") if kind in said), "")


class _Hints:
    """The hinted elements of a page: each knows the hinted element around it (0: none), so all is linear in the page."""

    def __init__(self):
        self.around: dict[int, int] = {}  # in page order, so an element comes after the one around it
        self.replies: set[int] = set()

    def add(self, number: int, around: int, reply: bool) -> int:
        self.around[number] = around
        if reply:
            self.replies.add(number)
        return number

    def below(self, mark) -> set[int]:
        """Hinted elements for which mark holds, and those inside of them."""
        out: set[int] = set()
        for h, up in self.around.items():
            if up in out or mark(h):
                out.add(h)
        return out


def _weigh(out: list[_Block], hints: _Hints) -> None:
    """Which hints count: not those around what is most of the page's text if no article is outside of all hints (reader
    comments excepted)."""
    size = lambda b: max(0, len(b.text) - b.linked)
    held, total = dict.fromkeys(hints.around, 0), 0
    for b in out:
        if not b.bad:
            total += size(b)
            if b.hints:
                held[b.hints] += size(b)
    for h, up in reversed(hints.around.items()):
        if up:
            held[up] += held[h]
    clean = any(b.article and not b.outer and not b.bad for b in out)
    void = set() if clean else {h for h, n in held.items() if 2 * n > total and h not in hints.replies}
    talk = hints.below(lambda h: h in hints.replies)
    inside = [b for b in out if b.article and b.outer and not b.bad and b.outer not in talk]
    rest = sum(size(b) for b in out if not b.bad and not b.hints)
    if not clean and sum(size(b) for b in inside if b.hints == b.outer) >= max(rest, 1):
        seen: set[int] = set()
        for b in inside:
            h = b.outer
            while h and h not in seen:
                seen.add(h)
                h = hints.around[h]
        void |= seen
    counts = hints.below(lambda h: h not in void)
    for b in out:
        if b.outer in counts:
            b.article = 0
        b.bad = b.bad or b.hints in counts


#: What an open element is to what stands in it.
_Open = namedtuple("_Open", "tag bad hints article outer number")
_TOP = _Open("", False, 0, 0, 0, 0)


class _Stack:
    """Open elements; where each tag and the last block element are is known without looking through them."""

    def __init__(self):
        self.open: list[_Open] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def top(self) -> _Open:
        return self.open[-1] if self.open else _TOP

    def push(self, e: _Open) -> None:
        self.at[e.tag].append(len(self.open))
        if e.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(e)

    def close(self, tag: str, through_blocks: bool) -> None:
        """Closes the last element of that tag and all in it, unless block elements are in the way."""
        k = self.at[tag][-1] if self.at[tag] else None
        if k is None or (not through_blocks and self.blocks and self.blocks[-1] > k):
            return
        while len(self.open) > k:
            e = self.open.pop()
            self.at[e.tag].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def holder(self) -> tuple[str, int]:
        """Tag of the last block element, and number of the element around it."""
        k = self.blocks[-1] if self.blocks else 0
        return self.open[k].tag if self.blocks else "", self.open[k - 1].number if k else 0


def blocks(page: str) -> list[_Block]:
    """Blocks in page order with their surroundings."""
    out: list[_Block] = []
    stack, hints, number, now = _Stack(), _Hints(), 0, None
    mains: set[int] = set()

    def close():
        nonlocal now
        if now is not None:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
        now = None

    for m in TOKEN.finditer(page):
        text = m["text"] if m["cdata"] is None else m["cdata"]
        if text is not None:
            if now is None:
                if text.isspace():
                    continue
                e, (holder, parent) = stack.top(), stack.holder()
                now = _Block(e.bad, e.hints, e.article, e.outer, parent, holder in HEADING)
            now.parts.append(text)
            if stack.at["a"]:
                now.linked += len(text.strip())
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            close()
        elif tag == "br" and now is not None:
            now.parts.append(" ")
        if m["end"] or m["end2"]:
            stack.close(tag, tag in BLOCK)
            continue
        attr = m["attr"] if m["tag"] else m["attr2"]
        if tag in VOID:
            continue
        if tag == "p" or tag == "li":  # a paragraph ends where the next begins
            k = stack.at[tag]
            if k and stack.blocks[-1] == k[-1]:
                stack.close(tag, True)
        _, bad, hint, article, outer, _ = stack.top()
        number += 1
        if tag in ("article", "main") and not bad:
            if not article or tag == "main" and hint and article not in mains:
                article, outer = number, hint
            if tag == "main" and article == number:  # hints around a main element don't count in it
                mains.add(number)
                hint = outer = 0
        if not bad and tag not in ("html", "body", "article", "main"):
            bad = tag in BAD or (tag == "header" and not article)
            for name, value in ATTR.findall(attr) if not bad and attr else ():
                value = value.strip("\"'")
                if name.lower() == "role":
                    bad |= value.lower() in ROLES
                elif (said := hinted(value)) and not (said == "around" and article):
                    hint = hints.add(number, hint if hint != number else hints.around[number], said == "replies" or number in hints.replies)
        stack.push(_Open(tag, bad, hint, article, outer, number))
    close()
    _weigh(out, hints)
    return out


def density(text: str) -> float:
    """Share of stop words; 1 if most letters are of a script that the stop words aren't of."""
    words = WORD.findall(text.lower())
    letters = sum(map(len, words))
    if 2 * sum(c >= OTHER_SCRIPTS for w in words for c in w) > letters:
        return 1.0
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def label(found: list[_Block]) -> None:
    """Both passes: label is True for text."""
    for b in found:
        links = b.linked > LINKED * len(b.text) and not b.article
        dense = not b.bad and not links and len(b.text) >= SHORT and density(b.text) >= DENSE
        if b.bad or links:
            b.label = False
        elif dense and not b.heading:
            b.label = True
        elif len(b.text) >= 3 * SHORT and not b.heading and not b.article:
            b.label = False
    if not any(b.label for b in found):  # nothing to take a label from: all that isn't boilerplate by its place or links
        pool = [b for b in found if not b.bad and (b.article or b.linked <= LINKED * len(b.text))]
        inside = any(b.article for b in pool)
        for b in found:
            b.label = False
        for b in pool:
            b.label = bool(b.article) or not inside
        return
    n, some = len(found), any(b.label for b in found)
    before: list = [None] * n
    after: list = [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict = {}
        for i in order:
            b = found[i]
            key = b.article or None
            side[i] = last.get(key)
            if b.label is not None and not (key and b.bad):
                last[key] = i
    for i, b in enumerate(found):
        if b.label is not None:
            continue
        near = sorted((abs(i - j), found[j].label, j) for j in (before[i], after[i]) if j is not None)
        if not near:
            b.parts = bool(b.article) or not some
        elif len(near) == 2 and near[0][0] == near[1][0] and near[0][1] != near[1][1]:
            good = found[near[0][2] if near[0][1] else near[1][2]]
            b.parts = bool(b.article) or good.parent == b.parent
        else:
            b.parts = bool(b.article and near[0][1] is not False) or near[0][1]
    for b in found:
        if b.label is None:
            b.label = b.parts


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    label(found)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """pages(html, ...) with text and n_chars."""

    def run(batches):
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            texts = [main_text(h) for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
            yield put_columns(batch, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.mapInArrow(lean("op9")(run), extended(pages.schema, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
