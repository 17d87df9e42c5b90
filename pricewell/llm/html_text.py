"""Main text of web pages by two passes over their blocks.

A page is cut into blocks of text at block-level tags. The first pass decides what it can: parts of
the page that markup names as menu, advert, notice, form or comment are out, as are blocks of
links; blocks long enough and dense in stop words are in, with lower limits inside an article element. On a page
in which hardly any word is a stop word, its language is another one, and length alone decides. A form that holds most of a
page's text is no form of the page but its frame. The second pass gives each undecided block the label of its nearest decided neighbours; one inside an
article element is out only between blocks of links.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD_WORDS = 20
GOOD_STOP_WORDS = 0.10
BAD_LINKS = 0.5
ARTICLE_GOOD_WORDS = 10
ARTICLE_GOOD_STOP_WORDS = 0.05
ARTICLE_BAD_LINKS = 0.8
# Share of stop words in a page's text below which its language is none of those listed.
OTHER_LANGUAGE = 0.03
FRAME_SHARE = 0.5

# Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = frozenset("""
a an and are as at be by for from in is it of on or that the this to was were with
au aux ce de des du en est et il la le les par pas pour que qui sur un une
auf das dem den der die ein eine er für ist mit nicht sich sie und von zu
al con del el es ha las lo los no por se su y
""".split())

BLOCK_TAGS = frozenset("""
address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul
""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUT_TAGS = frozenset("aside button dialog footer head iframe menu nav noscript object select svg template textarea title canvas audio video".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
# Words in a class or id that mark a part as no article text (fixed values).
OUT_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies
disclaimer discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination
popup promo promotion promoted recommended related replies reply respond share sharing sidebar sidebars signup social sponsor sponsored
subscribe tags toolbar widget widgets
""".split())
# Beside such a word a name tells of a part elsewhere, or of none (fixed values).
STATE_WORDS = frozenset("has have with without no not non is free".split())
# A name that ends in such a word is of a part that holds text (fixed values).
TEXT_WORDS = frozenset("article content main page story".split())
# A tag whose start ends the open one of its kind, and the elements in which it looks for that.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
}
CLOSES_P = BLOCK_TAGS - {"br", "body", "html", "head", "title", "option"}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
TELLING = re.compile(r"class|id|role|style", re.I)  # also in "hidden" and "aria-hidden"
NAME_PART = re.compile(r"[a-z]+")
WORD = re.compile(r"\w+")
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _names_out(value: str) -> bool:
    """Whether a class or id has a name that is, begins or ends with one of OUT_NAMES. Other parts of a name do not count."""
    for name in value.split():
        parts = NAME_PART.findall(name)
        if not parts or STATE_WORDS.intersection(parts):
            continue
        if parts[-1] in OUT_NAMES or parts[0] in OUT_NAMES and parts[-1] not in TEXT_WORDS:
            return True
    return False


def _is_out(tag: str, attributes: str) -> bool:
    if tag in OUT_TAGS:
        return True
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes and TELLING.search(attributes) else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and tag not in ("body", "html", "main", "article") and _names_out(value):
            return True
        if name == "role" and value in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class Block:
    __slots__ = ("text", "linked", "out", "article", "tag", "form", "stops", "words")

    def __init__(self, text: str, linked: int, out: bool, article: bool, tag: str, form: bool = False):
        self.text, self.linked, self.out, self.article, self.tag, self.form = text, linked, out, article, tag, form
        words = WORD.findall(text.lower())
        self.stops = sum(w in STOP_WORDS for w in words)
        # scripts without spaces: two characters count as a word
        self.words = max(len(words), len(UNSPACED.findall(text)) // 2)


class _Open:
    """Elements not yet ended, with what is asked of them kept as counts and positions, so that no question walks the stack."""

    def __init__(self):
        self.stack: list[tuple[str, bool]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[str] = []
        self.out = self.out_inline = 0

    def __getitem__(self, tag: str) -> int:
        """How many of a tag are open."""
        return len(self.at.get(tag, ()))

    def last(self, tags) -> int:
        """Where the innermost of some tags stands, else -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag: str, out: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, out))
        if tag in BLOCK_TAGS:
            self.blocks.append(tag)
            self.out += out
        else:
            self.out_inline += out

    def end(self, place: int) -> None:
        """End the element at a place and all inside it."""
        while len(self.stack) > place >= 0:
            tag, out = self.stack.pop()
            self.at[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()
                self.out -= out
            else:
                self.out_inline -= out


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order. Tags may be left open: a block tag ends an open paragraph, an item the item before it, an end tag
    all that it holds. Inline parts that markup names as no text are left out of their block."""
    found: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    linked: list[str] = []
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            links = len(" ".join(html.unescape("".join(linked)).split()))
            article = bool(open_["article"] or open_["main"])
            out = bool(open_.out or open_["header"] and not article)
            found.append(Block(text, links, out, article, open_.blocks[-1] if open_.blocks else "", bool(open_["form"])))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        if text and not open_.out_inline:
            parts.append(text)
            if open_["a"]:
                linked.append(text)

    for m in MARKUP.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
        if m.group(2):
            open_.end(open_.last((tag,)))
        elif tag not in VOID_TAGS and not m.group(4).endswith("/"):
            if tag in SIBLINGS:
                own, inside = SIBLINGS[tag]
                place = open_.last(own)
                if place > open_.last(inside):
                    open_.end(place)
            if tag in CLOSES_P:
                open_.end(open_.last(("p",)))
            if tag == "a":
                open_.end(open_.last(("a",)))
            open_.push(tag, _is_out(tag, m.group(4)))
    add(page[at:])
    flush()
    # What a form holds is out, unless it is most of the page.
    told = sum(len(b.text) for b in found if not b.out)
    if sum(len(b.text) for b in found if b.form and not b.out) <= FRAME_SHARE * told:
        for b in found:
            b.out = b.out or b.form
    return found


def fits(found: list[Block]) -> bool:
    """Whether the stop words are of the page's language, by their share in text that is neither out nor mostly links."""
    read = [b for b in found if not b.out and b.linked <= BAD_LINKS * len(b.text)]
    return sum(b.stops for b in read) >= OTHER_LANGUAGE * sum(b.words for b in read)


def first_pass(block: Block, listed: bool = True) -> bool | None:
    """True for article text, False for none, None when words and links do not tell. Inside an article element the limits are lower;
    without a list of stop words for the language (``listed``) only length counts."""
    links = block.linked / len(block.text)
    if block.out or not block.article and links > BAD_LINKS:
        return False
    # A paragraph or heading of an article may be one link; items of a list are settled by the items beside them.
    if block.article and links > ARTICLE_BAD_LINKS and block.tag != "p" and block.tag not in HEADINGS:
        return False
    least, dense = (ARTICLE_GOOD_WORDS, ARTICLE_GOOD_STOP_WORDS) if block.article else (GOOD_WORDS, GOOD_STOP_WORDS)
    if block.words >= least and (not listed or block.stops >= dense * block.words) and links <= BAD_LINKS:
        return True
    return None


def _nearest(labels: list[bool | None]) -> tuple[list[int | None], list[int | None]]:
    """Per block the nearest decided block before it and after it; a decided block is its own."""
    before, last = [], None
    for i, label in enumerate(labels):
        last = i if label is not None else last
        before.append(last)
    after, nxt = [None] * len(labels), None
    for i in range(len(labels) - 1, -1, -1):
        nxt = i if labels[i] is not None else nxt
        after[i] = nxt
    return before, after


def _settle_article(labels: list[bool | None], found: list[Block]) -> list[bool | None]:
    """Undecided blocks of an article element are in, unless their nearest decided blocks on both sides are out by their links.

    Parts that markup names, such as comments, say nothing of the blocks beside them."""
    inside = [i for i, b in enumerate(found) if b.article and not b.out]
    own = [labels[i] for i in inside]
    items = [found[i].tag == "li" for i in inside]
    for n, (item, label) in enumerate(zip(items, list(own))):
        if item and label is False:
            # A link among items of text is an item of the article's list; a list of nothing but links is a menu.
            near = [m for m in (n - 1, n + 1) if 0 <= m < len(inside) and items[m]]
            if any(found[inside[m]].linked <= ARTICLE_BAD_LINKS * len(found[inside[m]].text) for m in near):
                own[n] = None
    before, after = _nearest(own)
    labels = list(labels)
    for i, label, left, right in zip(inside, own, before, after):
        if label is None:
            labels[i] = left is None or right is None or own[left] or own[right]
    return labels


def second_pass(labels: list[bool | None], found: list[Block]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block; at equal distance a heading that of the block after, others that before.

    On a page with an article element its own blocks are settled first. Outside of it a heading takes the label of
    the next decided block, and at equal distance so do others: a headline and lead stand before the element, notes behind it."""
    has_article = any(b.article for b in found)
    if has_article:
        labels = _settle_article(labels, found)
    before, after = _nearest(labels)
    out = []
    for i, label in enumerate(labels):
        left, right = before[i], after[i]
        heading = found[i].tag in HEADINGS
        if label is not None:
            out.append(label)
        elif left is None and right is None:
            out.append(False)
        else:
            d_left = i - left if left is not None else len(labels)
            d_right = right - i if right is not None else len(labels)
            to_right = d_right < d_left or d_right == d_left and (heading or has_article) or has_article and heading and right is not None
            out.append(labels[right] if to_right else labels[left])
    return out


def main_text(page: str | None) -> str:
    """Text of the page's article: kept blocks joined by one space."""
    if not page:
        return ""
    found = blocks(page)
    listed = fits(found)
    kept = second_pass([first_pass(b, listed) for b in found], found)
    return " ".join(b.text for b, keep in zip(found, kept) if keep)


def _text_batches(batches, at: int):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(at)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"]
        )


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (code points) in place of columns of those names.

    A null or empty page, one without markup or text to decide on, or one of menus only has an empty text. Character references
    are decoded, white space within a block becomes one space, blocks are joined by one space; a tag cut off at the page's
    end is no text. Repeated rows give repeated rows; an empty table gives none.
    """
    kept = [F.col(c) for c in pages.columns if c not in ("text", "n_chars", html_col)]
    ready = pages.select(*kept, F.col(html_col).cast("string").alias(html_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields)
    at = len(kept)
    return ready.mapInArrow(lambda b: _text_batches(b, at), f"{schema}, text string, n_chars long").drop(html_col)
