"""Pages that real sites hold: attribute values, other languages, frames of forms, implied end tags, inline parts, very deep pages."""

import html as markup
import html.parser
import random
import time

import pytest

from pricewell.llm import html_text as H

TEXT = "This is the first part of an article that was written for the reader and it is about the weather in the north of the country."
OTHER = "Pogoda nad morzem bywa zmienna, lecz mieszkańcy wiosek dawno przywykli, więc rankiem każdy sprawdza niebo, zanim wypłynie łodzią daleko poza spokojną zatokę."
CHINESE = "海边的天气变化很快，村里的人早已习惯，每天早上都会先看看天空，然后才驾船离开平静的海湾，到很远的地方去捕鱼，傍晚再回家。"


@pytest.mark.parametrize("opening", [
    '<div data-state="hidden">', '<article data-hidden="0">', '<section title="Hidden gems">', '<section data-id="menu">', '<div data-grid="header">', '<div itemid="login">',
    "<div title='class=sidebar'>", '<div data-x=\'id="menu"\'>', '<div aria-label="role=navigation">', "<div hiddenish>", '<div style-id="ad">',
])
def test_only_whole_attribute_names_tell(opening):
    tag = opening[1:].split()[0]
    assert H.main_text(f"<body>{opening}<p>{TEXT}</p></{tag}></body>") == TEXT


@pytest.mark.parametrize("opening", ["<div hidden>", '<div HIDDEN="">', "<div class=sidebar>", "<div  id = 'menu' >", '<div a="b"class="ad">', '<div style="color:red; display: none">', "<section aria-hidden=true>", '<div role="navigation">'])
def test_what_does_tell_still_does(opening):
    tag = opening[1:].split()[0]
    assert H.main_text(f"<body>{opening}<p>{TEXT}</p></{tag}><p>{TEXT} Two.</p></body>") == f"{TEXT} Two."


@pytest.mark.parametrize("text", [OTHER, CHINESE])
def test_languages_without_a_list_go_by_length(text):
    page = f"<body><ul class=menu><li><a href=a>{text[:9]}</a></ul><div class=post><p>{text}</p><p>{text[::-1]}</p></div><div><a href=b>{text[:30]}</a></div></body>"
    assert H.main_text(page) == f"{text} {text[::-1]}"
    assert H.main_text(f"<article><p>{text}</p></article>") == text


def test_a_form_around_the_page_is_its_frame():
    assert H.main_text(f"<body><form action=x><div><p>{TEXT}</p><input></div></form></body>") == TEXT
    assert H.main_text(f"<body><article><p>{TEXT}</p></article><form><p>Write to us by the form that is in this place.</p></form></body>") == TEXT
    assert H.main_text("") == H.main_text(None) == H.main_text("<form></form>") == ""


def test_open_items_and_cells_end_at_the_next():
    page = f"<body><article><p>{TEXT}</p><ul><li class=ad>Buy<li>{TEXT} One.<li>{TEXT} Two.</ul></article></body>"
    assert H.main_text(page) == f"{TEXT} {TEXT} One. {TEXT} Two."
    page = f"<table><tr><td class=sidebar>Links<td><p>{TEXT}</p><tr><td>{TEXT} Two.</table>"
    assert H.main_text(page) == f"{TEXT} {TEXT} Two."
    page = f"<dl><dt class=ad>Buy<dd>{TEXT}<dt class=promo>Now<dd>{TEXT} Two.</dl>"
    assert H.main_text(page) == f"{TEXT} {TEXT} Two."
    nested = f"<ul><li class=ad>Buy<ul><li>{TEXT}</ul><li>{TEXT} Two.</ul>"
    assert H.main_text(nested) == f"{TEXT} Two."


def test_inline_parts_named_out_are_left_out():
    assert H.main_text(f"<article><p>{TEXT} <span class=ad>Buy</span>More.</p></article>") == f"{TEXT} More."
    assert H.main_text(f"<article><p>{TEXT} <button>Share</button></p></article>") == TEXT


def test_time_follows_length():
    for opened in ("<li>", "<div>", "<b>", "<p>", "<td>", "<a href=x>", "</div>", "<li></b>"):
        page = "<body>" + opened * 200_000 + f"<p>{TEXT}</p>"
        started = time.process_time()
        H.main_text(page)
        assert time.process_time() - started < 4, opened  # quadratic work would take minutes


class Reader(html.parser.HTMLParser):
    """A second reading of well-formed pages: block texts by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.parts = [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.found += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in H.BLOCK_TAGS:
            self.cut()

    def handle_endtag(self, tag):
        if tag in H.BLOCK_TAGS:
            self.cut()

    def handle_data(self, data):
        self.parts.append(data)


def test_blocks_are_those_of_a_second_parser():
    rng = random.Random(9)
    words = ["one", "two &amp; three", "a &lt; b", "caf&eacute;", "x\n y", " z", "&#8364;5", "“q”"]

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        tag = rng.choice(["div", "p", "ul", "section", "b", "i", "span", "h2", "blockquote", "td", "a"])
        inner = made(depth - 1) if tag in ("p", "h2", "b", "i", "span", "a") else "".join(made(depth - 1) for _ in range(rng.randint(0, 4)))
        attribute = rng.choice(["", ' class="x y"', " data-hidden", " title='>'", ' lang="en"'])
        return f"<{tag}{attribute}>{inner}</{tag}>" + rng.choice(["", " ", "<br>", "<!-- c -->"])

    for _ in range(300):
        page = "".join(made(5) for _ in range(4))
        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.cut()
        assert [b.text for b in H.blocks(page)] == reader.found, page
    assert markup.unescape("&eacute;") == "é"
