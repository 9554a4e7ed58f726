"""The page reader of the HTML extraction: odd and broken markup, time, and a plain parser beside it."""

import random
import time
from html.parser import HTMLParser

import pytest

from sievework.llm.html_text import MOST_NAMES, blocks_of, tag_end


def said(page):
    return [b.text for b in blocks_of(page)]


def test_quotes_count_behind_an_equals_sign_only():
    page = "<article><p title='it's'>The first part isn't kept</p><p>second</p><script src=//x.example/a/>track();</script><p>third</p></article>"
    assert said(page) == ["The first part isn't kept", "second", "third"]
    assert said("<p a=\"x>y\" b='z>w' c=u>one</p><p title= \"q>\">two</p><p \"odd>three</p>") == ["one", "two", "three"]
    assert said('<p a="never closed>one</p><p>two</p>') == ["one", "two"]


def test_a_slash_closes_nothing_but_foreign_and_void_elements():
    assert said("<p>a<br/>b</p><script/>var x;</script><style />p{}</style><p>c</p>") == ["a", "b", "c"]
    assert said("<article><svg><title/><path d='x'/><text>in</text></svg><p>after</p></article>") == ["in", "after"]
    assert [b.label for b in blocks_of("<article><div class='ad'/>one</div>two</article>")] == [0, 1]


def test_markup_that_never_ends_is_text():
    assert said("<p>if a <b and c") == ["if a <b and c"]
    assert said("<p>x <!doctype and no end") == ["x <!doctype and no end"]
    assert said("<p>one<!-- open") == ["one"] and said("<script>open") == []
    assert said("<p>1 < 2 </ 3 <3") == ["1 < 2 </ 3 <3"]
    assert tag_end("<a b", 2) == -1 and tag_end("<a b='>'>", 2) == 9


@pytest.mark.parametrize("piece", ["if a <b and ", '<b x=">" ', '<a b="', "</script ", "<script>a</script ", "<!", "<!--", "<p title='it's'>", "<p ='", "<li><b>", "<b><p>"])
def test_a_long_page_takes_time_in_its_length(piece):
    start = time.process_time()
    blocks_of("<p>" + piece * ((1 << 20) // len(piece)))
    assert time.process_time() - start < 10


def test_deep_pages_keep_the_innermost_names():
    blocks = blocks_of("<article>" + "".join(f"<div class=c{k}>x{k}" for k in range(5000)))
    assert len(blocks) == 5000 and max(len(b.path) for b in blocks) == MOST_NAMES and blocks[-1].path[-1] == ".c4999"
    assert {b.label for b in blocks} == {1}


class Plain(HTMLParser):
    """All text of block elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.out, self.skip = [], [], 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "i", "a", "span", "em"):
            self.flush()
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "span", "em"):
            self.flush()
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_well_formed_pages_read_as_a_plain_parser_reads_them():
    rng = random.Random(6)
    attribute = lambda: rng.choice(["", " class=a", ' id="b c"', " title='x > y'", ' data-k="it\'s"', " hidden", " href=//e.example/p/", ' alt = "q"', "\n a=1\tb='2'"])
    word = lambda: rng.choice(["one", "two &amp; three", "&#233;t&eacute;", "a<3", "x &lt;p&gt; y", "\n", " ", "4 < 5", "&copy 2001"])

    def inside(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5 or depth > 5:
                out.append(word())
            elif kind < 0.7:
                t = rng.choice("b i a span em".split())
                out.append(f"<{t}{attribute()}>{word()}</{t}>")
            elif kind < 0.9:
                t = rng.choice("div section h2 ul DIV".split())
                out.append(f"<{t}{attribute()}>{inside(depth + 1)}</{t}>")
            else:
                out.append(rng.choice(["<script>if (a<b) x='<p>';</script>", "<style>p>a{}</style>", "<!-- a <p> comment -->", f"<hr{attribute()}>", "<script src=/x/>y</script>"]))
        return " ".join(out)

    for _ in range(300):
        page = f"<div>{inside(0)}</div>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.flush()
        assert said(page) == plain.out, page
