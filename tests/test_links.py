"""The link scanner: golden cases of CommonMark, and time in proportion to the text."""

import time

import pytest

from quillspark.functions.commonmark import scan

PLAIN = [
    ("<div>\n[a](no.md)\n</div>\n\n[b](yes.md)", ["yes.md"]),
    ("<!-- [a](no.md) -->\n[b](yes.md)", ["yes.md"]),
    ("x <!-- [a](no.md) --> [b](yes.md)", ["yes.md"]),
    ("<script>\n\n[a](no.md)\n</script>\n[b](yes.md)", ["yes.md"]),
    ('<a href="[x](no.md)"> [b](yes.md)', ["yes.md"]),
    ("> ```\n> [a](no.md)\n> ```\n> [b](yes.md)", ["yes.md"]),
    ("> [a](x.md)\nlazy [b](y.md)", ["x.md", "y.md"]),
    ("> > [a](x.md)\n\n    [no](no.md)", ["x.md"]),
    ("[a [b](in.md) c](out.md)", ["in.md"]),
    ("[![b](img.png) c](out.md)", ["out.md"]),
    ("[a`](no.md)`](yes.md)", ["yes.md"]),
    ('[a](x.md "t") [b](<y z.md>)', ["x.md", "y z.md"]),
    ("# [h](x.md)\n[p](y.md)", ["x.md", "y.md"]),
    ("[foo]\n\n[foo]: /u", ["/u"]),
    ("[foo][]\n\n[FOO]: /u", ["/u"]),
    ("[foo][bar]\n\n[foo]: /u", []),
    ("[foo][bar][baz]\n\n[baz]: /u", ["/u"]),
    ("- a\n\n      [c](no.md)\n  [d](yes.md)", ["yes.md"]),
    ("[x\n\ny](no.md) <https://e.org/[a](no.md)>", []),
    ("[a](b(c)d.md) \\[e](no.md) [f](\\(g.md)", ["b(c)d.md", "(g.md"]),
]


@pytest.mark.parametrize("text, want", PLAIN)
def test_plain_links(text, want):
    assert scan(text)[1] == want


def test_wikilinks_and_code():
    assert scan("<div>\n[[in html]]\n</div>")[0] == ["in html"]
    assert scan("`[[no]]` ``[[no]] ` `` [[a|b]] [[c]](d.md)") == (["a", "c"], [])
    assert scan("> ~~~\n> [[no]]\n\n[[yes]]")[0] == ["yes"]


@pytest.mark.parametrize("unit", ["[x\n", "`a` [[b]]\n", "[", "[x](", "<!-- ", "> [x\n", "[x][y]\n", "`` ` ", "[[", "]](", "<div>\n"])
def test_a_megabyte_takes_seconds_at_most(unit):
    half, whole = unit * (500_000 // len(unit)), unit * (1_000_000 // len(unit))
    took = []
    for text in (half, whole):
        began = time.process_time()
        scan(text)
        took.append(time.process_time() - began)
    assert took[1] < 6 and took[1] < 4 * took[0] + 0.3
