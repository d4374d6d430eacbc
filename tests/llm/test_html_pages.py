"""Main text of pages built from known blocks, and of hostile pages."""

import html
import random
import time

import pytest

from loomgraph.llm import html_extract

VOCABULARY = "stone river under light of the old house and a garden with five trees near München, l'été & <more> words".split()


def sentence(rng, low, high):
    return " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(low, high))) + "."


def block(rng, low=8, high=40):
    """(markup, text) of a block of the article: inline tags, references and odd white space inside."""
    text = sentence(rng, low, high)
    marked = [f"<b>{html.escape(w)}</b>" if rng.random() < 0.1 else html.escape(w) for w in text.split()]
    marked = [f'<a href="/x?a=1&b=2">{w}</a>' if rng.random() < 0.05 else w for w in marked]
    tag = rng.choice(["p", "p", "p", "blockquote", "h2", "div"])
    return f"<{tag}>" + rng.choice([" ", "\n  ", " <!-- > --> "]).join(marked) + rng.choice([f"</{tag}>", f"</{tag}>\n"]), text


def beside(rng, in_mark=False):
    """What stands beside an article. Only a bare list of links doesn't name itself; in a marked article it may be text."""
    words = html.escape(sentence(rng, 3, 30))
    links = "".join(f"<li><a href=/{i}>{html.escape(sentence(rng, 1, 3))}</a></li>" for i in range(rng.randint(3, 8)))
    return rng.choice([
        f"<nav><ul>{links}</ul></nav>", f"<header><div>{words}</div></header>", f"<footer>{words}</footer>", f"<aside><p>{words}</p></aside>",
        f'<div class="ad">{words}</div>', f'<div id="cookie-notice"><p>{words}</p><button>OK</button></div>', f"<form><label>{words}</label><input></form>",
        f'<div class="sidebar">{words}</div>', f'<section class="comments"><p>{words}</p><p>{words}</p></section>', f"<script>var a = '<p>{words}</p>';</script>",
        f"<style>p:after{{content:'{words}'}}</style>", f"<nav>{links}</nav>" if in_mark else f"<ul>{links}</ul>", f'<div role="navigation">{links}</div>', f'<div style="display: none">{words}</div>',
    ])


@pytest.mark.parametrize("wrapper", ["article", "main", "div", None])
def test_pages_of_known_blocks(wrapper):
    """Without a mark the windows alone find the range; with one, text outside it that makes no surge goes."""
    rng = random.Random(str(wrapper))
    for _ in range(150):
        blocks = [block(rng) for _ in range(rng.randint(2, 9))]
        body = []
        for markup, _ in blocks:
            body.append(markup)
            if rng.random() < 0.2:
                body.append(beside(rng, wrapper in ("article", "main")))
        inside = "".join(body)
        page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(beside(rng) for _ in range(3))
        page += f"<{wrapper}>{inside}</{wrapper}>" if wrapper else inside
        page += "".join(beside(rng) for _ in range(3)) + "</body></html>"
        assert html_extract.main_text(page) == " ".join(text for _, text in blocks), page


def test_the_windows_decide():
    """Lines that no rule on tags or names knows: those far from any surge go, with and without a mark."""
    long = "Some text stands here and goes on for a while, as text does."
    strays = "<div>Imprint</div>" + "<hr><div></div>" * 2 + "<div>Top</div>"
    menu = "<ul>" + "<li><a href=/>item</a></li>" * 4 + "</ul>"
    body = f"<p>{long}</p><p>Short.</p><p>{long}</p>"
    for page in (f"{strays}{menu}<div>{body}</div>{menu}{strays}", f"{strays}{menu}<article>{body}</article>{menu}{strays}"):
        assert html_extract.main_text(page) == f"{long} Short. {long}"
        lines = [x.text() for x in html_extract.lines_of(page) if x]
        assert "Imprint" in lines and "Top" in lines  # left out by the windows, not by a tag


@pytest.mark.parametrize("piece", ['<a "', "<!", "<!--", '<a href="', "<a x='\">", "<script>", "<script></scrip", "<svg>", "&", "<", "<div>", '<a =">" ', "<p>a", "</", "<p a=''"])
def test_hostile_pages_take_linear_time(piece):
    began = time.perf_counter()
    html_extract.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(("page", "text"), [
    ("<p>one &#x41;&#66; &amp;amp; &nbsp;two &#99999999999; &#" + "9" * 6000 + "; end</p>", "one AB &amp; two � � end"),
    ("a < b and 2 <3 c", "a < b and 2 <3 c"), ("<p>text</p><!-- never closed <p>no</p>", "text"), ("<p>text</p><a href='x", "text"),
    ("<p title='a>b'>text</p>", "text"), ("<p title=don't>text</p><p>it's</p>", "text it's"), ("<p>one<svg/>two</p>", "onetwo"),
    ("<p>text <button>press</button> on</p>", "text on"), ("<p>a<select><option>b</p>", "a b"), ("", ""), (None, ""), ("<nav>menu</nav>", ""),
    ("<SCRIPT>no</script ><P>yes", "yes"), ("<p>a<br/>b<wbr>c</p>", "a bc"),
])
def test_odd_markup(page, text):
    assert html_extract.main_text(page) == text
