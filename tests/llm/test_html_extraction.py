"""Main text of pages: the block reader, the chain, and accuracy on pages not learnt from."""

import html
import itertools
import math
import random
from html.parser import HTMLParser

import pandas as pd
import pytest

from headroom.llm import catalog, maintext, pageblocks
from tests.llm.samples import SF

SCHEMA = "page_id long, url string, html string, text string, n_chars string, label int"


def texts(page):
    return [b.text for b in pageblocks.blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("just text", ["just text"]),
        ("<p>a<p>b<br>c</p></p>d", ["a", "b c", "d"]),
        ("<p><b>bo</b>ld &amp; &#233;&eacute; &lt;p&gt;</p>", ["bold & éé <p>"]),
        ("<ul><li>one<li>two <ul><li>in</ul> rest</ul>", ["one", "two", "in", "rest"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("x<script>var t='</p><p>';</script>y<style>p{}</style><!-- <p>no --><SCRIPT src=a></SCRIPT >z", ["xyz"]),
        ("<p title='a > b' class=\"x\">t</p><div data-x=\"<\">u</div>", ["t", "u"]),
        ("a < b <3 c <p>d<", ["a < b <3 c", "d<"]),
        ("<div>  \n\t one\xa0 two 　three </div><!-- open", ["one two three"]),
        ("<svg><title>no</title></svg><textarea>no</textarea><button>no</button><p>yes", ["yes"]),
        ("</div></p><p>ok</article>", ["ok"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    page = '<body><div id="mainBody" class="post-content wide"><p>one <a href=x>two</a></p></div><p hidden>h</p>'
    first, hidden = pageblocks.blocks(page)
    assert first.path == (("body", ()), ("div", ("main", "body", "post", "content", "wide")), ("p", ()))
    assert (first.linked, len(first.text)) == (3, 7)
    assert hidden.path[-1] == ("p", ("hidden",))


@pytest.mark.parametrize("piece", ['<a "', "<p ", "<a href='", "<!-", "<script", "</", "<li>", "&amp", "<b>", "<div class="])
def test_odd_input_takes_time_in_proportion(piece):
    assert isinstance(texts(piece * 20_000), list)


def test_chain_equals_every_labelling():
    made = random.Random(3)
    for _ in range(50):
        n = made.randint(1, 6)
        scores, t = [made.gauss(0, 2) for _ in range(n)], [[made.gauss(0, 1) for _ in "01"] for _ in "01"]

        def weight(labels):
            return sum(s for s, y in zip(scores, labels) if y) + sum(t[a][b] for a, b in zip(labels, labels[1:]))

        every = {labels: weight(labels) for labels in itertools.product((0, 1), repeat=n)}
        total = sum(map(math.exp, every.values()))
        assert tuple(maintext.best_labels(scores, t)) == max(every, key=every.get)
        chance, pairs = maintext.marginals(scores, t)
        for i in range(n):
            assert chance[i] == pytest.approx(sum(math.exp(w) for y, w in every.items() if y[i]) / total)
        both = sum(math.exp(w) * sum(a == b == 1 for a, b in zip(y, y[1:])) for y, w in every.items()) / total
        assert pairs[1][1] == pytest.approx(both)
    assert maintext.best_labels([], [[0.0, 0.0], [0.0, 0.0]]) == []


class Article(HTMLParser):
    """Paragraphs and headings inside ``article``, read by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.found = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.found.append("") if tag in ("p", "h1", "article") else self.handle_data(" ") if tag == "br" else None

    def handle_endtag(self, tag):
        self.found.append("") if tag in ("p", "h1", "article") else None
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


def plain(page):
    reader = Article()
    reader.feed(page)
    reader.close()
    return "\n".join(filter(None, (" ".join(t.split()) for t in reader.found)))


@pytest.fixture(scope="module")
def pages():
    return pd.read_parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")


def test_query_extracts_the_articles(spark, pages):
    got = catalog.op13_html_extraction(spark, SF.replace("0.001", "0.01"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r["page_id"]: r for r in got.collect()}
    assert len(found) == len(pages)
    for page_id, url, page in pages[["page_id", "url", "html"]].itertuples(index=False):
        assert found[page_id]["text"] == plain(page)
        assert (found[page_id]["url"], found[page_id]["n_chars"]) == (url, len(plain(page)))


def test_accuracy_on_other_markup(pages):
    weights = maintext.fit(maintext.labelled(list(pages["html"][:120]), maintext.LAYOUTS))
    t = weights[-4:].reshape(2, 2).tolist()
    right = total = 0
    for blocks, labels in maintext.labelled(list(pages["html"][120:240]), 200, seed=9):
        scores = [sum(weights[maintext._place(f)] for f in maintext.path_features(b.path) + maintext.text_features(b.text, b.linked)) for b in blocks]
        right += sum(a == b for a, b in zip(maintext.best_labels(scores, t), labels))
        total += len(labels)
    assert right / total > 0.99


HAND = """<html><body class="home"><div id="top-nav"><a href=/>Home</a> | <a href=/n>News</a></div>
<div class="cookie-banner">We use cookies to improve this site and for analytics. <button>OK</button></div>
<div class="wrap"><div class="post-content"><h1>A title</h1><p>First paragraph of the story, long enough to be prose.</p>
<div class="advertisement">Buy now, the best offer of the year, only today.</div>
<p>Second paragraph &mdash; with <a href=/x>a link</a> inside, and more words after it.</p></div>
<div class="sidebar"><h3>More</h3><p>Another story that you may like to read some day.</p></div>
<div id="comments"><div class="comment"><p>I liked this story very much, thanks for writing it all down.</p></div></div></div>
<div class="newsletter-signup"><p>Get our letter every week.</p><form><input></form></div><div id="footer">&copy; 2020 Us</div></body></html>"""


def test_a_page_without_marked_article(pages):
    weights = maintext.fit(maintext.labelled(list(pages["html"][:120]), maintext.LAYOUTS))
    t = weights[-4:].reshape(2, 2).tolist()
    blocks = pageblocks.blocks(HAND)
    scores = [sum(weights[maintext._place(f)] for f in maintext.path_features(b.path) + maintext.text_features(b.text, b.linked)) for b in blocks]
    kept = [b.text for b, y in zip(blocks, maintext.best_labels(scores, t)) if y]
    assert kept == ["A title", "First paragraph of the story, long enough to be prose.", "Second paragraph — with a link inside, and more words after it."]


def test_awkward_pages(spark, pages):
    long = "<body><article>" + "".join(f"<p>{i} words of a very long article go on and on.</p>" for i in range(60_000)) + "</article></body>"
    rows = [(1, "u", None, "mine", "x", 1), (2, None, "", None, None, None), (None, "u", "<p>", None, None, None), (4, "l", long, None, None, None), (4, "l", long, None, None, None)]
    df = spark.createDataFrame(rows + [(10 + i, f"u{i}", p, None, None, None) for i, p in enumerate(pages["html"][:50])], SCHEMA)
    got = maintext.extract(df, maintext.train(df)).where("page_id is null or page_id < 10").collect()
    assert sorted(((r["page_id"], r["url"], r["text"] and html.unescape(r["text"])[:7], r["n_chars"]) for r in got), key=repr) == sorted(
        [(1, "u", "", 0), (2, None, "", 0), (None, "u", "", 0), *[(4, "l", "0 words", len(plain(long)))] * 2], key=repr
    )


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert maintext.extract(none, maintext.train(none)).count() == 0
    bare = spark.createDataFrame([(1, "u", "<p>Only this page, which marks nothing at all.</p>", None, None, None)], SCHEMA)
    assert maintext.extract(bare, maintext.train(bare)).first()["page_id"] == 1
