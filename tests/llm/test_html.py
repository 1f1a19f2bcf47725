from html.parser import HTMLParser

import pytest
from parley.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy now, this is a long advert with words</div><%s><h1>The  title &amp; more</h1><p>First <b>bo</b>ld
 paragraph&nbsp;here.<br>Next line<p>Second &lt;tag&gt; &#233;<!-- hidden <p>no</p> --><div class="ad-box">An advert in the middle of it all, with quite a few words to read</div>
<ul><li>item one<li>item two</ul><form><input><button>Send</button></form><p>Third and last paragraph.</p></%s>
<aside>Side</aside><div id="comments"><h2>Comments</h2><p>Reader says hi to everyone</p></div><footer>&copy; me</footer></body></html>"""
WANT = "The title & more\n\nFirst bold paragraph here. Next line\n\nSecond <tag> é\n\nitem one\n\nitem two\n\nThird and last paragraph."
WEIGHTS = html_text.weights_from(dict(html_text.label_counts(PAGE % ("article", "article"))))


@pytest.mark.parametrize("mark", ["article", "main", "div", "section"])
def test_main_text(mark):
    assert html_text.main_text(PAGE % (mark, mark), WEIGHTS) == WANT


def test_odd_pages():
    for page, want in ((None, ""), ("", ""), ("<p>", ""), ("just words", "just words"), ("<p>a < b and c</p>", "a < b and c"), ("<p title='x>y'>quoted</p>", "quoted"),
                       ("<script>never closed", ""), ("<div><p>open", "open"), ("<p>one</p></div></p><p>two", "one\n\ntwo")):
        assert html_text.main_text(page, WEIGHTS) == want, page


def test_best_stretch_against_all_stretches():
    import random

    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_stretch(scores)
        every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0, *every])


class Article(HTMLParser):
    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_given_pages_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        parser = Article()
        parser.feed(row["html"].replace("<br>", " "))
        want = "\n\n".join(b for b in (" ".join(x.split()) for x in parser.blocks) if b)
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want)
    assert len(got) == pages.count()


def test_null_rows_and_empty_table(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x y z</p>"), (1, None, None)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert got == [(0, "u", "x y z", 5), (1, "", "", 0), (1, "", "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_a_teaser_does_not_hide_the_story():
    story = "".join(f"<p>{' '.join(f'story{k}x{i}' for i in range(30))}</p>" for k in range(5))
    for mark in ("article", "main"):
        page = f"<html><body><nav><a>Home</a></nav><div>{story}</div><ul><li><a>x</a></li></ul><{mark}><h2>Teaser</h2><p>Read more</p></{mark}></body></html>"
        got = html_text.main_text(page, WEIGHTS)
        assert all(f"story{k}x{i}" in got for k in range(5) for i in range(30))


STORY = "".join(f"<p>{' '.join(f'story{k}x{i}' for i in range(30))}</p>" for k in range(5))


@pytest.mark.parametrize("wrapper", ['div class="layout-with-sidebar"', 'div class="row sidebar-right"', 'div id="social-science"', "form", 'form id="search-form"'])
@pytest.mark.parametrize("mark", ["article", "div"])
def test_wrappers_are_not_left_out_for_their_names(wrapper, mark):
    side = '<div class="sidebar">small side box</div><form><button>Go</button>Your mail</form>'
    page = f"<html><body><{wrapper}><nav><a>Home</a></nav>{side}<{mark}>{STORY}</{mark}>{side}</{wrapper.split()[0]}></body></html>"
    got = html_text.main_text(page, WEIGHTS)
    assert all(f"story{k}x{i}" in got for k in range(5) for i in range(30)) and "side" not in got and "mail" not in got


def test_sections_of_an_article_are_kept():
    extra = " ".join(f"more{i}" for i in range(40))
    for label in ('id="discussion"', 'class="legal"'):
        page = f'<html><body><article>{STORY}<section {label}><h2>Part</h2><p>{extra}</p></section><div class="share">Share this</div><p>The end.</p></article></body></html>'
        got = html_text.main_text(page, WEIGHTS)
        assert extra in got and "The end." in got and "Share this" not in got


GIVEN = html_text.weights_from({("word:plain", True): 900, ("word:plain", False): 300, ("word:link", False): 200, ("tag:p", True): 60, ("tag:p", False): 20, ("tag:li", False): 90, ("tag:a", False): 90, ("tag:ul", False): 30})


@pytest.mark.parametrize("weights", [WEIGHTS, GIVEN])
@pytest.mark.parametrize("mark", ["article", "div"])
def test_nothing_of_an_article_is_lost(weights, mark):
    rows = "".join(f"<tr><td>name{i}</td><td>{i}</td></tr>" for i in range(30))
    links = "".join(f'<li><a href="/{i}">link{i}</a></li>' for i in range(60))
    end = "A closing sentence that says what the table means, with words enough."
    remarks = '<div class="user-remarks">' + "<p>Nice</p><b>one</b>" * 30 + '</div><section id="kommentare">' + "<p>Sehr gut</p>" * 30 + "</section>"
    page = f"<html><body><nav><a>Home</a></nav><{mark}><h2>Head</h2>{STORY}<table>{rows}</table><p>{end}</p><ul>{links}</ul><p title=don't>After <i>the</i> list there are more words to read.</p>{remarks}<p>Short.</p></{mark}><footer>x</footer></body></html>"
    blocks = html_text.main_text(page, weights).split("\n\n")
    story = [" ".join(f"story{k}x{i}" for i in range(30)) for k in range(5)]
    assert blocks == ["Head", *story, *[f"name{i} {i}" for i in range(30)], end, *[f"link{i}" for i in range(60)], "After the list there are more words to read.", "Short."]


@pytest.mark.parametrize("part", ["<div>", "<a ", "</x>", "<b></i>", "<p title=\"", "<a b=\">\" ", "<!", "<!--", "<b><hr>", "<p ='", "<form><p class=ad>", "<li>w", "<tr><td>w"])
def test_hostile_pages_are_read_in_linear_time(part):
    import time

    page = part * (1_000_000 // len(part))
    start = time.process_time()
    html_text.main_text(page, WEIGHTS)
    html_text.main_text("<b>" * 100_000 + page[:500_000], WEIGHTS)
    assert time.process_time() - start < 30


def test_tags_end_where_their_values_say():
    for page, want in (("<p a='x>y' b=\"<b>\" c=it's>one</p>", "one"), ("<p a=\"never closed>two</p> <p>three</p>", "two\n\nthree"), ("<!--> four <!-- x -->", "four"),
                       ("five <!-- open", "five"), ("a <b six", "a <b six"), ("<p/class='ad'>seven", ""), ("<p data-class='ad'>eight", "eight"), ("<p title='class=ad'>nine", "nine")):
        assert html_text.main_text(page, WEIGHTS) == want, page


def test_names_are_learned_from_labelled_pages(spark):
    box = '<div class="zzbox">' + "spam words here " * 5 + "</div>"
    marked = [(i, "u", f'<body><div class="outer"><article><p class="lead">{STORY}</p></article></div>{box}</body>') for i in range(20)]
    pages = spark.createDataFrame([*marked, (99, "u", f'<body><div class="outer"><div>{STORY}</div>{box}<p class="lead">last words</p></div></body>')], "page_id long, url string, html string")
    weights = html_text.learn_weights(pages)
    assert weights["name:zzbox"] <= html_text.OTHER and "name:outer" not in weights and "name:lead" not in weights
    texts = [r["text"] for r in html_text.extract(pages).collect()]
    assert all("story4x29" in t and "spam" not in t for t in texts) and sum("last words" in t for t in texts) == 1
