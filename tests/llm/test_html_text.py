"""Main text of pages: the given pages by their markup, small pages by hand."""
import html
import re

import pytest

from sessionloom.llm.html_text import extract, main_text, page_lines


def test_given_pages(session):
    pages = session.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    for p in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", p["html"], re.S).group(1)
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inside))
        r = got[p["page_id"]]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


LONG = "A paragraph long enough to raise the window sums above the threshold of the text surge."


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain &lt;text&gt; &amp; more", "plain <text> & more"), ("<p>short", "short"),
    (f"<div class='menu'><a href=x>Home</a></div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div id=comments><p>{LONG}</p></div>", f"{LONG} Short one. {LONG}"),
    ("<nav>never closed<article><p>Text</p></article><p>after", "Text"),
    ("<article><h1>T</h1><p>a<b>b</b>c<br>d &nbsp; e</p><aside>x</aside><div class='share-buttons'>y</div><p>f.</p></article><footer>g</footer>", "T abc d e f."),
    ("<article><p>body</p><div class=ad>buy<div>more</div>now</div><p>end</p></article><article class='comment'><p>long comment here</p></article>", "body end"),
    ("<script>if(a<b){'</p>'}</script><style>p{}</style><!-- no --><p>yes</p><form><p>no</p></form>", "yes"),
    ("<article><p>cut off <a hre", "cut off"), ("<ul><li><a href=1>one link</a></li></ul>", ""), ("<main><p>m</p></main><header>h</header>", "m"),
])
def test_small_pages(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page, want", [
    ("<head><title>t</title><meta charset=x><body><p>body</p>", "body"), ("<head><title>t</title><p>flow</p>", "flow"), ("<head><style>p{}</style>bare", "bare"),
    ("<head><title>t</title><script>x</script></head><p>after</p>", "after"), ("<head><title>never closed<body><p>b</p>", "b"), ("<header>no</header><p>yes</p>", "yes"),
    ("<article><p>a</p><svg viewBox='0' /><p>b</p><iframe src=x /><p>c</p></article>", "a b c"),
    *[(f"<article><p>a</p><{n} x=1><p>b</p></article>", "a b") for n in "noscript template svg math iframe object canvas title textarea select button".split()],
    ("<article><p>a</p><button>x<p>b</p><button>no</button><p>c</p></article>", "a x b c"), ("<article><svg><svg>no</svg>no</svg><p>a</p></article>", "a"),
    ("<article><p>a</p><script>never closed<p>b</p></article>", "a"), ("<article><p>a</p><script src='x'/><p>b</p><script>no</script></article>", "a b"),
    ("<main><p>before</p><article><p>inside</p></article><p>after</p></main><p>out</p>", "before inside after"),
    ("<main><p>before</p><article><p>the longer one</p></article><article><p>short</p></article></main>", "before the longer one"),
])
def test_unclosed_elements(page, want):
    assert main_text(page) == want


def test_lines_know_their_links():
    (text, aside, article, linked), = page_lines("<p>go <a href=x>there</a></p>")
    assert text == "go there" and not aside and not article and 0.6 < linked < 0.65


def test_awkward_rows(session):
    rows = [(1, "u", None, 1), (2, None, "", 2), (2, None, "", 2), (None, "u", "<p>" + "word " * 50_000, 3), (4, "u", "<" * 5000, 4), (5, "u", "<div " * 3000, 5)]
    df = session.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract(df).collect()
    assert len(got) == 6 and [r["n_chars"] for r in got if r["page_id"] is None] == [249_999]
    assert extract(df.limit(0)).count() == 0
