import html as html_module
import re

from loomscan.llm import html_text
from loomscan.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header class="site"><a href="/">Site</a> slogan</header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div><!-- ad --><div class="ad">Buy this now, it is great.</div>
<article><h1>The &amp; title</h1><p>First <b>bold</b>
   text&nbsp;here &lt;kept&gt;.<br>Same block.</p><p>Second <a href="/x">link</a>.</p><aside>Related things to read</aside><p>Of.</p>
<form><label>Mail</label><input name="m"><button>Send</button></form></article>
<section id="comments"><p>I liked this article very much, thank you for it, said a reader.</p></section>
<aside><p>A sidebar paragraph which is fairly long and has no links at all in it.</p></aside>
<footer>&copy; 2024 site &middot; all rights</footer></body></html>"""


def test_whole_page():
    assert main_text(PAGE) == "The & title\n\nFirst bold text here <kept>. Same block.\n\nSecond link.\n\nOf."


def test_page_without_hints():
    words = "This is a sentence of a long text block without any link. " * 5
    page = f"<html><body><div><a href=/>Home</a> <a href=/n>News</a></div><div>{words}</div><div>{words}</div><div><a href=/i>Imprint</a></div></body></html>"
    assert main_text(page) == "\n\n".join([words.strip()] * 2)


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<") == main_text("<p") == main_text("<script>x") == main_text("<!-- never closed <p>x</p>") == ""
    assert main_text("<article><p>text that is cut off &am") == "text that is cut off &am"
    assert main_text("<article><p>one<p>two</article") == "one\n\ntwo"
    assert main_text('<article><p title="a > b">x < y and z</p></article>') == "x < y and z"
    assert main_text("<article><p>" + "word " * 100000 + "</p></article>").count(" ") == 99999
    assert main_text("<article><h1>H</h1><nav><p>menu</p></nav><p>t</p></article>") == "H\n\nt"


def test_tree_fits_its_table():
    rows, labels = html_text.labelled_rows()
    wrong = sum(html_text.decide(tuple(x)) != (y > 0) for x, y in zip(rows, labels, strict=True))
    assert len(rows) > 400 and wrong <= len(rows) // 50


def article_of(page):
    """Blocks of the page's article element, read off its markup."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    want = [" ".join(html_module.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n\n".join(x for x in want if x)


def share_right(change):
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    return sum(main_text(change(p)) == article_of(p) for p in pages) / len(pages)


def test_accuracy_with_hints_removed_or_misleading():
    """Whole pages right: as they are, with every hint taken away, with articles named like furniture, and menus like articles."""
    bare = [('<nav>', '<div>'), ('</nav>', '</div>'), ('<footer>', '<div>'), ('</footer>', '</div>'), (' class="ad"', ''), ('<article>', '<div>'), ('</article>', '</div>')]

    def changed(pairs):
        def change(page):
            for a, b in pairs:
                page = page.replace(a, b)
            return page

        return share_right(change)

    assert changed([]) == 1.0
    assert changed(bare) > 0.98
    assert changed([("<article>", '<div class="sidebar">'), ("</article>", "</div>")]) > 0.9
    assert changed([("<nav>", '<div class="content">'), ("</nav>", "</div>")]) > 0.98


def test_names_are_matched_whole():
    long = "A sentence of the article with several words. " * 12
    assert main_text('<article class="social-studies"><p>Article about social class.</p></article>') == "Article about social class."
    assert main_text('<article class="tags-of-life"><p>The tags of life.</p></article>') == "The tags of life."
    assert main_text(f'<div class="main-content with-sidebar"><p>{long}</p></div>') == long.strip()
    assert main_text(f'<div class="sidebar"><div class="entry-content"><p>{long}</p></div></div>') == long.strip()


def test_a_paragraph_that_is_one_link_stays():
    text = "A sentence of the article with several words. " * 6
    page = f'<nav><a href="/">Home</a></nav><article><h1>T</h1><p>{text}</p><p><a href="/x">This whole paragraph is one link to elsewhere</a></p><p>{text}</p></article>'
    assert main_text(page) == "\n\n".join(["T", text.strip(), "This whole paragraph is one link to elsewhere", text.strip()])


def test_text_before_the_first_heading_stays():
    text = "A sentence of the article with several words. " * 4
    for tag in ("article", "div"):
        page = f'<div><a href="/">Home</a></div><{tag}><p>{text}</p><p>Short.</p><h2>Part</h2><p>{text}</p></{tag}><div>Imprint of the site</div>'
        assert main_text(page) == "\n\n".join([text.strip(), "Short.", "Part", text.strip()])


def test_time_grows_with_the_page():
    """Ten megabytes of the worst markup in seconds each."""
    import time

    n = 10_000_000
    for piece in ('<a "', "<a '>'", '<a ">', "<!--", "<script>", "<", "</", "<div ", "<a href='", "&amp;"):
        began = time.time()
        main_text(piece * (n // len(piece)))
        assert time.time() - began < 10, piece
    for first, then in (("<div>", "</b>"), ("<p>", "</div>"), ("<ul><li>", "</p>")):
        began = time.time()
        main_text(first * (n // 2 // len(first)) + "x" + then * (n // 2 // len(then)))
        assert time.time() - began < 20, first


def test_scanner():
    read = lambda page: [(b.text, b.words, b.linked) for b in html_text.blocks(page)[0]]
    assert read("a<b>b</b>c <i>d") == [("abc d", 2, 0)]
    assert read('<p>x <a href="/y>z</a> w</p>') == [("x z w", 3, 1)]
    assert read("<p>one<div>two</div>three") == [("one", 1, 0), ("two", 1, 0), ("three", 1, 0)]
    assert read("<div><p>a</div>b</p>c") == [("a", 1, 0), ("b", 1, 0), ("c", 1, 0)]
    assert read("<p>a <a>b</p>c<p>d <a>e<p>f</p>") == [("a b", 2, 1), ("c", 1, 0), ("d e", 2, 1), ("f", 1, 0)]
    assert read("<a><div>a</div><div>b</div></a><div>c</div>") == [("a", 1, 1), ("b", 1, 1), ("c", 1, 0)]
    assert read("<title>t</title><textarea><p>x</p></textarea><p>y<script>'</p>'</SCRIPT >z</p>") == [("y", 1, 0), ("z", 1, 0)]
    assert read("<p hidden>a</p><p style='display: none'>b</p><div aria-hidden=true><p>c</p></div><p>d</p>") == [("d", 1, 0)]
    assert read("1 < 2 <3 &lt;p&gt; a<br>b<!-- <p>x</p> -->c") == [("1 < 2 <3 <p> a bc", 7, 0)]


def test_query_finds_articles(spark, sf_dir):
    from loomscan.llm.queries import op5_html_text

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op5_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article_of(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, PAGE, "x"), (1, PAGE, "x")], "page_id bigint, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted((str(r["page_id"]), r["text"] == "") for r in got) == [("1", False), ("1", False), ("None", True)]
    assert html_text.extract(df.limit(0)).count() == 0
