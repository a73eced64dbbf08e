import pytest
from hypothesis import given, settings, strategies as st

from ratelab.llm.html_text import extract_text, main_text, smooth

LONG = "This is a paragraph of the article, long enough to look like running text to anybody, with commas and all. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_article_without_furniture():
    html = page(
        "<header><h1>Site</h1></header><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class='ad'>Buy now</div>"
        f"<article><h1>Title &amp; more</h1><p>{LONG}<b>bold</b> &lt;tag&gt;&nbsp;end<br>line</p><p>Short.</p>"
        "<div class='share-buttons'>Share</div><form><p>Form</p></form><p>x<!-- c -->y</p>"
        "<section class='comments'><p>First!</p></section></article>"
        "<aside><p>Side</p></aside><div id='cookie-notice'><p>We use cookies</p></div><footer><p>Foot</p></footer>"
    )
    assert main_text(html) == "\n\n".join(["Title & more", " ".join((LONG + "bold <tag> end line").split()), "Short.", "xy"])


def test_header_of_an_article_keeps_its_heading():
    assert main_text(page(f"<article><header><h1>Head</h1><p>by me</p></header><p>{LONG}</p></article>")) == "Head\n\n" + LONG.strip()


def test_unclosed_paragraphs_and_cut_off_pages():
    assert main_text(f"<body><nav><a>m</a></nav><article><h1>A</h1><p><b>B<br><p>{LONG}<p>C &eacute; &#233;") == "\n\n".join(["A", "B", LONG.strip(), "C é é"])


def test_page_without_article_is_clustered():
    links = "".join(f"<li><a href='/{i}'>l{i}</a></li>" for i in range(30))
    html = page(f"<div><ul>{links}</ul></div><div><p>{LONG * 3}</p><p>{LONG * 2}</p><p>{LONG * 3}</p></div><div><ul>{links}</ul></div>")
    text = main_text(html)
    assert text.count(LONG.strip()) == 8 and len(text.split("\n\n")) <= 9 and "l15" not in text


def test_list_of_articles_keeps_the_longest():
    assert main_text(page(f"<article><p>teaser</p></article><article><p>{LONG * 4}</p></article>")) == (LONG * 4).strip()


@pytest.mark.parametrize("html", [None, "", "   ", "<p></p>", "<html><body><nav>x</nav></body></html>", "<script>x"])
def test_nothing(html):
    assert main_text(html) == ""


def test_smoothing_keeps_a_constant():
    assert smooth(__import__("numpy").full(5, 3.0)) == pytest.approx([3.0] * 5)


def test_frame_with_nulls_clashing_names_and_long_pages(spark):
    rows = [(1, "u", f"<article><p>{LONG * 5000}</p></article>", "a", 1), (None, None, None, "b", 2), (1, "u", "<p>é😀</p>", "c", 3)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.n_chars, r.text[:3]) for r in got.collect()) == [(0, ""), (2, "é😀"), (len((LONG * 5000).strip()), "Thi")]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_against_their_own_markup(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for p in pages[:60]:
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert main_text(p.html) == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("inline", [
    "<svg><title>Icon</title></svg>", "<noscript><p>Turn on scripts</p></noscript>", "<noscript><p>Turn on scripts</noscript>",
    "<button><div>Share</div></button>", "<select><option>a<option>b</select>", "<object><p>Old</p></object>",
])
@pytest.mark.parametrize("block", ["p", "div"])
def test_text_around_hidden_inline_elements_stays(inline, block):
    html = page(f"<article><{block}>First sentence. {inline} Second.</{block}><p>{LONG}</p></article>")
    assert main_text(html) == "First sentence. Second.\n\n" + LONG.strip()


@pytest.mark.parametrize("inline", ["<span class='ad'><div>Ad</div></span>", "<a class='share'><div>Share</div></a>"])
def test_text_before_furniture_in_inline_elements_stays(inline):
    text = main_text(page(f"<article><div>{LONG}{inline}</div><p>{LONG}</p></article>"))
    assert text == "\n\n".join([LONG.strip()] * 2)


@pytest.mark.parametrize("body", [
    "<div class='content has-sidebar'><article><p>{0}</p></article></div>", "<div id='no-sidebar'><p>{0}</p><p>{0}</p></div>",
    "<div class='post comments-open'><p>{0}</p><p>{0}</p></div>", "<article class='post comments-open'><p>{0}</p></article>",
    "<div class='widget'><p>{0}</p><p>{0}</p></div>",
])
def test_class_beside_the_content_does_not_hide_it(body):
    html = page("<nav><a href='/'>Menu</a></nav>" + body.format(LONG) + "<div class='ad'>Buy now</div>")
    assert main_text(html) == "\n\n".join([LONG.strip()] * body.count("{0}"))


def test_heading_in_the_header_class_of_an_article_stays():
    html = page(f"<article><div class='entry-header'><h1>Title</h1><span>by me</span></div><p>{LONG}</p></article>")
    assert main_text(html) == "Title\n\n" + LONG.strip()


def test_teaser_card_does_not_replace_the_unmarked_text():
    html = page(f"<div class='post'><p>{LONG * 3}</p><p>{LONG * 3}</p></div><article><h2>Next</h2><p>A teaser.</p></article>")
    assert main_text(html).count(LONG.strip()) == 6


def test_long_advertisement_beside_a_short_article_is_no_text():
    assert main_text(page(f"<div class='ad'>{LONG}</div><article><h1>Title</h1><p>Short.</p></article>")) == "Title\n\nShort."


RUNNING = "long " * 109


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>One short.</p><p>Two short.</p><p>%s</p><p>Three short.</p>", "One short.\n\nTwo short.\n\n%s\n\nThree short."),
        ("<h1>Heading</h1><p>%s</p>", "Heading\n\n%s"),
        ("<h1>Heading</h1><p>%s</p><p>Last line.</p>", "Heading\n\n%s\n\nLast line."),
        ('<article>%s</article><div class="user-comments">' + "said " * 200 + "</div>", "%s"),
        ('<div class="post">%s</div><ul class="comment-list"><li>' + "said " * 200 + "</li></ul>", "%s"),
        ('<div class="comments-open"><p>%s</p></div>', "%s"),
        ("<p>a</p><![foo[ x ]]><p>b %s</p>", "a\n\nb %s"),
    ],
)
def test_unmarked_pages_headings_and_readers(html, want):
    assert main_text(html % RUNNING) == want % RUNNING.strip()


def test_both_of_two_articles_stay():
    html = f"<article>{'a' * 125}</article><article>{'b' * 126}</article>"
    assert main_text(html) == "a" * 125 + "\n\n" + "b" * 126


@pytest.mark.parametrize("html", ["<![%x", "<![ ", "<![[", "<!", "<!d", "<![CDATA[x", "<?", "</", "<a b='", "&#x110000;&#0;&", "<!--", "\x00<p\x00>"])
def test_broken_markup(html):
    for page in (html, f"<p>text</p>{html}", f"{html}<p>text</p>"):
        assert isinstance(main_text(page), str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "!", "[", "]", "-", "--", "/", "p", "b", "li", "div", "svg", " ", "x", "'", '"', "=", "&", "#", ";", "CDATA", "?", "class", "article"]), max_size=60))
def test_any_markup(parts):
    assert isinstance(main_text("".join(parts)), str)


def test_linear_time():
    """Sixteen times the tags in far less than 256 times the time."""
    import time

    for make in (lambda n: "<b>" * n + "</i>" * n, lambda n: "<i><p>" + "<b>" * n + "</i>" * n, lambda n: "<p>" + "<b>" * n + "<li>x" * n):
        took = []
        for n in (2_000, 32_000):
            start = time.process_time()
            main_text(make(n))
            took.append(time.process_time() - start)
        assert took[1] < 80 * max(took[0], 0.01)
