import random

import pytest

from siftwell.llm.html_text import extracted, main_text

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body><nav><ul><li><a href="/a">Menu,
entry.</a></li></ul></nav><!-- ad --><div class="ad">Buy now, cheap.</div><article><h1>Head &amp; line</h1><p><b>First  part,
with words.<br><p>Second &mdash; part.</p><p>Sh.</p></article><footer>&copy; somebody, and so on.</footer>"""

WIDE = """<html><body class="has-sidebar"><header class="site-header"><h1>My Site</h1><p>Welcome to the best site, ever.</p></header><div id="menu"><a href=x>Home</a> <a href=y>About us</a></div>
<div class="cookie-notice">We use cookies, to make it better. Please accept them.</div>
<div class="wrap"><div class="post-content"><h2>Title &#38; more</h2><p>First paragraph, with text. It is long enough, really.</p><p>Short.</p><ul><li>One item</li><li>Two <b>bo</b>ld</li></ul><blockquote>Quote, here.</blockquote>
<div class="share"><a>Tweet</a></div><form><p>Enter mail, now.</p></form></div><div class="sidebar"><p>Related stuff, blah, blah blah blah.</p></div></div>
<section id="comments"><article class="comment"><p>Nice article, thanks! I really loved it, and so on, and on.</p></article></section><footer>Copyright, us.</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Head & line\nFirst part, with words.\nSecond — part.\nSh."


def test_page_without_article_element():
    assert main_text(WIDE) == "Title & more\nFirst paragraph, with text. It is long enough, really.\nShort.\nOne item\nTwo bold\nQuote, here."


@pytest.mark.parametrize(("html", "text"), [("", ""), ("plain &lt;b&gt;", "plain <b>"), ("<nav>only a menu</nav>", ""), ("<p>a<p>b", "a\nb"), ("<p>x <![if y", "x"), ("<main><header><h1>H</h1><p>by me</p></header><p>Body, text.</p></main>", "H\nBody, text.")])
def test_odd_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("odd", ["<![foo[ x ]]>", "<![ endif]>", "<![endif]>", "<![if IE>", "<![]>", "<![CDATA-x[ y ]]>", "<![cdata[ y ]]>", "<![1]>"])
def test_text_after_odd_declarations(odd):
    assert main_text(f"<article><p>One, two.</p>{odd}<p>Three, four.</p><p>Five, six. {odd}</p></article><![if !x]>") == "One, two.\nThree, four.\nFive, six."


STORY = "<p>One part, with words. It goes on, and on.</p><p>Another part, with more words. It ends here, really.</p><p>Third part, short.</p>"
LINES = "One part, with words. It goes on, and on.\nAnother part, with more words. It ends here, really.\nThird part, short."
SIDE = "<div class='sidebar'><p>Other things, to read now.</p></div>"
TALK = "<div id='comments'>" + "<p>I liked it, really. So did my friends, all of them.</p>" * 6 + "</div>"


@pytest.mark.parametrize(
    "html",
    [
        f"<div class='layout has-sidebar'><article>{STORY}</article>{SIDE}</div>",
        f"<div class='layout has-sidebar'><div>{STORY}</div>{SIDE}</div>",
        f"<div id='content-with-comments'><main>{STORY}</main></div>",
        f"<div id='content-with-comments'><article>{STORY}</article>{TALK}</div>",
        f"<div class='no-sidebar'>{STORY}</div><p><a href='/x'>Home page</a></p>",
        f"<section class='widget-area post'>{STORY}</section>{SIDE}",
        f"<section class='widget-area post'>{STORY}</section>{TALK}",
        f"<div class='fixed-header'><div class='page with-menu'><div class='widget'>{STORY}</div></div></div>",
        f"<main><div class='promo-layout'>{STORY}</div></main>",
        f"<article class='post ad-free'>{STORY}</article>",
        f"<div class='widgets'>{STORY}</div><div class='related'><article><p>Card, short.</p></article></div>",
        f"<div class='menu'><ul><li><a href='/a'>{'Menu entry, long. ' * 30}</a></li></ul></div><div class='menu-page'>{STORY}</div>",
    ],
)
def test_wrappers_named_like_asides(html):
    assert main_text(html) == LINES


@pytest.mark.parametrize(
    "html",
    [
        f"<article>{STORY}</article><div class='related'><article><p>Card, short.</p></article></div>",
        f"<div class='has-sidebar'><article>{STORY}</article><div class='sidebar'>{'<p>Other things, to read. Many of them, really.</p>' * 9}</div></div>",
        f"<article>{STORY}</article>{TALK}",
        f"<div>{STORY}</div>{TALK}",
        f"<main>{STORY}{SIDE}</main>",
    ],
)
def test_asides_stay_out(html):
    assert main_text(html) == LINES


def test_rows(spark):
    rows = [(1, "u", PAGE, "old"), (2, None, None, None), (3, "w", "", "x"), (1, "u", PAGE, "old"), (4, "v", "<article>" + "<p>word, word.</p>" * 20000 + "</article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extracted(pages).select("page_id", "url", "text").collect()
    assert sorted((r.page_id, len(r.text)) for r in found) == [(1, len(main_text(PAGE)))] * 2 + [(2, 0), (3, 0), (4, 20000 * 11 + 19999)]
    assert {r.text.count("\n") for r in found if r.page_id == 4} == {19999}
    assert extracted(pages.limit(0)).collect() == []


def test_headings_words_are_no_menus():
    """An article's section about a topic isn't what its id's first word names elsewhere."""
    lead = "".join(f"<p>Sentence number {i} of the lead, long enough to be one of an article, with commas.</p>" for i in range(4))
    for own in ('section id="search-algorithms"', 'p class="related-work"', 'div id="social-history"'):
        tag = own.split()[0]
        inner = "Breadth first comes before depth first, and both come before the best of all."
        page = f"<html><body><article><h1>Title</h1>{lead}<{own}>{inner if tag == 'p' else f'<h2>Topic</h2><p>{inner}</p>'}</{tag}></article></body></html>"
        assert inner in main_text(page), own
    for own in ('div class="related-posts"', 'div class="search-box"', 'div id="share-buttons"', 'div class="related"', 'section id="search-engines"'):
        inner = "<a href=x>Another story that you may like to read, about things.</a>"
        page = f"<html><body><article><h1>Title</h1>{lead}<{own}><p>{inner}</p></{own.split()[0]}></article></body></html>"
        assert "Another story" not in main_text(page), own


def test_a_paragraph_that_is_one_link():
    lead = "".join(f"<p>Sentence number {i} of the text, long enough to be one of an article, with commas.</p>" for i in range(4))
    page = f"<body><article>{lead}<p><a href=x>The report in full</a></p>{lead}<ul><li><a href=y>Elsewhere</a></li></ul></article></body>"
    assert "The report in full" in main_text(page) and "Elsewhere" not in main_text(page)


@pytest.mark.parametrize("inner", ["<script>var x = 1; f();</script>", "<style>a{b:c}</style>", "<noscript>no <b>script</b></noscript>", "<select><option>x<option>y</select>", "<button>press <i>it</i></button>", "<iframe src=x>old</iframe>", "<span hidden>gone</span>", '<span style="color:red; display : none">gone</span>', "<i style='visibility:hidden'>gone</i>", '<span class="ad">buy this</span>', '<a class="share-link" href=x>share</a>', "<svg class='i'/>", "<svg><title/><path d='M0'/><text>drawn</text></svg>", "<math><mi>x</mi></math>", "<textarea><p>typed</textarea>", "<template><p>later</p></template>", "<!-- said -->", '<?php echo "a > b" ?>', "<datalist><option value=a>a</datalist>"])
def test_what_no_page_shows_is_left_out_within_a_paragraph(inner):
    html = f"<article><p>Words before it, {inner} and words after it.</p>{STORY}</article>"
    assert main_text(html) == f"Words before it, and words after it.\n{LINES}"
    html = f"<article><p>Words.</p>{inner}{STORY}</article>"
    assert main_text(html) == f"Words.\n{LINES}"


@pytest.mark.parametrize(
    "html",
    [
        f"<body><form id='aspnetForm' action=x><input type=hidden><div class=top><a href=/>Home</a></div><div>{STORY}</div></form>",
        f"<body><nav><ul><li><a href=x>Menu</a><li><a href=y>More of it</a></ul>{STORY}",
        f"<body><header><p>{STORY}",
        f"<html><head><title>T</title><meta charset=x><body>{STORY}",
        f"<html><head><title>T</title>{STORY}",
        f"<div>{STORY}<!-- open <p>After it",
        f'<div>{STORY}<a href="x',
        f"<div>{STORY}</div><script>document.write('<p>x</p>')",
        f"<button><div>Menu</button>{STORY}",
        f"<article>{STORY}<div class='user-feedback'>Was it of use?</div><div class='dfp-slot'>Buy it</div></article>",
    ],
)
def test_articles_that_odd_markup_holds(html):
    assert main_text(html) == LINES


def test_an_article_in_blocks_side_by_side():
    last = "The last part stands in a block of its own, far from the others."
    page = f"<div id=page><div class=a>{STORY * 6}</div><div class=b><p>{last}</p></div></div>"
    assert main_text(page) == "\n".join([LINES] * 6 + [last])


def built(rng):
    """A page and its article, told by its builder: blocks of the article among what isn't part of it."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    noise = [
        lambda: f"<script>if (a < b) {{ f('{word()}</p>'); }}</script>", lambda: f"<style>.{word()} > p {{ margin: 0 }}</style>", lambda: f"<!-- {words(3)} <p>{word()}</p> -->", lambda: f"<span hidden>{words(2)}</span>",
        lambda: f"<svg viewBox='0 0 1 1'/>", lambda: f"<select><option>{word()}</option><option selected>{word()}</select>", lambda: f"<span class='ad ad-{word()}'>{words(3)}.</span>", lambda: f"<noscript><img src=x>{words(2)}</noscript>", lambda: "<img src=x alt='not, text'>",
    ]
    apart = [
        lambda: f"<div class='advert'><p>{words(6)}, {words(6)}.</p></div>", lambda: f"<aside><p>{words(5)}.</p></aside>", lambda: f"<form><label>{words(2)}</label><input name=q><textarea><p>{word()}</textarea><button>{word()}</button></form>",
        lambda: f"<div style='display:none'><p>{words(9)}.</p></div>", lambda: f"<nav><ul>{''.join(f'<li><a href=/{word()}>{word()}</a></li>' for _ in range(4))}</ul></nav>", lambda: f"<div class='newsletter-signup'><p>{words(4)}.</p></div>",
    ]

    def inline():
        text, html = [], []
        for _ in range(rng.randint(3, 14)):
            w = words(rng.randint(1, 4)) + rng.choice([",", "", ".", ";"])
            form = rng.choice(["{}", "{}", "{}", "<b>{}</b>", "<a href='/x'>{}</a>", "<span class='note'>{}</span>", "&#x{:x};"])
            if form.startswith("&"):
                c = rng.choice([0x2014, 0xE9, 0x26, 0x3C])
                text.append(chr(c)), html.append(f"&#x{c:x};")
            else:
                text.append(w), html.append(form.format(w))
            if rng.random() < 0.15:
                html.append(rng.choice(noise)())
        end = words(3) + "."
        return " ".join([*text, end]), rng.choice([" ", "\n  ", " <br> "]).join([*html, end])

    blocks, html = [], []
    for _ in range(rng.randint(3, 12)):
        text, markup = inline()
        form = rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<pre>{}</pre>"])
        blocks.append(text), html.append(form.format(markup))
        if rng.random() < 0.4:
            html.append(rng.choice(apart + noise[:3])())
    inner = rng.choice(["", "\n"]).join(html)
    inner = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<article class='post no-sidebar'>{}</article>", "<main>{}</main>"]).format(inner)
    inner = rng.choice(["{}", "<form id='aspnetForm'>{}</form>", "<div class='wrap has-sidebar'>{}</div>", "<div class='page'><div>{}</div></div>"]).format(inner)
    head = f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style>{rng.choice(['</head>', ''])}<body>"
    foot = f"<section id='comments'><p>{words(30)}.</p><p>{words(20)}.</p></section><footer>&copy; {words(3)}, {words(2)}.</footer>{rng.choice(['</body></html>', '', '<!-- open', '<a href='])}"
    return head + f"<header><h1>{words(2)}</h1></header>" + inner + rng.choice(apart)() + foot, "\n".join(" ".join(b.split()) for b in blocks)


@pytest.mark.parametrize("seed", range(60))
def test_built_pages(seed):
    html, article = built(random.Random(seed))
    assert main_text(html) == article


def test_a_very_long_page():
    line = "Sentence after sentence, with a <script>f()</script> script in each, goes on."
    assert main_text("<body><div>" + f"<p>{line}</p>" * 60_000 + "</div>") == "\n".join(["Sentence after sentence, with a script in each, goes on."] * 60_000)
