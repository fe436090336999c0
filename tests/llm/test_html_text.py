import random

import pytest

from tidemill.llm.html_text import extract_text, main_text

LONG = "This is the story of a man who went to the market and came back with all that he had and more than he was able to carry."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        (f"<article><h1>A title</h1><p>{LONG}</p><p>Short.</p></article>", f"A title {LONG} Short."),
        (f"<nav><ul><li><a href='/'>Home</a></ul></nav><article><p>{LONG}</article><footer>&copy; me</footer>", LONG),
        (f"<div class='ad'>{LONG}</div><main><p>{LONG}</p></main><div id='comments'><p>{LONG}</p></div>", LONG),
        (f"<article><header><h1>Of it</h1></header><p>{LONG}</p><aside>{LONG}</aside></article>", f"Of it {LONG}"),
        (f"<body><p>{LONG}<p>And so.<p>{LONG}<div class='cookie-notice'>We use the cookies of the web and all that is in them for you.</div>", f"{LONG} And so. {LONG}"),
        (f"<article><p>a &lt;b&gt; &amp;amp; caf&eacute; &#x41;&#66;\n\t x <b>y</b>z<br>w</p><p>{LONG}", f"a <b> &amp; café AB x yz w {LONG}"),
        (f"<script>var p='<p>{LONG}</p>'</script><style>p{{}}</style><!-- <p>{LONG}</p> --><article><p>{LONG}", LONG),
        ("<article><p>Tiny.</article>", "Tiny."),
        (f"<article><p>{LONG}</p><p><a href='x'>{LONG}</a></p></article>", LONG),
        (f"<form><p>{LONG}</p><input value='q'></form><article><p>{LONG}</p></article><p>Terms</p>", LONG),
        (f"<article><p>{LONG}</p><div class=share>Share this with all of the people that you know and who are of the opinion</div><p>End", f"{LONG} End"),
        (f"<head><title>{LONG}</title><body><article><p title='a > b'>{LONG}</p", LONG),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body class='overflow-hidden'><article><p>{LONG}</article>", LONG),
        (f"<div style='overflow:hidden'><article><p>{LONG}</article></div>", LONG),
        (f"<article data-hidden='0' data-state=hidden><p>{LONG}</article>", LONG),
        (f"<article><div class='visually-hidden-off' title='the hidden door'><p>{LONG}</div></article>", LONG),
        (f"<article><div data-id='comments' aria-hidden='false'><p>{LONG}</div></article>", LONG),
        (f"<article><ul><li>(a) {LONG}<li>(b) {LONG}<li>(c) {LONG}</ul></article>", f"(a) {LONG} (b) {LONG} (c) {LONG}"),
        (f"<article><section id='related-work'><p>{LONG}</section><section class='search-methods x'><p>{LONG}</section></article>", f"{LONG} {LONG}"),
    ],
)
def test_names_that_only_hold_such_words_keep_their_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN", "hidden=''", "hidden=hidden", "aria-hidden='true'", "style='color:red; display : none'", "style=display:none", "class='x hidden'"])
def test_hidden_parts_go(attribute):
    assert main_text(f"<article><p>{LONG}</p><div {attribute}><p>Hidden {LONG}</div></article>") == LONG


def test_copyright_notices_go():
    for notice in ("(c) 2020 by the owner of it", "(c) Copyright the owner of it", "© the owner of it", "&copy; 2020"):
        assert main_text(f"<article><p>{LONG}</p><p>{notice}</p><p>{LONG}</article>") == f"{LONG} {LONG}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # marks on blocks that are no containers
        (f"<article><p>{LONG}</p><p class='advert'>{LONG}</p><p>End", f"{LONG} End"),
        (f"<article><p>{LONG}<p class=advert>{LONG}<p>End", f"{LONG} End"),
        (f"<article><ul><li>{LONG}<li class='comment'><p>{LONG}</p><b>x</b><li>End</ul>", f"{LONG} End"),
        (f"<article><ul><li>{LONG}<li class='comment'>a<ul><li>b<li>c</ul>d</li><li>End</ul>", f"{LONG} End"),
        (f"<article><table><tr><td class='sponsored'>{LONG}<td>{LONG}<tr class='ad'><td>x<tr><td>End</table>", f"{LONG} End"),
        (f"<article><h2 class='share'>Share it<h2>A title</h2><p>{LONG}", f"A title {LONG}"),
        (f"<article><p>{LONG}</p><p hidden>{LONG}</p><h3 style='display:none'>x</h3><p>End", f"{LONG} End"),
        # hidden elements inside a block
        (f"<article><p>Start <span hidden>not <span>this</span> and</span>that. {LONG}", f"Start that. {LONG}"),
        (f"<article><p>Start <span style='display: none'>never closed<p>{LONG}", f"Start {LONG}"),
        (f"<article><p>{LONG} <span class='overflow-hidden' aria-hidden='true'>seen</span><img hidden> too", f"{LONG} seen too"),
        # names of several words
        (f"<div class='share-price'><p>{LONG}</div><div id='tags-of-the-world'><p>{LONG}</div>", f"{LONG} {LONG}"),
        (f"<div class='site-footer'><p>{LONG}</div><div class='adBox x'><p>{LONG}</div><div id='related-articles'><p>{LONG}</div><p>{LONG} End", f"{LONG} End"),
        # each run of text between tags is decoded by itself
        (f"<article><p>{LONG} &am<b>p;lt;</b> &lt<i>;</i> &amp;lt; a&am<!-- -->p;", f"{LONG} &amp;lt; <; &lt; a&amp;"),
    ],
)
def test_marks_on_any_block(page, text):
    assert main_text(page) == text


OTHER = {
    "russian": ["Заголовок статьи", "Вчера вечером большая группа учёных представила новые результаты исследования подземных рек северного края.", "Коротко.", "Работа продолжалась почти десять лет, и теперь карта этих рек впервые нанесена полностью."],
    "chinese": ["标题", "昨天晚上一大批科学家展示了关于北方地区地下河流研究的最新成果并且公布了全部的测量数据。", "他们的工作持续了将近十年现在这些河流的地图第一次被完整地绘制出来供所有人查看和使用。"],
    "polish": ["Nowa mapa", "Wczoraj wieczorem duża grupa naukowców przedstawiła wyniki badań podziemnych rzek północnego regionu kraju.", "Prace trwały prawie dziesięć lat, teraz mapa tych rzek została pierwszy raz ukończona."],
    "english": ["Underground rivers", "Scientists presented new measurements describing underground rivers throughout northern regions yesterday evening.", "Maps showing every river were finished after nearly ten years."],
}


@pytest.mark.parametrize("language", OTHER)
@pytest.mark.parametrize("around", ["<div id=content>{}</div>", "<body><div><section>{}</section></div>", "<article>{}</article>"])
def test_plain_pages_in_any_language_keep_every_paragraph(language, around):
    title, *texts = OTHER[language]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{t}</p>" for t in texts)
    menu = "<nav><ul><li><a href=/>Home</a></ul></nav><div class=menu><a href=/a>One</a> <a href=/b>Two</a></div>"
    footer = f"<footer>{texts[0]}</footer><div class='cookie-notice'>{texts[0]}</div>"
    assert main_text(menu + around.format(body) + footer) == " ".join([title, *texts])


@pytest.mark.parametrize("language", OTHER)
def test_a_teaser_card_does_not_hide_the_page(language):
    title, *texts = OTHER[language]
    page = f"<div id=content><h1>{title}</h1>" + "".join(f"<p>{t}</p>" for t in texts) + f"</div><article class=card><h3>More</h3><p>{texts[-1][:40]}</p></article>"
    assert main_text(page) == " ".join([title, *texts])
    assert main_text(f"<div><p>{LONG}</div><article><p>{LONG}</p><p>{LONG}</article>") == f"{LONG} {LONG}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{LONG}<section id='search'><h2>Binary search</h2><p>{LONG}</section></article>", f"{LONG} Binary search {LONG}"),
        (f"<article><section class='social'><p>{LONG}</section><form id=search><p>{LONG}</form></article>", LONG),
        (f"<article><p>{LONG}<div class='tags'><a href=1>one</a> <a href=2>two</a></div></article>", LONG),
        (f"<article><div class='hidden md:block'><p>{LONG}</div><div class='hidden x'><p>Not {LONG}</div></article>", LONG),
        (f"<article><p>{LONG}<p>(c) 1999 was the year in which {LONG}<p>© is the sign that {LONG}</article>", f"{LONG} (c) 1999 was the year in which {LONG} © is the sign that {LONG}"),
        (f"<article><p>{LONG}<p>(c) 1999 by the owner of the site and of all that is shown on it, all rights reserved in all of the world</article>", LONG),
    ],
)
def test_marks_that_an_article_may_be_about(page, text):
    assert main_text(page) == text


WORDS = "the of and to in that is was for on with as his they this have from or one had by word but not what all were we when your can said there use".split()
NOISE = [
    "<nav><ul><li><a href='/{0}'>{0}</a><li>{0}</ul></nav>",
    "<div class='{1}'><p>{2}</p>{2}</div>",
    "<aside><h2>{0}</h2><p>{2}</aside>",
    "<form action='/{0}'><label>{2}</label><input name='{0}'><button>{0}</button></form>",
    "<script>if (a < b) document.write('<p>{2}</p>')</script>",
    "<style>p {{ content: '{0}' }}</style>",
    "<!-- <p>{2}</p> -->",
    "<p class={1}>{2}</p>",
    "<ul><li class='comment {0}'><p>{2}</p><li class='comment'>{2}</ul>",
    "<section id={1}><h3>{0}</h3><table><tr><td>{2}</table></section>",
    "<p hidden>{2}</p>",
    "<div style='x:y;display:none'><div><p>{2}</p></div></div>",
    "<noscript>{2}</noscript>",
]


def written(rng, text):
    """One of the ways to write a text inside a block."""
    out = []
    for w in text.split(" "):
        kind = rng.random()
        if kind < 0.08:
            tag = rng.choice(["b", "i", "em", "span"])
            w = f"<{tag} class=ad-free>{w}</{tag}>"
        elif kind < 0.14:
            w = "".join(f"&#{ord(c)};" if rng.random() < 0.5 else f"&#x{ord(c):x};" for c in w)
        elif kind < 0.18:
            w = f"{w}<!-- {w} -->"
        elif kind < 0.2:
            w = f"{w}<span hidden>{rng.choice(WORDS)}</span>"
        out.append(w + rng.choice([" ", " ", "\n\t", "&#32;", "<br>"]))
    return "".join(out)


def test_pages_made_of_known_text_and_noise():
    rng = random.Random(21)
    sentence = lambda n: (" ".join(rng.choices(WORDS, k=n)) + ".").capitalize()
    for _ in range(400):
        noise = lambda: rng.choice(NOISE).format(rng.choice(WORDS), rng.choice(["ad", "share", "sidebar", "newsletter", "cookie", "related"]), sentence(30)) if rng.random() < 0.5 else ""
        blocks = [sentence(rng.choice([1, 3, 8])) if k and rng.random() < 0.3 else sentence(rng.randint(20, 60)) for k in range(rng.randint(1, 12))]
        body = ""
        for text in blocks:
            tag = rng.choice(["p", "p", "h2", "blockquote", "div", "section class='share-price'", "li"])
            body += f"<{tag}>{written(rng, text)}</{tag.split()[0]}>" + noise()
        name = rng.choice(["article", "main", "article class='overflow-hidden post'"])
        page = f"<!doctype html><html><head><title>{sentence(5)}</title></head><body class='page overflow-hidden'>{noise()}<header><h1>{sentence(3)}</h1></header>{noise()}<{name}>{body}</{name.split()[0]}>{noise()}<footer>{sentence(30)}</footer></body></html>"
        assert main_text(page) == " ".join(blocks), page


def test_broken_markup_ends_with_the_page():
    for page in ("<", "<a", "<p class='x", "<!--", "<script>", "</", "<article><p>x</div></p></nav></article></article>", "a < b", "<p" * 2000, "<div>" * 3000 + LONG):
        main_text(page)
    assert main_text(f"<article><p>{LONG}<p class='unclosed>{LONG}") != ""


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}", "clash"), (1, "u", f"<article><p>{LONG}", "clash"), (2, None, None, "clash"), (3, "v", "<p>" + "🙂 " * 100_000, "clash")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.n_chars) for r in got[:3]] == [(1, len(LONG)), (1, len(LONG)), (2, 0)]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
