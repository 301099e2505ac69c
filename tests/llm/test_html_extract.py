"""Main text: the article of the test pages, page layouts, broken markup."""
import html
import re

from corpusmill.llm import html_extract as H


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    parts = [html.unescape(re.sub("<[^>]*>", "", x)) for x in re.split("</?(?:p|h1)[^>]*>", inner)]
    return " ".join(" ".join(x.split()) for x in parts if x.strip())


def test_test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    assert {r.page_id: (r.url, r.text) for r in H.extract_main_text(pages).collect()} == want


def test_side_parts_go():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="home">
    <header><h1>Site name of the whole site</h1></header><div id="top-nav"><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></div>
    <div class="cookie-notice"><p>We use cookies to make this site a better place for all of us and for you.</p></div>
    <div class="wrap"><div class="post"><h2>A title</h2><p>First &amp; long   paragraph with <b>bold</b> and <a href=y>a link</a> in it.</p>
    <div class="ad-box">Buy this thing now</div><p>Second paragraph&nbsp;with &#8212; signs,<br>two lines.</p>
    <ul><li>One point<li>Another point</ul><table><tr><td>Cell one<td>Cell two</table>
    <script>document.write("<p>no</p>")</script><!-- <p>no</p> --></div>
    <div id="comments"><h3>Comments</h3><p>A reader says a lot of things here that are not part of the article at all.</p></div>
    <aside>Read more elsewhere</aside></div>
    <form><p>Your mail <input name=m></p><button>Send</button></form><footer>Copyright</footer></body></html>"""
    assert H.main_text(page) == ("A title First & long paragraph with bold and a link in it. Second paragraph with — signs, two lines. "
                                 "One point Another point Cell one Cell two")


def test_names_of_wrappers_do_not_drop_the_article():
    """Class names of page wrappers, and the word hidden in a value, take no text away."""
    story = "".join(f"<p>Sentence {i} of the story goes on for a good while here.</p>" for i in range(8))
    want = " ".join(f"Sentence {i} of the story goes on for a good while here." for i in range(8))
    for names in ("content has-sidebar", "no-sidebar", "with-sidebar", "page header-fixed", "ad-free", "comments-open",
                  "hasSidebar", "sidebar-layout", "elementor-widget"):
        for inner in (story, f"<article>{story}</article>", f"<article>{story}</article><div class='sidebar'><p>Read more</p></div>"):
            assert H.main_text(f'<body><nav>Menu</nav><div id="x" class="{names}">{inner}</div></body>') == want, names
    assert H.main_text('<body><div class="sidebar-layout">One line of text</div></body>') == "One line of text"
    widgets = story.replace("<p>", '<div class="widget"><p>').replace("</p>", "</p></div>")
    assert H.main_text(f"<body><div>{widgets}</div></body>") == want
    assert H.main_text(f'<body><div title="a hidden gem" data-x="class=ad display:none">{story}</div></body>') == want
    for attr in ("hidden", "hidden=''", "HIDDEN id=x", 'style="color:red; display: none"', 'class="ad" title="x"'):
        assert H.main_text(f"<body><div>{story}</div><div {attr}><p>Not to be seen by anyone.</p></div></body>") == want, attr


def test_large_side_parts_beside_the_article_go():
    """Comments that are longer than the article, or made of articles."""
    story = "".join(f"<p>Sentence {i} of the story goes on for a good while here.</p>" for i in range(4))
    want = " ".join(f"Sentence {i} of the story goes on for a good while here." for i in range(4))
    said = "".join(f"<div><p>Reader {i} says something that is no part of the story.</p></div>" for i in range(9))
    cards = said.replace("div>", "article>")
    for post in (f"<article>{story}</article>", f"<div>{story}</div>"):
        for comments in (said, cards):
            side = f'<div id="comments">{comments}</div>'
            assert H.main_text(f"<body>{post}{side}</body>") == want
            assert H.main_text(f"<body><main>{post}{side}</main></body>") == want


def test_links_lower_the_density():
    links = "".join(f"<p><a href=/{i}>A headline of another story number {i}</a></p>" for i in range(12))
    text = "".join(f"<p>Sentence {i} of the story goes on for a good while here.</p>" for i in range(6))
    got = H.main_text(f"<body><div>{links}</div><div>{text}</div></body>")
    assert got.startswith("Sentence 0") and got.endswith("while here.") and "headline" not in got


def test_sections_stay_together():
    part = lambda n: "".join(f"<p>Section {n} line {i} with enough words in it.</p>" for i in range(4))
    want = " ".join(f"Section {n} line {i} with enough words in it." for n in range(3) for i in range(4))
    inner = "".join(f"<section>{part(n)}</section>" for n in range(3))
    assert H.main_text(f"<body><nav><a>x</a></nav><main>{inner}</main></body>") == want
    assert H.main_text(f"<body><div><div><a href=x>go</a></div><div>{inner}</div></div></body>") == want


def test_sections_below_the_body_stay_together():
    """Parts of an article that lie directly in the body, with more paragraphs than sections."""
    for sections, lines, size in ((2, 10, 500), (2, 3, 300), (3, 4, 40), (5, 2, 120)):
        text = lambda n, i: (f"Section {n} line {i} " + "with enough words in it " * 30)[:size].strip() + "."
        part = lambda n: "".join(f"<p>{text(n, i)}</p>" for i in range(lines))
        want = " ".join(text(n, i) for n in range(sections) for i in range(lines))
        inner = "".join(f"<section>{part(n)}</section>" for n in range(sections))
        assert H.main_text(f"<body><nav><a>x</a></nav><h1>A title</h1>{inner}<footer>y</footer></body>") == f"A title {want}"
        assert H.main_text(f"<body>Words <a href=/>first</a>, then{inner}</body>") == f"Words first, then {want}"
        if lines <= sections:  # the body is denser than a section and all of it is content
            continue
        links = "".join(f"<li><a href=/{i}>Another story {i}</a>" for i in range(9))
        assert H.main_text(f"<body><div><ul>{links}</ul></div><a href=/>Home</a> | <a href=/n>News</a>{inner}</body>") == want


def test_broken_markup():
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<p></p>") == ""
    assert H.main_text("only text &lt;b&gt; &eacute;") == "only text <b> é"
    assert H.main_text("<p>open <b>bold") == "open bold"
    assert H.main_text("a</div></p>b<") == "ab<"
    assert H.main_text("<p>x</p><!-- open <p>y") == "x"
    assert H.main_text("<script>var a='</p>'") == ""
    assert H.main_text("<p title='a>b'>t</p>") == "t"
    assert H.main_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert H.main_text("<div>" * 30000 + "deep" + "</span>" * 30000) == "deep"
    assert H.main_text("<div class=ad>" * 30000 + "deep") == "deep"
    assert H.main_text("<p>é 日本 x" + " y" * 300000).count("y") == 300000


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 9), (1, "u", "<p>a</p>", 9), (None, None, None, 9)],
                               "page_id bigint, url string, html string, text int")
    assert [(r.page_id, r.url, r.text) for r in H.extract_main_text(df).collect()] == [(1, "u", "a"), (1, "u", "a"), (None, None, "")]
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_a_form_around_the_page():
    """Some pages wrap all they have in one form; a small form beside the article goes."""
    text = "This is a long paragraph of the article that goes on and on, with many words in it. "
    body = f"<nav><a href=/>Home</a></nav><div class=story><h1>Title</h1><p>{text * 3}</p><p>{text * 2}</p></div><footer>F</footer>"
    want = H.main_text(f"<body>{body}</body>")
    assert want.startswith("Title This is")
    side = "<form><label>Your mail</label><input name=m><p>Sign up now for our letter</p><button>Send</button></form>"
    for page in (f"<body><form action=/x method=post><input type=hidden name=state value=1>{body}</form></body>",
                 f"<body><form><article>{body}</article></form></body>", f"<body><form>{body}</form>{side}</body>",
                 f"<body>{side}{body}{side}</body>"):
        assert H.main_text(page) == want, page
    assert H.main_text("<body><article><header><p>By a person</p></header><p>Words of the article.</p></article></body>") == "Words of the article."
