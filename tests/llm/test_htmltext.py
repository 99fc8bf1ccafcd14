import re
import time

from gridloom.llm import htmltext as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad-box">Buy <b>now</b></div><aside>side</aside><div class="cookie notice">We use cookies</div>
<div class="page post-%d"><div class="content"><h2>Head&nbsp;line</h2><p>First &lt;b&gt; <b>bold
text<br>next<p>Second&#33; <a href="x">link</a> &amp; more text that is long enough<ul><li>one<li>two</ul>
<form>Name <input></form><script>x()</script><table><tr><td>cell a<td>cell b</table></div>
<div class="comments"><p>a very long reader comment, a very long reader comment, a very long reader comment, a very long one</p></div></div>
<footer>&copy; me</footer>"""
WANT = "Head line\n\nFirst <b> bold text next\n\nSecond! link & more text that is long enough\n\none\n\ntwo\n\ncell a\n\ncell b"


def test_scan_and_text():
    page = H.scan(PAGE % 7)
    assert H.text_of(page, page.paths[H.best(page)]) == WANT
    path = 0
    for label in ("body", "div.page.post", "div.content"):
        path = H.step(path, label)
    assert page.paths[H.best(page)] == path
    for odd in ("", "<", "<p", "a &am b", "<b>x", "</p></div>", "<!-- x", "<script>x"):
        H.text_of(H.scan(odd), None)
    assert H.text_of(H.scan("<p>&am &amp &bogus;x</p>"), None) == "&am & &bogus;x"
    assert H.text_of(H.scan("just text <i>here</i>"), None) == "just text here"


def test_deep_and_long_pages():
    assert H.text_of(H.scan("<div>" * 3000 + "x"), None) == "x"
    assert len(H.text_of(H.scan("<article>" + "<p>word word</p>" * 20000), None)) == 20000 * 11 - 2


def test_broken_markup_takes_linear_time():
    for unit in ("<a title=\"foo>bar</a> ", "<a ", "<p class='x>y", "<!", "</", "<div>", "</b>", "<b><h1>x", "<p><li>x", "<svg>", "<!-- ", "= '", "<td><div class='ad'>", "<form>x"):
        spent = []
        for n in (4_000, 16_000):
            began = time.process_time()
            H.text_of(H.scan(unit * n), None)
            spent.append(time.process_time() - began)
        assert spent[1] < 10 * spent[0] + 0.3, (unit, spent)
    assert H.text_of(H.scan('<p>a <a title="foo>bar</a> b</p>'), None) == "a bar b"
    assert H.text_of(H.scan("<p>don't <b x='>'>this</b> 1 < 2"), None) == "don't this 1 < 2"


def brute_votes(rows):
    """The winning path of each host, counted in plain Python."""
    host = lambda u: m[1].lower() if (m := re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "")) else ""
    n = {}
    for _, url, source in rows:
        page = H.scan(source or "")
        if page.blocks:
            i = H.best(page)
            n.setdefault(host(url), {}).setdefault(page.paths[i], []).append(H.scores(page)[i])
    return {h: max(v, key=lambda p: (len(v[p]), round(sum(v[p]), 3), p)) for h, v in n.items()}, host


def test_whole_table_against_brute_force_votes(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    tie = "<body><div class='a'><p>" + "x " * 40 + "</p></div><div class='b'><p>%s</p></div>"
    rows += [(900, "http://tie/1", tie % "y"), (901, "http://tie/2", tie % ("y " * 90))]
    won, host = brute_votes(rows)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.host: r.path for r in H.winners(df).collect()} == won
    want = {(i, H.text_of(H.scan(h or ""), won.get(host(u)))) for i, u, h in rows}
    assert {(r.page_id, r.text) for r in H.extract(df).collect()} == want


def test_consensus_overrules_a_page(spark):
    odd = PAGE % 3 + '<div class="links">' + "<p>long other text without any links at all in it</p>" * 9 + "</div>"
    rows = [(i, f"https://User@A.example:80/{i}", PAGE % i, "x") for i in range(6)] + [(6, "http://a.example/6?x", odd, "x"), (7, "http://b.example/", odd, "x")]
    rows += [(8, None, None, "x"), (9, "", "", "x"), (6, "http://a.example/6?x", odd, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, path string")
    got = [(r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()]
    assert len(got) == len(rows)
    for page, text, n in got:
        assert n == len(text)
        if page <= 6:
            assert text == WANT
        elif page == 7:
            assert "long other text" in text and "reader comment" not in text
        else:
            assert text == ""
    assert H.extract(df.limit(0)).count() == 0


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_HOSTS", 0)
    df = spark.createDataFrame([(1, "http://a/", PAGE % 1)], "page_id bigint, url string, html string")
    assert H.extract(df).first().text == WANT


def test_sibling_containers_and_text_beside_them(spark):
    part = lambda tag, word, n: f"<{tag}><p>" + f"{word} " * n + f"</p></{tag}>"
    unequal = "<body><nav>menu</nav><article><p>" + "intro " * 50 + "</p>" + part("section", "long", 400) + part("section", "brief", 100) + "</article>"
    five = "<body><article>" + "".join(part("section", w, 100) for w in ("one", "two", "three", "four", "five")) + "</article><footer>foot</footer>"
    divs = "<body><div class='text'><h2>Title</h2>" + "".join(part("div", w, n) for w, n in (("first", 300), ("second", 20))) + "</div>"
    split = "<body>" + part("div class='post'", "upper", 200) + "<nav>menu</nav>" + part("div class='post'", "lower", 30)
    # most pages have one part, or unequal ones: the host's path must not cut the others
    single = "<body><div class='text'>" + part("div", "only", 200) + "</div>"
    rows = [(i, f"http://a/{i}", unequal) for i in range(5)] + [(5, "http://a/5", five)] + [(i, f"http://b/{i}", single) for i in range(10, 15)] + [(15, "http://b/15", divs), (16, "http://c/", split)]
    got = {r.page_id: r.text.split() for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0] == ["intro"] * 50 + ["long"] * 400 + ["brief"] * 100
    assert got[5] == [w for w in ("one", "two", "three", "four", "five") for _ in range(100)]
    assert got[15] == ["Title"] + ["first"] * 300 + ["second"] * 20
    assert got[16] == ["upper"] * 200 + ["lower"] * 30


def test_names_and_forms_that_hold_the_text():
    read = lambda source: H.text_of(H.scan(source), None)
    story, more = "story " * 60 + "end", "more " * 20 + "end"
    for opened in (
        "<body class='has-sidebar'>", "<body class='search'><main class='no-sidebar'>", "<div class='content-with-menu'>", "<article class='share-enabled'>", "<article class='social'>",
        "<form id='form1' method=post>", "<body><form class='page'><div>", "<div class='form-wrapper'>", "<div data-role='banner'>",
    ):
        assert read(opened + f"<p>{story}</p>") == story, opened
    for name in ("social-history", "forms-of-government", "related-work"):
        assert read(f"<article><p>{story}</p><section id='{name}'><h2 id='{name}'>Head</h2><p>{more}</p></section></article>") == f"{story}\n\nHead\n\n{more}"
    assert read(f"<article><h2 class='header' id='search'>Head</h2><p>{story}</p></article>") == f"Head\n\n{story}"
    for tag in ("svg", "math", "object", "iframe"):
        assert read(f"<p>{more}<{tag} a='b'/></p><p>{story}</p><{tag}>x</{tag}>") == f"{more}\n\n{story}"
        assert read(f"<p>{more}</p><{tag} a='b'><p>{story}</p>") == f"{more}\n\n{story}"
    for name in ("ad-box", "site-header", "main-nav", "sidebar left", "cookie-notice", "post_comments", "share-buttons"):
        assert read(f"<p>{story}</p><div class='{name}'>junk</div>") == story, name
    assert read(f"<p>{story}</p><form>Name <input></form><form class='search-form'>Find</form>") == story
    for opened in ("<body class='single-post with-sidebar'>", "<body class='page search-page'>", "<div class='article-share-wrap'>", "<div class='post no-comments'>", "<form><div>", "<div class='widget'><div class='comments'>"):
        assert read(f"{opened}<p>{story}</p><div class='comments'><p>{more}</p></div>") == story, opened
    deep = "<div class='c%s'>" * 12 % tuple("abcdefghijkl")
    assert H.best(H.scan(deep + f"<p>{story}</p>")) == 12 and H.scan(deep).paths[-1] != H.scan(deep.replace("'ca'", "'cz'")).paths[-1]
    assert read("<nav>menu</nav>") == ""
