from spendweave.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
<header>site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- no <p>no</p> -->
<div id="main-%d" class="post-%d wrap"><h1>Head&shy;line &lt;1&gt;</h1><p>First <b>bold<br>text</b>
 here<p>Second &eacute; <a href="a>b">link</a></p><div class="share buttons">no<div>no</div></div>
<ul><li>one</li><li>two</ul><form>no</form><table><tr><td>cell</td><td>next</td></tr></table></div>
<aside>no</aside><div class="comments"><p>no</p></div><div class="cookieNotice">no</div><footer>no</footer></body></html>"""
TEXT = "Head\xadline <1>\nFirst bold text here\nSecond é link\none\ntwo\ncell\nnext"


def test_page_without_host_paths():
    assert h.extract(PAGE % (1, 2), None) == TEXT
    assert h.best_container(h.parse(PAGE % (1, 2)))[0] == h.best_container(h.parse(PAGE % (7, 93)))[0] == "body>div.post.wrap"


def test_broken_markup():
    assert h.extract("", None) == h.extract(None, ["body"]) == ""
    assert h.extract("1 < 2 and a > b &amp c", None) == "1 < 2 and a > b & c"
    assert h.extract("<p>a<p>b</div></article><p>c<!-- never closed <p>no", None) == "a\nb\nc"
    assert h.extract("<main><p>text<div class=ad>never closed<p>no</main><p>after", ["main"]) == "text"
    assert h.extract("<article>x<script>if (a<b) { '</p>' }</script>y<SCRIPT>never closed <p>no", None) == "xy"
    assert h.extract("<article><header><h2>Title</h2></header>body text</article>", None) == "Title\nbody text"
    assert h.extract("<body>" + "<div>" * 5000 + "deep", None) == "deep"
    assert len(h.extract("<p>" + "word " * 200_000, None)) == 999_999


def test_hosts_agree_on_a_path(spark):
    teaser = "<div class='teaser'><p>%s</p></div>"
    page = "<html><body><div class='story-%d'><p>%s</p></div>" + teaser + "</body></html>"
    rows = [(i, f"https://User@News.example.com:80/{i}", page % (i, "story words " * 9, "short")) for i in range(8)]
    rows.append((8, "http://news.example.com/8?x=//y", page % (8, "brief", "a much longer teaser than the story of this page is")))
    rows.append((9, "http://news.example.com/9", "<html><body><main><p>another template</p></main></body></html>"))
    rows += [(10, "http://other.example.org/", page % (1, "brief", "a teaser as the longest text of the page")), (11, None, "<p>no url"), (12, "", None), (12, "", None)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, text int")
    got = h.main_texts(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 14 and all(r.n_chars == len(r.text) for r in got)
    assert text[8] == "brief" and text[0] == ("story words " * 9).strip()         # the host's path, not the page's longest part
    assert text[9] == "another template" and text[10].startswith("a teaser") and text[11] == "no url" and text[12] == ""
    paths = {r.host: r.paths for r in h.host_paths(pages).collect()}
    assert paths["news.example.com"][0] == "body>div.story" and len(paths) == 3
    assert h.main_texts(pages.limit(0)).count() == 0


def test_pages_of_the_test_data(spark):
    """The articles as a plain pattern sees them."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in h.main_texts(pages).collect()} == want
