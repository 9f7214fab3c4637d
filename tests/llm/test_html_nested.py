from spendweave.llm import html_text

BODY = "<p>" + "words of the body go on and on. " * 40 + "</p>"


def test_heading_lead_and_closing_stay_with_a_nested_body():
    page = f"<body><nav>menu</nav><article><h1>Head</h1><p>Lead text.</p><div class=body>{BODY}</div><section><p>Closing.</p></section></article></body>"
    path, _ = html_text.best_container(html_text.parse(page))
    lines = html_text.extract(page, [path]).split("\n")
    assert lines[0] == "Head" and lines[1] == "Lead text." and lines[-1] == "Closing." and len(lines) == 4


def test_heading_stays_without_an_article():
    page = f"<body><div class=wrap><h1>Head</h1><div class=text>{BODY}</div></div></body>"
    assert html_text.extract(page, [html_text.best_container(html_text.parse(page))[0]]).startswith("Head\n")


def test_pages_of_two_templates_on_one_host(spark):
    first = "<body><article><h1>Story %d</h1>" + BODY + "</article></body>"
    second = "<body><article>Short summary box.</article><div class=story><h1>Report %d</h1>" + BODY * 2 + "</div></body>"
    for number in (2, 5, 8):                       # pages of the second template among ten
        rows = [(i, f"http://host.example/{i}", (second if i < number else first) % i) for i in range(10)]
        got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        for i in range(10):
            lines = got[i].split("\n")
            assert lines[0] == (f"Report {i}" if i < number else f"Story {i}") and len(lines) == (3 if i < number else 2)


def test_a_qualifying_word_in_a_name_is_not_furniture():
    page = ("<main><section class=notice-board><p>On the board.</p></section><div id=searchHistory><p>Past searches.</p></div>"
            "<div class='site-search'>no</div><div class=notice-box>no</div><div class='wide cookieNotice'>no</div><div class=alert>no</div>"
            "<div class=search-ad>no</div><p>The end.</p></main>")
    assert html_text.extract(page, None) == "On the board.\nPast searches.\nThe end."
