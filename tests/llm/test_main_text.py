import pytest

from stratafold.llm.main_text import extract, main_text, subtree_hashes

PAGES = "page_id long, url string, html string, hashes string, n_chars int, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, "x") for row in rows], PAGES)


@pytest.mark.parametrize("html,text", [
    ("", ""),
    ("<p>a  b\n<p>c &amp; d&nbsp;e", "a b\n\nc & d e"),
    ("<nav>n</nav><header>h</header><article><h1>T</h1><p>x<br>y <b>z</b>.</article><footer>f", "T\n\nx y z."),
    ("<article><p>a<script>var t='</p>'</script>b<style>p{}</style></p><!-- c <p>d --></article>", "ab"),
    ("<main><p>a</p><aside>s</aside><div class='cookie-notice'>k</div><form><p>f</form><section id=comments><p>c</section></main>", "a"),
    ("<div class='page with-sidebar'><article><p>a</article><div class=sidebar>s</div></div>", "a"),
    ("<section class=comments><article><p>c</article></section><article><p>a</article>", "a"),
    ("<p>1 < 2 & 3 <b", "1 < 2 & 3"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
    ("<article><p title='>'>a</p><p hidden>h</p><p style='display: none'>i", "a"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<body><p>" + "long " * 50_000, ("long " * 50_000).strip()),
])
def test_pages(html, text):
    assert main_text(html, set()) == text


@pytest.mark.parametrize("html,text", [
    ("<p title='The hidden truth'>a</p><p data-title='A hidden gem'>b</p><p data-id='menu-7'>c</p><p data-class=menu>d", "a\n\nb\n\nc\n\nd"),
    ("<div class='layout with-sidebar'><p>a</div><div class='no-sidebar'><p>b</div><div class='main-widget'><p>c</div>", "a\n\nb\n\nc"),
    ("<div class=widget><p>a</p><p hidden>h</p><nav>n</nav></div>", "a"),
    ("<p>a</p><div class='site-footer'>f</div><div class='left sidebar'>s</div><div role=navigation>n</div>", "a"),
])
def test_names_are_whole_attributes_and_classes(html, text):
    assert main_text(html, set()) == text


@pytest.mark.parametrize("html,text", [
    ("<div class=content><p>The long body of this page.</div><article class=teaser>t</article><article class=teaser>u</article>", "The long body of this page.\n\nt\n\nu"),
    ("<article><p>Start.</article><p>The text goes on after it.", "Start.\n\nThe text goes on after it."),
    ("<p>some words</p><article><p>The long body of this page.</article>", "The long body of this page."),
    ("<div>a long notice about things</div><main><p>a<article>b</article></main>", "a\n\nb"),
    ("<main></main><p>a long body here</p><article>b</article>", "a long body here\n\nb"),
])
def test_text_outside_of_small_articles_stays(html, text):
    assert main_text(html, set()) == text


def test_recurring_subtrees_go_and_articles_stay(spark):
    bar = "<div><span>Hot today</span> <a href=/x>more</a></div>"
    same = "<article><p>The same article everywhere.</p></article>"
    rows = [(n, "https://h.example/%d" % n, f"<body>{bar}<div><p>Text {n}</p></div></body>") for n in range(12)]
    rows += [(100 + n, "https://c.example/%d" % n, f"<body>{bar}{same}</body>") for n in range(12)]
    rows += [(200, "https://other.example/", f"<body>{bar}<p>own</p></body>"), (201, None, f"<body>{bar}<p>own</p></body>"), (202, None, None), (202, None, None)]
    df = pages(spark, rows)
    found = {r.page_id: r for r in extract(df).collect()}
    assert extract(df).count() == len(rows)
    assert all(found[n].text == f"Text {n}" for n in range(12))
    assert all(found[100 + n].text == "The same article everywhere." for n in range(12))
    assert found[200].text == found[201].text == "Hot today more\n\nown" and found[202].text == "" and found[202].n_chars == 0
    assert found[5].n_chars == len("Text 5") and found[5].url == "https://h.example/5"
    assert extract(pages(spark, [])).collect() == []


def test_hashes_follow_the_content():
    a, b = subtree_hashes("<body><div class=x>one</div></body>"), subtree_hashes("<body><div class=x>two</div></body>")
    assert set(a) != set(b) and subtree_hashes("<body><div class=x>one</div></body>") and len(set(a)) == len(a)
