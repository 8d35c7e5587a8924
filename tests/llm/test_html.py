import random

import pytest

from fluxweave.llm.html_text import Page, extract


def text(s):
    return Page(s).text(frozenset())


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a</p><p>b", "a b"), ("<p>a<b>b</b>c<br>d", "abc d"), ("<div>x<!-- no --><script>if (a<b) '</p>'</script>y</div>", "xy"),
        ("<article><h1>T</h1><p>One &lt;two&gt;\n three&nbsp;four</p></article><footer>f</footer>", "T One <two> three four"),
        ("<nav>menu</nav><main><p>body</p><aside>side</aside><form>f<input></form></main>", "body"),
        ("<div class='cookie-notice'>we use</div><div id=sidebar>s</div><div role=navigation>n</div><p hidden>h</p><div style='display: none'>d</div><p>text</p>", "text"),
        ("<article><p>real article text</p><section class=comments><article><p>a reader comment</p></article></section></article>", "real article text"),
        ("<article><header><h1>Head</h1></header><p>x</p></article><header>site</header>", "Head x"),
        ("<table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b</ul>", "1 2 3 a b"), ("a < b and c > d", "a < b and c > d"), ("<p>unclosed <!-- comment", "unclosed"),
        ("<p>x</p><style>p{}", "x"), ("<script>a <b 'open</script><p>it's</p><p>'x'</p>", "it's 'x'"), ("<p title=\"a>b\">q</p>", "q"), ("</div></p>stray<p>", "stray"), ("<html><head><title>t</title></head><body class='menu'><p>b</p></body></html>", "b"),
        ("&#x41;&#66;&eacute;&unknown;", "AB\u00e9&unknown;"), ("<![CDATA[raw & data]]>", "raw & data"), ("<p>one<div>two</div>three", "one two three"),
    ],
)
def test_pages(source, expected):
    assert text(source) == expected


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<div class='has-sidebar'><article><p>body</p></article></div>", "body"), ("<main class='no-menu'><p>body</p></main>", "body"), ("<article class='post comments-open'><p>body</p></article>", "body"),
        ("<article><p>x</p><div class=alert>mind this</div><div class='reader-feedback'>first!</div></article>", "x mind this"), ("<div class=alert>mind this</div><p>body</p>", "body"), ("<div class='cookie-notice'>we use these and those</div><p>x</p>", "x"),
        ("<form action=x><main class=menu><p>body</p></main><div class=ad>buy</div></form>", "body"), ("<div class=sidebar><p>all there is</p></div>", "all there is"),
        ("<div class=sidebar>aside, and at some length</div><p>enough of a body</p>", "enough of a body"), ("<article><p>a</p></article><section class=comments><article><p>no</p></article></section>", "a"),
        ("<main><div class=widget><p>a</p></div></main><section id=comments><article>no</article></section>", "a"), ("<div class=siteMenu>m</div><div class='site-footer'>f</div><div class='sidebar-2'>s</div><p>q</p>", "q"),
        ("<div class='comments'><p>only readers speak here</p></div>", ""), ("<nav><article>links</article></nav><p>q</p>", "q"), ("<article class=widget><p>short</p></article><article class=promo><p>the longer one</p></article>", "the longer one"),
    ],
)
def test_roles_never_take_the_content(source, expected):
    assert text(source) == expected


def test_hostile_input_takes_linear_time():
    for s in ("<" * 50_000, "<a " * 20_000, "<div>" * 20_000 + "x", '<p a="' * 5_000, "<!--" * 20_000, "&" * 50_000, "</p>" * 20_000):
        Page(s).text(frozenset())


def test_site_templates_go_and_shared_article_text_stays(spark):
    rows = []
    for i in range(20):
        same = "<p>paragraph that every article has</p>"
        rows.append((i, f"http://a.org/{i}", f"<div class=x1><p>Welcome to our site</p><ul><li>Home</li></ul></div><div><p>story number {i} is long enough to matter</p></div><div>Template tail</div>"))
        rows.append((100 + i, f"http://b.org/{i}", f"<article><h1>t{i}</h1>{same}<div class=zz>Read more here</div><p>{'words ' * 20}{i}</p></article>"))
        rows.append((200 + i, f"http://c.org/{i}", "<article><p>copy of one page</p></article>"))
    rows += [(300, "http://d.org/", "<div>Template tail</div><div>alone</div>"), (301, None, None), (302, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for options in ({}, {"broadcast_rows": -1}):
        got = {r.page_id: r.text for r in extract(pages, **options).collect()}
        assert len(got) == len(rows)
        for i in range(20):
            assert got[i] == f"story number {i} is long enough to matter"
            assert got[100 + i] == f"t{i} paragraph that every article has {'words ' * 20}{i}"
            assert got[200 + i] == "copy of one page"
        assert (got[300], got[301], got[302]) == ("Template tail alone", "", "")


def test_odd_inputs(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", 5, "q")], "page_id long, url string, html string, text int, _host string")
    assert extract(pages.where("page_id < 0")).count() == 0
    twice = extract(pages.unionByName(pages)).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in twice] == [(1, "x", 1)] * 2


def test_recurrence_decides_outside_the_article_and_in_its_lists(spark):
    """Text outside the article stays unless it recurs, however long; a list item that recurs in articles goes."""
    house = "<div class=x1>About this house " + "and its long story " * 30 + "</div>"
    rows = [
        (i, f"http://a.org/{i}", f"{house}<article><p>body number {i} of this site</p><ul><li>join us today</li><li>item {i}</li></ul></article><div>postscript {i}</div>")
        for i in range(12)
    ]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"body number {i} of this site item {i} postscript {i}" for i in range(12)}


def test_no_claim_loses_the_rest_of_the_page(spark):
    """A title, a date or one of several articles that claims to be the content leaves the other text in place."""
    pages = [
        "<body><h1 class='post-title'>T</h1><div id='page'><p>long body of the page</p></div></body>",
        "<body><p class='entry-date'>May</p><div><p>long body of the page</p></div></body>",
        "<body><article><p>first part</p></article><article><p>the second part is longer</p></article><article><p>third</p></article></body>",
    ]
    assert [text(p) for p in pages] == ["T long body of the page", "May long body of the page", "first part the second part is longer third"]
    rows = [(i, "http://a.org/", f"<article><p>shared words</p><div>a tail</div><p>long text of part one {i}</p></article><article><p>shared words</p><p>{'more ' * 30}{i}</p></article>") for i in range(9)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"shared words long text of part one {i} shared words {'more ' * 30}{i}" for i in range(9)}


def test_subtrees_are_counted_wherever_they_stand(spark):
    """Menus, forms and adverts that recur go as templates (in an article too), one-off ones by their role."""
    rows = []
    for i in range(10):
        menu = "<nav><ul><li>Home</li><li>News</li></ul></nav>"
        rows.append((i, f"http://a.org/{i}", f"<article>{menu}<p>story {i} of the day</p><div class=ad>once {i}</div></article><footer>all rights</footer><form>find <input></form>"))
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(10):
        assert (got[i].text, got[i].n_template, got[i].n_role) == (f"story {i} of the day", 3, 1)


def test_counts_against_brute_force(spark):
    """What recurs on a host is found by comparing all subtrees of all pages as text."""
    rng, rows = random.Random(9), []
    for i in range(60):
        blocks = [f"<div><span>block {rng.randrange(12)}</span></div>" for _ in range(4)]
        rows.append((i, f"http://h{i % 3}.org/{i}", f"<body>{''.join(blocks)}<div>own words of page {i} and some more of them to read</div></body>"))
    hosts = {}
    for i, url, source in rows:
        hosts.setdefault(url.split("/")[2], []).append({b for b in range(12) if f"block {b}<" in source})
    often = {h: {b for b in range(12) if sum(b in x for x in pages) >= max(4, 0.1 * len(pages))} for h, pages in hosts.items()}
    want = {}
    for i, url, source in rows:
        seen = [int(x.split("<")[0]) for x in source.split("block ")[1:]]
        want[i] = " ".join([f"block {b}" for b in seen if b not in often[url.split("/")[2]]] + [f"own words of page {i} and some more of them to read"])
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want
