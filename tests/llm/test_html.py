import time

import pytest

from weft.llm import html

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><a>Home</a></nav><div class="cookie-notice">cookies</div>
<article class="post"><header class="entry-header"><h1>Title &amp; more</h1></header><p>One <b>bold
  text</b>&nbsp;here<!-- no --><p>Two<br>three<div class="share-buttons">share</div><ul><li>x<li>y</ul>
<form><input value=1>form</form><section id="comments"><article class="comment">bad</article></section>
<table><tr><td>c1<td>c2</table>1 < 2 &lt;tag&gt; &copy &unknown;</article><aside>side</aside><footer>foot</footer></body></html>"""
WANT = "Title & more\nOne bold text here\nTwo\nthree\nx\ny\nc1\nc2\n1 < 2 <tag> © &unknown;"


def test_article():
    assert html.Page(PAGE).text() == WANT


@pytest.mark.parametrize("source, want", [("", ""), ("plain", "plain"), ("<p>a", "a"), ("<p>a</div></p></i>b", "a\nb"), ("<div><p>a</p", "a"), ("<p title='>'>x", "x"), ("<script>x", ""), ("<main><p>in</main><p>out", "in"), ("<p>a<td>b", "a\nb"), ("<a href=\"x>y", "y"), ("<div hidden>no</div>yes", "yes"), ("<SCRIPT>a</script >b", "b"), ("&#233;&eacute;&#x20AC;", "éé€")])
def test_broken_pages(source, want):
    assert html.Page(source).text() == want


def test_any_cut_is_read():
    for n in range(len(PAGE)):
        html.Page(PAGE[:n]).text()


def site(n=12):
    head, foot = "<div class=q><span>Menu</span></div>", "<div><div>Terms apply</div></div>"
    return [(i, f"http://Host.example:80/{i}", f"<body>{head}<div><p>Story {i} of many</p></div>{foot}</body>") for i in range(n)]


@pytest.mark.parametrize("most", [html.MOST_BROADCAST, 0])
def test_templates_go(spark, most):
    rows = site() + [(100 + i, f"http://copies/{i}", "<body><div><p>The same story</p></div></body>") for i in range(9)] + [(200, None, None), (201, "", ""), (201, "", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in html.main_text(df, most_broadcast=most).collect())
    # copies of one page are one content: nothing of them is a template
    assert got == [*((i, f"Story {i} of many") for i in range(12)), *((100 + i, "The same story") for i in range(9)), (200, ""), (201, ""), (201, "")]


def test_empty_table(spark):
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("block", ["<div>Notice <b>one</b></div>", "<p>Notice one</p>", "<h2>Notice one</h2>", "<blockquote>Notice one</blockquote>", "<ul><li>Notice one</ul>", "<span>Notice one</span><br>", "<a href=/>Notice <i>one</i></a>", "<div><h1>Notice one</h1></div>"])
def test_template_of_a_section_goes(spark, block):
    """Six of 300 pages have it, some among other items."""
    story = lambda i: f"<h1>Title {i}</h1><p>Story {i} of <a>many</a></p>"
    rows = [(i, f"http://host/{i}", f"<body>{block if i < 6 else ''}<div>{story(i)}</div></body>") for i in range(300)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nStory {i} of many" for i in range(300)}


AD = "<div class='ad-{}'>Buy {} now</div>"


def mixed_site(n, host="host"):
    """Pages whose menu, advert and footer say something else each time, with articles that recur in shape."""
    nav = lambda i: "<ul>" + "".join(f"<li><a href=/{i}/{k}>Item {i} {k}</a></li>" for k in range(3 + i % 4)) + "</ul>"
    body = lambda i: f"<article><h1>Title {i}</h1><p>Yes.</p><p>Story {i} of <b>many</b></p><div class=share>Share this</div><p>No.</p></article>"
    return [(i, f"http://{host}/{i}", f"<html><head><title>T{i}</title></head><body>{nav(i)}{AD.format(i, i)}{body(i)}<div class=below>&copy; {host} {i}</div></body></html>") for i in range(n)]


def test_templates_alone_find_what_varies(spark):
    """Without names: menus, adverts and footers of hosts with many pages go, articles stay whole; few pages tell nothing."""
    rows = mixed_site(8) + [(100 + i, u, h) for i, u, h in mixed_site(3, "small")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n) for r in html.main_text(df, names=False, deleted="n").collect()}
    assert all(got[i] == (f"Title {i}\nYes.\nStory {i} of many\nNo.", 4) for i in range(8))
    assert all("Buy" in got[100 + i][0] and "Share" in got[100 + i][0] and got[100 + i][1] == 0 for i in range(3))
    named = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert named == {i: f"Title {i % 100}\nYes.\nStory {i % 100} of many\nNo." for i in [*range(8), 100, 101, 102]}


def count_plainly(rows):
    """Pages of different content by subtree, in plain Python: the subtree written out, with and without its text."""

    def parts(page, k):
        said, kinds, words = [], [], False
        for x in page.parts[k]:
            if isinstance(x, int):
                c, s = parts(page, x)
                said.append(c)
                kinds += [s] if s not in kinds else []
            elif t := " ".join(page.source[x[0] : x[1]].split()):
                said.append(t)
                words = True
        names = tuple(sorted({w for w in html._words(page.attrs[k]) if not w.isdigit()}))
        return (page.tag[k], " ".join(page.attrs[k].split()), tuple(said)), (page.tag[k], names, words, tuple(kinds))

    on = {}
    for _, url, source in rows:
        page, host = html.Page(source), url.split("/")[2]
        contents, shapes = page.subtrees(host, page.marks()[2])
        for kind, those in ((0, contents), (1, shapes)):
            for k in those:
                on.setdefault((host, kind, parts(page, k)[kind]), set()).add(page.text())
    return sum(len(v) >= html.LEAST_PAGES for v in on.values())


def test_templates_by_a_plain_counter(spark):
    rows = mixed_site(9) + mixed_site(2, "b") + [(50 + i, u, h) for i, u, h in site()] + mixed_site(9)[:4]
    df = spark.createDataFrame([(h, u.split("/")[2]) for _, u, h in rows], "_html string, _host string")
    got = [r.tree for r in html.templates(df).collect()]
    assert len(got) == len(set(got)) == count_plainly(rows) > 5


def test_paragraphs_of_near_copies_stay(spark):
    """Six articles that share most of their paragraphs are no template of their host."""
    same = "".join(f"<p>Paragraph {k} of the text that they share</p>" for k in range(4))
    rows = [(i, f"http://host/{i}", f"<body><article><h1>Title</h1>{same}<p>Ending {i}</p></article></body>") for i in range(6)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].count("\n") == 5 and got[i].endswith(f"Ending {i}") for i in range(6))


@pytest.mark.parametrize("source", ["<div>" * 8000 + "</span>" * 8000, "<b>" * 8000 + "<div></div>" * 8000, "<ul>" + "<div>" * 8000 + "<li></li>" * 8000, "<dl><dt><ul>" + "<b>" * 8000 + "</dt>" * 8000, "<div class=x>" * 20_000 + "text"])
def test_broken_nesting_takes_no_time(source):
    began = time.process_time()
    page = html.Page(source)
    page.subtrees("host", page.marks()[2])
    page.text()
    assert time.process_time() - began < 2


def test_clashing_columns_stay(spark):
    rows = [(i, u, h, 1, 2) for i, u, h in mixed_site(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host int, _trees int")
    for most in (html.MOST_BROADCAST, 0):
        got = html.main_text(df, most_broadcast=most)
        assert got.columns == ["page_id", "url", "_host", "_trees", "text"]
        assert sorted((r.page_id, r._host, r._trees, r.text) for r in got.collect()) == [(i, 1, 2, f"Title {i}\nYes.\nStory {i} of many\nNo.") for i in range(6)]
