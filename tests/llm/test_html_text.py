import pytest

from voltrail.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:"</p>"}</style><script>if (a<b) x="</article>";</script></head><body>
<header class=top><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div>
<article><h1>A &amp; B&nbsp;&lt;C&gt;</h1><p>One  <b>two</b>
 three<br>four<p>Five &copy &#x41;&#66; a < b<ul><li>six<li>seven</ul><aside>side</aside><form><input><button>go</button></form>
<!-- no > comment --><div>eight<p>nine</div>ten<div class="comments"><p>first!</div><script>var y = "<p>no</p>"</script></article>
<section id="reply-box">me too</section><footer>&copy; site</footer>"""
TEXT = "A & B <C>\nOne two three four\nFive © AB a < b\nsix\nseven\neight\nnine\nten"


@pytest.mark.parametrize("html,text", [
    (PAGE, TEXT), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<p>a</div>b</p>c", "a\nb\nc".replace("a\nb", "a\nb")),
    ("<article>x</article><article>y</article>z", "x\ny"), ("<main><p>x</main>z", "x"), ("<body><nav>m</nav><p>x</p><footer>f</footer>", "x"),
    ("<p>a<i", "a"), ("<article><p>x", "x"), ("<b><i>a</b></i> c", "a c"), ("<p>&am; &bogus; &#0;</p>", "&am; &bogus; �"), ("<p>a</p" + " " * 50, "a"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<p a='>'>x</p>", "x"), ("<!-- open", ""), ("<script>x", ""), ('<div class="page-header">h</div><article><div class="header"><h1>t</h1></div>x</article>', "t\nx"),
    ('<div id="header">h</div><p>x', "x"), ('<div class="ad-box">b</div><div class="added">c</div>', "c"), ("<P CLASS=AD>x</P>y", "y"),
])
def test_main_text(html, text):
    assert H.Page(html).text() == text


@pytest.mark.parametrize("html,text", [
    *[(f"<div {a}><nav>m</nav><article><p>x</p></article></div>", "x") for a in (
        'class="content no-sidebar"', 'id="page" class="has-sidebar"', 'class="wrap with-footer"', 'class="post share-enabled"', 'class="sidebar-page"')],
    ('<div class="has-sidebar"><p>x</div>', "x"), ('<div class="sidebar-layout"><h1>t</h1><p>x</div><div class="sidebar">y</div>', "t\nx"),
    ('<article>a<section class="related-work">b</section><div class="notice-text">c</div><p id="ad-hoc">d</p></article>', "a\nb\nc\nd"),
    ('<article>a<div class="related-posts">b</div><div class="share-buttons">c</div><div class="left-sidebar">d</div></article>', "a"),
    ('<div class="comments"><article>c</article></div><article>a</article>', "a"), ('a <span class="ad">b</span> c', "a c"), ('a<div class="sidebar-no-border">b</div>', "a"),
    ('<div class="sidebar-wrap"><article>a</article><div class="comments"><article>c</article></div></div>', "a"),
    ('<div class="ad"><div class="ad"><p>x</div></div>y', "y"), ('<main>m<div class="promo"><article>p</article></div></main>', "m"),
])
def test_names_of_wrappers_and_sections(html, text):
    assert H.Page(html).text() == text


@pytest.mark.parametrize("html,text", [
    ("<svg/><p>x</p>", "x"), ('<svg><path d="M1"/><g/></svg><p>x</p>', "x"), ("<div/><p>x</p>", "x"),
    ("<main><h1>T</h1><p>Story</p><section><article>teaser</article></section></main>", "T\nStory"),
    ('<main><h1>T</h1><p>Story</p><article class="comment">First and longest of all</article></main>', "T\nStory"),
    ("<div><h1>T</h1><p>Long story</p></div><section><article>Other post</article><article>One more</article></section>", "T\nLong story"),
    ("<h1>Site</h1><p>Hello</p><article><p>A long story here</p></article>", "A long story here"),
    ("<main><h1>Blog</h1><article>A long post</article></main>", "A long post"),
    ("<h1>Site</h1><article><h1>T</h1>x</article><section><article><h2>Other</h2></article></section>", "T\nx"),
    ("<article><h1>A</h1>x</article><article><h1>B</h1>y</article>", "A\nx\nB\ny"),
    ('<div><p>Story</p></div><article class="comment-body">First!</article>', "Story"),
    ('<article>Story<article class="comment">First!</article></article>', "Story"), ('<article class="related">x</article>', "x"),
    ('<article>x</article><article class="related">y</article>', "x"), ('<article class="post sidebar-layout">x</article>', "x"),
    ("<main><p>x</p></main><div><h1>T</h1></div>", "x"),
])
def test_regions(html, text):
    assert H.Page(html).text() == text


def test_deep_and_long_pages():
    assert H.Page("<div>" * 20000 + "x" + "</div>" * 20000).text() == "x"
    assert H.Page("<article>" + "<p>word " * 20000).text() == "\n".join(["word"] * 20000)
    assert len(H.Page("<" * 50000).text()) == 50000


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, hash string, host string")


def test_templates_of_a_host_are_deleted(spark):
    box = "<div><p>Welcome to our site</p><ul><li>one<li>two</ul></div>"
    rows = [(f"http://a.net/{i}", f"{box}<div><p>Story {i}</p></div><div>Common words</div>") for i in range(30)]
    rows += [(f"http://b.net/{i}", f"{box}<p>Tale {i}</p>") for i in range(3)]
    rows += [("http://a.net/own", f"<article><p>Mine</p><p>Common words</p>{box}</article>"), (None, "<p>x</p>"), ("http://a.net/none", None)]
    got = {r.url: r for r in H.extract(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got["http://a.net/7"].text == "Story 7" and got["http://a.net/7"].n_chars == 7
    assert got["http://b.net/1"].text == "Welcome to our site\none\ntwo\nTale 1"  # too few pages to tell
    assert got["http://a.net/own"].text == "Mine\nCommon words"
    assert got[None].text == "x" and got["http://a.net/none"].text == ""


def test_copies_of_an_article_are_no_template(spark):
    box = "<div><p>Welcome to our site</p></div>"
    body = "<div class=body><p>Long story</p><ul><li>point</ul></div><table><tr><td>7</table>"
    rows = [(f"http://a.net/copy?print={i}", f"{box}<article><h1>T</h1>{body}</article>") for i in range(10)]
    rows += [(f"http://a.net/{i}", f"{box}<article><div><p>Tale {i}</p></div></article>") for i in range(15)]
    rows += [(f"http://b.net/{i}", f"<div>{body}</div>") for i in range(12)] + [(f"http://b.net/t{i}", f"<p>Tale {i}</p>") for i in range(12)]
    rows += [(f"http://c.net/{i}", f"{box}<article><p>Tale {i}</p><div>Read more</div></article>") for i in range(12)]
    got = {r.url: r for r in H.extract(frame(spark, rows)).collect()}
    for i in range(10):
        assert got[f"http://a.net/copy?print={i}"].text == "T\nLong story\npoint\n7"
        assert got[f"http://b.net/{i}"].text == "Long story\npoint\n7" and got[f"http://b.net/{i}"].n_templates == 0
        assert got[f"http://a.net/{i}"].text == got[f"http://c.net/{i}"].text == f"Tale {i}"


def test_a_box_on_a_small_share_of_a_large_host(spark):
    rows = [(f"http://a.net/{i}", f"<div><p>Story {i}</p></div>" + (f"<div>Notice of section {i % 6}</div>" if i < 240 else "")) for i in range(600)]
    rows += [(f"http://a.net/quote{i}", f"<div><p>Essay {i}</p></div><div>A rare quote</div>") for i in range(12)]
    got = {r.url: r.text for r in H.extract(frame(spark, rows)).collect()}
    assert all(got[f"http://a.net/{i}"] == f"Story {i}" for i in range(600))  # each notice is on 40 of 612 pages
    assert got["http://a.net/quote3"] == "Essay 3\nA rare quote"  # too few for a host of this size


def test_versions_and_own_parts_of_articles(spark):
    """A line that changes does not make a template of the article, nor does a table that many articles share."""
    rows = [(f"http://a.net/{i}", f"<div><p>Long story body</p><p>second part</p></div><div>Viewed {i} times</div>") for i in range(12)]
    rows += [(f"http://b.net/{i}", f"<article><h1>T</h1><div><p>Long story body</p></div><p>Printed on day {i}</p></article>") for i in range(12)]
    rows += [(f"http://c.net/{i}", f"<article><p>Case {i}</p><div><table><tr><td>Verdict<td>guilty</table></div><div>Read on</div></article>") for i in range(12)]
    got = {r.url: r.text for r in H.extract(frame(spark, rows)).collect()}
    for i in range(12):
        assert got[f"http://a.net/{i}"] == f"Long story body\nsecond part\nViewed {i} times"
        assert got[f"http://b.net/{i}"] == f"T\nLong story body\nPrinted on day {i}"
        assert got[f"http://c.net/{i}"] == f"Case {i}\nVerdict\nguilty"


def test_template_rule_against_brute_force(spark):
    """Hashes beside at least 10 stories of a host, and the square root of all of them, counted in plain Python."""
    import random
    rng = random.Random(3)
    boxes = [f"<div><p>Box {b}</p></div>" for b in range(8)]
    rows = []
    for i in range(400):
        host = rng.choice(["a.net", "a.net", "a.net", "b.net", "c.net"])
        story = rng.randrange(150)
        rows.append((f"http://{host}/{i}", f"<article><h1>Title {story}</h1><p>Story {story}</p></article>"
                     + "".join(b for n, b in enumerate(boxes) if rng.random() < 0.6 / (n + 1))))
    rows += rows[:20]
    beside, stories = {}, {}
    for url, html in rows:
        host, page = url.split("/")[2], H.Page(html)
        stories.setdefault(host, set()).add(page.story())
        for own in page.hashes:
            beside.setdefault((host, own), set()).add(page.story())
    known = {k for k, s in beside.items() if len(s) >= 10 and len(s) >= len(stories[k[0]]) ** 0.5}
    assert 0 < len(known) < len(beside)
    got = H.extract(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for row in got:  # the row's place is its id, and repeated rows have their own
        host, html = row.url.split("/")[2], rows[row.page_id][1]
        mine = {own for own in H.Page(html).hashes if (host, own) in known}
        assert row.text == H.Page(html, frozenset(mine)).text() and row.n_templates == len(mine)


def test_no_pages(spark):
    assert H.extract(frame(spark, [])).isEmpty()


def test_real_pages_give_their_article(table):
    """The generated pages' blocks are paragraphs and headings of one article."""
    import html
    import re
    pages = table("pages")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[row.page_id] == "\n".join(b for b in blocks if b)
