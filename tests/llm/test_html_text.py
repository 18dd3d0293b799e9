import random

import pytest

from quillmill.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a>b">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Caf&eacute; &amp; bar</h1><p>One <b>two</b>
 three.<br>Next<p>A &lt; b &#233;<div class="share-box">Share</div><ul><li>x<li>y</ul><form>Mail<input></form>
<section id="comments"><p>First!</p></section><!-- hid --></article><aside>Side</aside><div class="ad">Buy</div><footer>&copy;</footer></body></html>"""


@pytest.mark.parametrize("page,want", [
    (PAGE, "Café & bar\nOne two three.\nNext\nA < b é\nx\ny"),
    ("", ""),
    ("plain  text", "plain text"),
    ("<p>a<p>b", "a\nb"),
    ("<div>in<span>li</span>ne <i>x</i></div>tail", "inline x\ntail"),
    ("<p>a < b && c", "a < b && c"),
    ("<article><p><b>x.<br><p>y</b></p></article>after", "x.\ny"),
    ("<p title='a>b'>q</p><p class=\"", "q"),
    ("<main><header>T</header><p>a</p></main>", "T\na"),
])
def test_extract(page, want):
    assert html_text.extract(page)[0] == want


@pytest.mark.parametrize("attribute", ["class='content with-sidebar'", "class=no-sidebar", "class='post comments-enabled'", "class=article-share-wrapper", "id=related-work", "class=sidebar", "id=comments"])
@pytest.mark.parametrize("inner", ["<article><p>Text</p></article>", "<main><p>Text</p></main>", "<h1>Text</h1>"])
def test_what_holds_the_text_stays(attribute, inner):
    assert html_text.extract(f"<body><div class=nav>Menu</div><div {attribute}><section {attribute}>{inner}</section></div></body>")[0] == "Text"


@pytest.mark.parametrize("page,want", [
    ("<p>a</p><div class='no-sidebar'><p>b</p></div><div id='related-work'><p>c</p></div>", "a\nb\nc"),
    ("<p>a</p><div class='left-sidebar'>x</div><div class='share-wrapper'>y</div><div class='x comments'>z</div><div class='menu-item'>w</div>", "a"),
    ("<article><p>Post</p><div class='comments'><article>First!</article></div></article><div class='related'><article>Card, longer than the post</article></div>", "Post"),
    ("<main><p>A post without an article</p><div class='comments'><article>First!</article></div></main>", "A post without an article"),
    ("<article><div class='entry-header'><h2>T</h2></div><p>b</p></article>", "T\nb"),
    ("<article><div class='article-header'><h1>Title</h1></div><p class='notice period'>Notice text.</p><div class='alert'>Mind</div><p>Body</p><div class='share'>Share</div></article>", "Title\nNotice text.\nMind\nBody"),
    ("<form id=aspnetForm><article>a</article></form>", "a"),
    ("<div hidden><h1>no</h1></div><p>a</p>", "a"),
])
def test_furniture_by_whole_tokens(page, want):
    assert html_text.extract(page)[0] == want


def test_deep_and_long_pages():
    assert html_text.extract("<div>" * 20_000 + "x", {1})[0] == "x"
    assert len(html_text.extract("<p>word " * 100_000)[0]) == 500_000 - 1


@pytest.mark.parametrize("most", [500_000, 0])
def test_templates_of_a_host_go_and_copies_stay(spark, most, monkeypatch):
    monkeypatch.setattr(html_text, "TABLE", most)
    bar = "<div class='x'><p>Read more stories</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{bar}<p>Story {i}</p><p>Tail</p></body>") for i in range(8)]
    rows += [(100 + i, f"http://b.example/{i}", "<article><p>Same story</p></article>") for i in range(9)]
    rows += [(200, "http://c.example/", f"{bar}<p>z</p>"), (201, None, None), (202, "no host", "<p>q"), (203, "http://c.example/", "")]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, html string, host string, templates string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).collect())
    want = [(i, f"Story {i}", 7) for i in [0, *range(8)]] + [(100 + i, "Same story", 10) for i in range(9)]
    want += [(200, "Read more stories\nz", 19), (201, "", 0), (202, "q", 1), (203, "", 0)]
    assert got == want
    assert html_text.main_text(df.limit(0)).count() == 0


def test_near_copies_make_no_template(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randint(0, 9_999)}" for _ in range(n)]
    page = lambda title, ps, bar="": f"<article><h1>{title}</h1>{bar}" + "".join(f"<p>{' '.join(p)}</p>" for p in ps) + "</article>"
    text = lambda title, ps: "\n".join([title, *(" ".join(p) for p in ps)])
    rows, want = [], {}

    def add(host, title, ps, bar=""):
        rows.append((len(rows), f"http://{host}.example/{len(rows)}", page(title, ps, bar)))
        want[len(rows) - 1] = text(title, ps)

    for host, copies, others in (("few", 5, 3), ("hot", 200, 20)):  # one word changed, in any paragraph
        story = [prose(30) for _ in range(6)]
        for i in range(copies):
            ps = [list(p) for p in story]
            ps[i % 6][i % 30] = f"changed{i}"
            add(host, "Story", ps)
        for i in range(others):
            add(host, f"Other {i}", [prose(40)])
    for i in range(30):  # a bar on a third of the pages goes; a recurring inline word stays
        add("bars", f"Title {i}", [[*prose(20), "<b>always</b>", *prose(9)]], "<div><p>More from this section</p></div>" if i % 3 == 0 else "")
    want = {k: v.replace("<b>", "").replace("</b>", "") for k, v in want.items()}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == want


def counted(pages, share=0.25, least=5):
    """Templates by brute force: hashes in that share of the different texts of a host."""
    by = {}
    for host, html in pages:
        main, hashes, _ = html_text.subtrees(html)
        by.setdefault(host, {}).setdefault(main, set()).update(hashes)
    out = set()
    for host, texts in by.items():
        n = {}
        for hashes in texts.values():
            for h in hashes:
                n[h] = n.get(h, 0) + 1
        out |= {(host, h) for h, k in n.items() if k >= least and k >= share * len(texts)}
    return out


def test_templates_equal_brute_force_and_see_shapes(spark):
    """Menus, adverts and footers whose words differ on every page are templates by shape; classes tell nothing here."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 99_999)}"
    rows, want = [], {}
    for i in range(60):
        body = [" ".join(word() for _ in range(40)) for _ in range(3)]
        links = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(rng.randint(3, 8)))
        html = f"<body><div class='q7'><ul>{links}</ul></div><div class='k{i}'>{word()} {word()}</div><article><h1>{word()}</h1>{''.join(f'<p>{b}</p>' for b in body)}</article><div class='z'>{word()} <b>{word()}</b></div></body>"
        rows.append((f"h{i % 3}.example", html))
        want[i] = body
    df = spark.createDataFrame(rows, "host string, html string")
    got = {(r.host, r.hash) for r in html_text.site_templates(df).collect()}
    assert got == counted(rows) and len(got) == 9  # three shapes on each of three hosts
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(rows)], "page_id long, url string, html string")
    out = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert all(out[i].text.split("\n")[1:] == want[i] and out[i].n_templates == 3 for i in want)


def many(spark, page, n=30, host="big"):
    return spark.createDataFrame([(i, f"http://{host}.example/{i}", page(i)) for i in range(n)], "page_id long, url string, html string")


def test_templates_decide_on_hosts_with_enough_texts(spark, monkeypatch):
    """Furniture without any class that tells it, beside and inside the article, goes by the counts alone: with the templates
    off, it stays."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randint(0, 99_999)}" for _ in range(n))
    body = {i: (prose(3), prose(40), prose(30)) for i in range(30)}
    page = lambda i: (
        f"<body><div class=q1>{prose(4)}</div><section><div>{prose(3)} <a href=/x>{prose(2)}</a></div><p>Fixed line</p></section>"
        f"<article><h1>{body[i][0]}</h1><p>{body[i][1]}</p><div><p>More stories</p></div><div class=z4><ul><li><a href=/{i}>{prose(3)}</a></ul></div><p>{body[i][2]}</p></article><div>{prose(9)}</div></body>"
    )
    pages = many(spark, page)
    want = {i: "\n".join(b) for i, b in body.items()}
    out = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert {i: r.text for i, r in out.items()} == want and {r.n_templates for r in out.values()} == {5}
    off = {r.page_id: r.text for r in html_text.main_text(pages, share=99).collect()}
    assert all(off[i] != want[i] and "More stories" in off[i] and "Fixed line" in off[i] for i in want)


def test_class_words_inside_articles_stay_where_counts_decide(spark):
    """What a class names as furniture goes only if it recurs; a single page's block of that class is text."""
    rng = random.Random(7)
    prose = lambda n: " ".join(f"w{rng.randint(0, 99_999)}" for _ in range(n))
    body = {i: (prose(30), prose(25)) for i in range(20)}
    odd = {3: "<div class='share'>Market share rose</div>", 4: "<table class='comments'><tr><td>12<td>40</table>"}
    share = lambda i: f"<div class='share'><a href=/{i}>{prose(2)}</a> <span>{prose(1)}</span></div>"
    page = lambda i: f"<nav>{prose(5)}</nav><article><h1>T {i}</h1><p>{body[i][0]}</p>{odd.get(i, '')}{share(i) if i > 4 else ''}<p>{body[i][1]}</p></article>"
    told = {3: ["Market share rose"], 4: ["12", "40"]}
    out = {r.page_id: r.text for r in html_text.main_text(many(spark, page, 20)).collect()}
    assert out == {i: "\n".join([f"T {i}", body[i][0], *told.get(i, []), body[i][1]]) for i in body}
    small = {r.page_id: r.text for r in html_text.main_text(many(spark, page, 4)).collect()}
    assert small[3] == f"T 3\n{body[3][0]}\n{body[3][1]}"  # four texts: rules by markup


def test_odd_furniture_of_one_page_goes_and_large_parts_stay(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randint(0, 99_999)}" for _ in range(n))
    body, part = {i: prose(200) for i in range(12)}, prose(150)
    extra = {5: "<div><div><b>Win now</b></div></div>", 6: f"<div><div><i>{part}</i></div></div>"}
    page = lambda i: f"<div class=m><ul><li>{prose(2)}</ul></div><article><p>{body[i]}</p></article>{extra.get(i, '')}"
    out = {r.page_id: r.text for r in html_text.main_text(many(spark, page, 12)).collect()}
    assert out == {i: body[i] + (f"\n{part}" if i == 6 else "") for i in body}
