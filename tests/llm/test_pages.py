import itertools
import os
import random
from html import escape

from msgspark.llm.markup import lines
from msgspark.llm.page_text import common_lines, host_and_path, main_text

MENU = "<ul><li><a href='/'>Home</a></li><li>About us</li></ul>"


def page(body, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style></head><body>{before}{body}{after}</body></html>"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, text string, host string")


def texts(spark, rows):
    return {r.page_id: r.text for r in main_text(frame(spark, rows)).collect()}


def test_article_of_a_marked_page(spark):
    html = page(
        "<article><h1>Title &amp; more</h1><p>One <b>bold</b>\n text.<br>same block<p>Two &lt;tag&gt;"
        "<form><p>Your mail</p></form><div class='comments'><p>First!</p></div></article>",
        before=f"<nav>{MENU}</nav><div class=ad>Buy</div><script>var t='</p><p>no</p>';</script><!-- <p>no</p> -->",
        after="<aside>See also</aside><footer>&copy; me",
    )
    got = texts(spark, [(1, "http://a.example/x", html)])
    assert got[1] == "Title & more\nOne bold text. same block\nTwo <tag>"


def test_lines_shared_with_the_nearest_page_go(spark):
    rows = [
        (k, f"http://Host.example:80/en/{k}.html?x=1", page(f"<div>Site name</div><div>Own story {k}</div><div>tail {k}</div><div>All rights</div>"))
        for k in range(6)
    ]
    rows += [(10, "http://other.example/en/1", page("<div>Site name</div><div>alone</div>"))]
    got = texts(spark, rows)
    assert all(got[k] == f"Own story {k}\ntail {k}" for k in range(6))
    assert got[10] == "Site name\nalone"


def test_versions_of_a_page_do_not_delete_each_other(spark):
    story = "".join(f"<div>sentence {k} of the story</div>" for k in range(8))
    got = texts(spark, [(1, "http://h/a", page(story)), (2, "http://h/a?p=2", page(story)), (2, "http://h/a?p=2", page(story))])
    assert got[1] == got[2] == "\n".join(f"sentence {k} of the story" for k in range(8))


def test_running_text_of_an_article_stays(spark):
    rows = [(k, f"http://h/{k}", page(f"<main><p>Shared opening.</p><div>Share this</div><p>Own {k} words here.</p></main>")) for k in range(3)]
    got = texts(spark, rows)
    assert all(got[k] == f"Shared opening.\nOwn {k} words here." for k in range(3))


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (None, "http://h/1", "<p>no id"), (4, "::bad::", "plain text &am"),
        (5, "http://h/2", "<p" + "x" * 5000), (6, "http://h/3", "<div>" * 3000 + "deep" + "</div>" * 10), (7, "http://h/4", "<p>" + "long " * 50_000),
        (7, "http://h/4", "<p>" + "long " * 50_000),
    ]
    got = main_text(frame(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == 8 and all(r.n_chars == len(r.text) for r in rows)
    by = {r.page_id: r.text for r in rows}
    assert (by[1], by[2], by[None], by[4], by[6]) == ("", "", "no id", "plain text &am", "deep")
    assert main_text(frame(spark, [])).collect() == []


def test_common_lines_are_a_longest_common_subsequence():
    draw = random.Random(4)
    for _ in range(200):
        a = [draw.randrange(4) for _ in range(draw.randrange(9))]
        b = [draw.randrange(4) for _ in range(draw.randrange(9))]
        got = common_lines(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got) and got == sorted(set(got))
        best = max(
            n for n in range(len(a) + 1)
            if any(all(x in it for x in c) for c in itertools.combinations(a, n) for it in [iter(b)])
        )
        assert len(got) == best


def test_urls_and_blocks():
    assert host_and_path("https://User@WWW.Example.com:8080/a/b?c#d") == ("www.example.com", "/a/b")
    assert host_and_path("nothing") == ("", "nothing")
    got = lines("<ul><li>a<li>b</ul><p class='x cookieBanner'>c</p>d<td>e")
    assert [(x.text, x.furniture) for x in got] == [("a", False), ("b", False), ("c", True), ("d", False), ("e", False)]


def test_an_article_in_a_wrapper_with_a_furniture_name_stays(spark):
    wrappers = [
        "class='site-content no-sidebar'", "class='with-sidebar'", "id='page' class='hasBanner'", "class='sidebar'",
        "class='comments-open'", "class='menu-left social'",
    ]
    rows = [(k, f"http://h{k}/", page(f"<div {w}><article><p>Own {k}</p></article></div>")) for k, w in enumerate(wrappers)]
    rows += [(10 + k, f"http://m{k}/", page(f"<div {w}><div><main><p>Own {k}</p></main></div></div>")) for k, w in enumerate(wrappers)]
    rows += [(20, "http://c/", page("<article class='post comments-open reply-allowed'><p>Own</p></article>"))]
    rows += [(21, "http://d/", page("<div class='content no-sidebar'><p>Own</p></div>"))]
    got = texts(spark, rows)
    assert all(got[k] == got[10 + k] == f"Own {k}" for k in range(len(wrappers)))
    assert got[20] == got[21] == "Own"


def test_sections_of_an_article_are_no_furniture(spark):
    body = (
        "<article><p>Start.</p><section id='discussion'><h2 id='related-work'>Related</h2><p>Said.</p></section>"
        "<div class='social-history'><p>History.</p></div><h2 id='recommendations'>Advice</h2>"
        "<div class='ad'><p>Buy</p></div><div id='comments'><p>First!</p></div></article>"
    )
    got = texts(spark, [(1, "http://h/1", page(body))])
    assert got[1] == "Start.\nRelated\nSaid.\nHistory.\nAdvice"


def test_parts_named_like_furniture_go_only_where_the_nearest_page_has_them(spark):
    def body(k):
        return (
            f"<article><p>We know <math><mi>x</mi><mo>=</mo><mn>{k}</mn></math> holds.</p><aside><p>Quote {k}.</p></aside>"
            f"<aside><p>Also read this.</p></aside><section class='social'><p>Society {k}.</p></section>"
            f"<div class='widget'><p>Follow us</p></div><div class='widget'><p>Part {k}</p></div>"
            f"<div class='ad'><p>Buy {k}</p></div><p>End {k}.</p></article>"
        )

    rows = [(k, f"http://h/{k}", page(body(k))) for k in range(4)] + [(9, "http://alone/", page(body(9)))]
    got = texts(spark, rows)
    for k in range(4):
        assert got[k] == f"We know x={k} holds.\nQuote {k}.\nSociety {k}.\nPart {k}\nEnd {k}."
    assert got[9] == "We know x=9 holds.\nQuote 9.\nAlso read this.\nSociety 9.\nFollow us\nPart 9\nEnd 9."


def plain_text(rows):
    """The same by quadratic tables over whole lines, page by page."""
    own = {}
    order = sorted({(host_and_path(u), i, u, h) for i, u, h in rows})
    for n, ((host, path), i, u, h) in enumerate(order):
        mine = lines(h)
        near = [order[k] for k in (n - 1, n + 1) if 0 <= k < len(order) and order[k][0][0] == host]
        common = lambda other: len(os.path.commonprefix([path, other[0][1]]))
        gone = set()
        for other in sorted(near, key=lambda x: -common(x)):
            a, b = [x.text for x in mine], [x.text for x in lines(other[3])]
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for x in range(len(a) - 1, -1, -1):
                for y in range(len(b) - 1, -1, -1):
                    best[x][y] = 1 + best[x + 1][y + 1] if a[x] == b[y] else max(best[x + 1][y], best[x][y + 1])
            x = y = 0
            both = set()
            while x < len(a) and y < len(b):
                if a[x] == b[y]:
                    both.add(x)
                    x, y = x + 1, y + 1
                elif best[x + 1][y] >= best[x][y + 1]:
                    x += 1
                else:
                    y += 1
            if sum(len(a[k]) for k in both) <= 0.8 * sum(map(len, a)):
                gone = both
                break
        kept = [
            x for k, x in enumerate(mine)
            if not x.furniture and not (k in gone and (x.loose or not (x.main and x.prose)))
        ]
        kept = [x for x in kept if x.main] or kept
        own[i, u, h] = "\n".join(x.text for x in kept)
    return {i: own[i, u, h] for i, u, h in rows}


def test_given_pages_against_quadratic_alignment(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").limit(100)
    rows = [tuple(r) for r in pages.collect()]
    assert texts(spark, rows) == plain_text(rows)
    # the same texts without what marks the article, beside lines that the pages of a host share
    bare = []
    for i, u, h in rows:
        story = "".join(f"<div>{escape(x.text)} {i}</div>" for x in lines(h) if x.main)
        bare.append((i, u, page(f"<div>Front</div><div>Topics</div>{story}<div>Imprint</div>")))
    got = texts(spark, bare)
    assert got == plain_text(bare)
    deleted = sum(3 - sum(t in got[i].split("\n") for t in ("Front", "Topics", "Imprint")) for i, _, _ in bare)
    assert deleted > 0


def test_articles_of_sidebars_and_comments_go(spark):
    after = (
        "<div class='sidebar'><article><p>Teaser</p></article></div><aside><article><p>Other</p></article></aside>"
        "<div class='comments-area'><article><p>Me too</p></article></div>"
        "<ol class='commentlist'><li><article class='comment-body'><p>First!</p></article></li></ol>"
    )
    got = texts(spark, [(1, "http://h/1", page("<article><p>Own.</p></article>", after=after))])
    assert got[1] == "Own."
