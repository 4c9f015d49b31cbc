import html as entities
import re

import numpy as np

from shopgrain.llm import html as H


def test_blocks_of_broken_pages():
    assert H.blocks("") == [] and H.blocks("<p") == []
    assert H.blocks("plain &amp; text\n here") == [(H.OPEN, ["plain", "&", "text", "here"])]
    assert H.blocks("<article><p>a<b>b</b> c<br>d<p>e</article>") == [(H.TEXT, ["ab", "c", "d"]), (H.TEXT, ["e"])]
    assert H.blocks("<main><h1>x</h1><div class='ad-box'>buy</div><script>var t='</p>';</script>y<!-- z --></main>") == [(H.TEXT, ["x"]), (H.DROP, ["buy"]), (H.TEXT, ["y"])]
    assert [s for s, _ in H.blocks("<nav><a>m</a></nav><header>h</header><article><header>t</header></article>")] == [H.DROP, H.DROP, H.TEXT]
    assert H.blocks('<div title="a>b">t</div><section id=comments>c</section>') == [(H.OPEN, ["t"]), (H.DROP, ["c"])]
    assert H.blocks("<p>" * 50_000 + "x")[-1] == (H.OPEN, ["x"])


def test_repeated_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        streams = [rng.integers(0, 3, rng.integers(0, 30)) for _ in range(5)]
        pages = np.array([1, 1, 2, 3, 4])
        got = H.repeated(streams, pages, 4)
        for i, s in enumerate(streams):
            want = np.zeros(len(s), bool)
            for a in range(len(s) - 3):
                g = tuple(s[a : a + 4])
                if any(pages[j] != pages[i] and any(tuple(o[b : b + 4]) == g for b in range(len(o) - 3)) for j, o in enumerate(streams)):
                    want[a : a + 4] = True
            assert (got[i] == want).all()


def test_host_boilerplate(spark):
    notice = "<div>this host keeps some data about each of its visitors</div>"
    rows = [(i, f"http://one.example/{i}", f"<body>{notice}<div>page {i} {chr(97 + i) * 5} own {i * i}</div></body>") for i in range(5)]
    rows += [(5, "http://two.example/", f"<body>{notice}</body>"), (6, None, None), (None, "http://one.example/x", ""), (7, "http://one.example/7", rows[0][2]), (7, "http://one.example/7", rows[0][2])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    for chunk in (1000, 10**6):
        got = {(r.page_id, r.url): r.text for r in H.main_texts(docs, chunk).collect()}
        assert got[3, "http://one.example/3"] == "page 3 ddddd own 9"
        assert got[5, "http://two.example/"].startswith("this host keeps")  # nothing repeats on that host
        assert got[6, None] == "" and got[None, "http://one.example/x"] == ""
    assert H.main_texts(docs).count() == len(rows) and H.main_texts(docs.limit(0)).count() == 0


def test_given_pages(spark, sf):
    got = {r.page_id: r for r in H.op6_host_suffix_array(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id].text == "\n\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_text_does_not_depend_on_chunks(spark):
    """Notices on two pages each, on all pages and on one, in a host of many chunks."""
    def note(k):
        return f"<div>notice {k} about n{k} things that k{k} readers of it should know</div>"

    rows = [(i, f"http://one.example/{i}", f"<body>{note('all')}{note(i // 2)}<div>page {i} alone has w{i}</div>{note(f'once{i}') if i == 7 else ''}</body>") for i in range(40)]
    rows += [(i, None, f"<body>{note(i % 20)}<p>loose {i}</p></body>") for i in range(100, 140)] + [(200, "http://two.example/", f"<body>{note(3)}</body>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    dealt, whole = ({r.page_id: r.text for r in H.main_texts(docs, chunk).collect()} for chunk in (2, 10**6))
    assert dealt == whole
    assert dealt[8] == "page 8 alone has w8" and dealt[100] == "loose 100" and dealt[7].startswith("page 7 alone has w7\n\nnotice once7") and dealt[200].startswith("notice 3 about")


def kept(page):
    return [" ".join(w) for s, w in H.blocks(page) if s != H.DROP]


def test_wrappers_with_marking_words_do_not_lose_the_article():
    article = "<article><p>the text</p></article>"
    assert kept(f'<div class="content has-sidebar">{article}</div>') == ["the text"]
    assert kept(f'<form id="aspnetForm"><div class="ad-slot">buy</div><label>q</label><main><p>the text</p></main></form>') == ["the text"]
    assert kept(f'<div class="newsletter-archive-layout">x{article}</div>') == ["the text"]
    assert kept(f'<div class="sidebar">{article}</div><nav>{article}</nav><div hidden>{article}</div>') == []
    assert kept('<ol class="comment-list"><li class="comment"><article class="comment-body"><p>me too</p></article></li></ol>') == []


def test_prose_of_an_article_is_not_taken_by_its_class_names():
    page = (
        '<article><h1 class="entry-header">Title</h1><p class="notice">careful</p><blockquote id="related-work">so it was</blockquote>'
        '<section id="menu-engineering"><p>dishes</p></section><aside>beside</aside><aside class="sidebar">links</aside><div class="share-bar">tell others</div><form>mail<p>us</p></form></article>'
    )
    assert kept(page) == ["Title", "careful", "so it was", "dishes", "beside"]


def test_comments_under_a_heading_go_until_their_part_ends():
    page = "<main><h2>News</h2><p>a</p><div><h3>Reader comments</h3><p>one</p><h4>Ann</h4><p>two</p></div><p>b</p><h3>3 Comments</h3><p>three</p><h2>More</h2><p>c comments</p></main>"
    assert kept(page) == ["News", "a", "b", "More", "c comments"]
    assert kept("<main><h2>Comments on the law</h2><p>stay</p></main>") == ["Comments on the law", "stay"]


def test_articles_are_evidence_and_stay(spark):
    """An open block that repeats another page's article goes, the article stays, in one array and in chunks."""
    text = [f"story {i} tells how k{i} came to the town of v{i} last year" for i in range(12)]
    rows = [(i, f"http://one.example/{i}", f"<body><div>read next: {text[(i + 1) % 12]}</div><article><p>{text[i]}</p></article><div>seen {i} by w{i}</div></body>") for i in range(12)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (2, 10**6):
        got = {r.page_id: r.text for r in H.main_texts(docs, chunk).collect()}
        assert got == {i: f"read next:\n\n{text[i]}\n\nseen {i} by w{i}" for i in range(12)}
