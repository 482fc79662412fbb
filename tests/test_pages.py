"""Field extraction on broken HTML."""
from forumlens.sources import pages as P

HTML = ('<html lang="ja"><head><title>A &amp; B</title><script>var t="</p><a href=\'x\'>";</script>'
        '<style>p{}</style></head><body><!-- <a href="/hidden">h</a> --><nav><a href="/one">One</a>'
        '<a href="/two"><b>Two</b></a></nav><article><h1>Head</h1><p><b>Lead</b> text<br><p>second'
        '</article></body></html>')
NO_TITLE = '<html><body><article><h1>Only h1</h1></article></body></html>'


def test_fields_first_selector_wins(spark):
    df = spark.createDataFrame([(1, HTML), (2, NO_TITLE)], "page_id long, html string")
    got = {r.page_id: r for r in P.extract_fields(df).collect()}
    assert got[1].title == "A & B" and got[1].lang == "ja"
    assert got[1].lead == "Lead text" and got[1].first_link == "/one"
    assert got[2].title == "Only h1" and got[2].lang is None and got[2].first_link is None


def test_links_with_positions(spark):
    df = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    got = [(r.position, r.href, r.text) for r in P.section_links(df).orderBy("position").collect()]
    assert got == [(0, "/one", "One"), (1, "/two", "Two")]


def test_frontier_parameters(spark):
    df = spark.createDataFrame([(1, "http://a.example/x?page=9&ref=z&blank=#top"), (2, "https://b.example/y")],
                               "page_id long, url string")
    got = {(r.page_id, r.page, r.order): r.target_url for r in P.frontier(df, 1).collect()}
    assert got[(1, 1, "newer")] == "http://a.example/x?page=1&ref=z&order=newer#top"
    assert got[(2, 1, "recommended")] == "https://b.example/y?order=recommended&page=1"


def test_ranking_and_comment_targets(spark):
    from forumlens.sources.pages import comment_targets, ranking_targets

    genres = spark.createDataFrame([("sports",), ("sports",), (None,), ("",)], "g string")
    got = sorted(r.target_url for r in ranking_targets(genres, "g", ("u/a", "u/b")).collect())
    assert got == ["u/a", "u/a/sports", "u/b", "u/b/sports"]
    articles = spark.createDataFrame([(1, "u/x"), (2, None)], "article_id long, article_link string")
    assert [r.target_url for r in comment_targets(articles).orderBy("article_id").collect()] == ["u/x/comments", None]
