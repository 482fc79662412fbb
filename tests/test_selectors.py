"""Selector paths on nested and badly closed pages."""
import time

import pytest

from forumlens.sources.selectors import Page, fields_by_path, items_by_path

THREAD = """<!DOCTYPE html><html lang=ja><body><nav><a href='/a?x=1&amp;y=2' class="k">A &lt;b&gt;</a></nav>
<script>var t = "</ul><p>no text</p>";</script><!-- <p>no</p> -->
<ul id="comments">
 <li class="c top"><div><div><p>one <b>bold<p>second</div> tail</div>
   <ul class=replies><li class="c"><p>reply 1<li class="c"><p>reply 2</p></ul>
 <li class='c'><p>two</i></p><a href="/u/2">user 2</a>
 <li class="ad"><p>buy
</ul><div id=foot><table><tr><td>1</div><td>2<tr><td>3</table>end</div></body></html>"""


def _texts(path, start=-1, page=None):
    page = page or Page(THREAD)
    return [page.text(i).strip() for i in page.select(path, start)]


def test_structure_of_badly_closed_parts():
    assert _texts('//ul[@id="comments"]/li/p') == ["two", "buy"]
    assert _texts('//ul[@id="comments"]/li[1]/div/div/p') == ["one bold", "second"]
    assert _texts('//ul[@class="replies"]/li/p') == ["reply 1", "reply 2"]
    assert _texts('//li[contains(@class, "c")]//a') == ["user 2"]
    assert _texts('//div[@id="foot"]//td') == ["1", "2", "3"]       # </div> in a cell ends nothing outside
    assert _texts('//tr[2]/td[1]') == ["3"] and _texts("//tr/td[2]") == ["2"]
    assert _texts('/html/body/div')[0].endswith("end")
    assert _texts("//*[@lang]")[0].startswith("A <b>")
    assert not any("no" == t[:2] for t in _texts("//p"))


def test_conditions_are_counted_in_their_order():
    page = Page('<a class="x">1</a><a>2</a><a class="x">3</a>')
    assert _texts('//a[@class="x"][2]', page=page) == ["3"]
    assert _texts('//a[2][@class="x"]', page=page) == []
    assert _texts("/a[3]", page=page) == ["3"]


def test_entities_need_their_semicolon():
    page = Page('<a href="?a=1&copy=2&amp;b=&#51;">1 &amp 2 &copy; &#x41; &none; &#1234567;</a>')
    assert page.first(["//a/@href"]) == "?a=1&copy=2&b=3"
    assert page.first(["//a"]).startswith("1 &amp 2 \u00a9 A &none; ")


@pytest.mark.parametrize("path", ["a", "//", "//a[", "//a[last()]", "//a[@b=c]", "//a/@href/b"])
def test_a_path_that_is_none_raises(path):
    with pytest.raises(ValueError):
        Page("<a>").select(path)


@pytest.mark.parametrize("text", ["", "<", "<a", "<a href=\"", "</p></p>", "<!--", "<script>", "a < b > c", "<![if x]>t"])
def test_scraps(text):
    assert Page(text).first(["//p", "//a"]) is None


def test_long_pages_take_linear_time():
    for text in ("<p>x" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<div><p>" * 20_000, "<a \"" * 5_000, "<" * 200_000):
        t = time.time()
        page = Page(text)
        page.first(["//article//p", "//x"])
        assert time.time() - t < 10


def test_fields_and_items(spark):
    pages = spark.createDataFrame([(1, THREAD, "x"), (2, None, "x"), (3, "", "x"), (None, THREAD, "x"), (1, THREAD, "x")],
                                  "page_id long, html string, title string")
    spec = {"title": ["//title", "//nav/a"], "user_link": ["//li[9]//a/@href", "//li//a/@href"], "lang": ["/html/@lang"]}
    got = sorted(map(tuple, fields_by_path(pages, spec).collect()), key=str)
    hit = ("A <b>", "/u/2", "ja")
    assert got == sorted([(1, *hit), (2, None, None, None), (3, None, None, None), (None, *hit), (1, *hit)], key=str)
    items = items_by_path(pages.where("page_id IS NULL"), '//li[contains(@class, "c")]',
                          {"text": ["/p", "/div/div/p"], "reply": ["//ul//p"], "kind": ["/@class"]})
    assert sorted(map(tuple, items.collect()), key=lambda r: r[1]) == [
        (None, 0, "one bold", "reply 1", "c top"), (None, 1, "reply 1", None, "c"),
        (None, 2, "reply 2", None, "c"), (None, 3, "two", None, "c")]
    assert items_by_path(pages.limit(0), "//li", {"t": ["/p"]}).count() == 0
    assert fields_by_path(pages.limit(0), spec).columns == ["page_id", *spec]
