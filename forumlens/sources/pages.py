"""Field extraction from raw page HTML, link lists, crawl frontier and archive names.

Pages are not well-formed (unclosed tags, ``</p>`` inside script text), so script,
style and comment blocks are removed first and fields are taken with regular
expressions written to mean the same in Java and RE2 (no look-around, no
back-references). Every step is a column expression over the ``pages`` table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blocks removed before extraction.
NOISE = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
# Characters not allowed in archive file names, and the default name.
FORBIDDEN_FILENAME = r'[\\/*?:"<>|]'
DEFAULT_TITLE = "default_title"
# Accepted listing orders for the frontier.
VALID_ORDERS = ("newer", "recommended")

# Selector specs: field -> ordered patterns, the first non-empty match wins.
# Fields ending in ``_link`` capture an href, the others a text.
PAGE_FIELDS = {
    "title": [r"(?s)<title[^>]*>(.*?)</title>", r"(?s)<h1[^>]*>(.*?)</h1>"],
    "lang": [r"<html[^>]*\slang=\"([^\"]*)\""],
    "lead": [r"(?s)<article[^>]*>.*?<p[^>]*>(.*?)(?:</p>|<p[ >]|</article>)"],
    "first_link": [r"(?s)<body[^>]*>.*?<a[^>]*\shref=\"([^\"]*)\""],
}


def clean_html(html) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(h, NOISE, "")


def unescape(text: Column) -> Column:
    """The five basic HTML entities, ``&amp;`` last."""
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ent), F.lit(ch))
    return text


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]*>", ""))


def field(clean: Column, patterns: list[str], is_link: bool) -> Column:
    """First selector with a non-empty result; NULL when none matches."""
    hits = []
    for p in patterns:
        raw = F.regexp_extract(clean, p, 1)
        value = raw if is_link else unescape(strip_tags(raw))
        hits.append(F.nullif(value, F.lit("")))
    return F.coalesce(*hits)


def extract_fields(pages: DataFrame, spec: dict[str, list[str]] | None = None,
                   html: str = "html", keep=("page_id",)) -> DataFrame:
    """One column per spec field, extracted from each page."""
    spec = spec or PAGE_FIELDS
    clean = clean_html(html)
    return pages.select(*keep, *[field(clean, pats, name.endswith("_link")).alias(name)
                                 for name, pats in spec.items()])


NAV = r"(?s)<nav[^>]*>(.*?)</nav>"
ANCHOR = r"(?s)<a[^>]*\shref=\"([^\"]*)\"[^>]*>(.*?)</a>"


def section_links(pages: DataFrame, section: str = NAV, html: str = "html") -> DataFrame:
    """Repeated items to rows: one row per link of a page section with its
    0-based position, text and href (A04)."""
    sec = F.regexp_extract(clean_html(html), section, 1)
    items = F.arrays_zip(F.regexp_extract_all(sec, F.lit(ANCHOR), 1).alias("href"),
                         F.regexp_extract_all(sec, F.lit(ANCHOR), 2).alias("text"))
    return (pages.select("page_id", F.posexplode(items).alias("position", "item"))
                 .select("page_id", "position", F.col("item.href").alias("href"),
                         unescape(strip_tags(F.col("item.text"))).alias("text")))


URL_PARTS = r"^([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"


def _set_param(params: Column, key: str, value: Column) -> Column:
    """Replace ``key`` in a list of 'k=v' strings, or append it."""
    is_key = lambda x: F.substring_index(x, "=", 1) == key
    pair = F.concat(F.lit(key + "="), value)
    return F.when(F.exists(params, is_key), F.transform(params, lambda x: F.when(is_key(x), pair).otherwise(x))) \
            .otherwise(F.concat(params, F.array(pair)))


def with_page_params(url: Column, page: Column, order: Column) -> Column:
    """URL with ``order`` (only 'newer' / 'recommended') and ``page`` (only a
    positive integer) set; invalid values leave the parameter as it was, other
    parameters are kept in place (blank ones are dropped), the fragment is kept."""
    base = F.regexp_extract(url, URL_PARTS, 1)
    query = F.regexp_extract(url, URL_PARTS, 2)
    frag = F.regexp_extract(url, URL_PARTS, 3)
    params = F.filter(F.split(query, "&"), lambda x: x.rlike("^[^=]+=.+"))
    valid_order = order.isin(*VALID_ORDERS)
    params = F.when(valid_order, _set_param(params, "order", order)).otherwise(params)
    params = F.when(page > 0, _set_param(params, "page", page.cast("string"))).otherwise(params)
    q = F.array_join(params, "&")
    return F.concat(base, F.when(F.size(params) > 0, F.concat(F.lit("?"), q)).otherwise(F.lit("")),
                    F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")))


def frontier(pages: DataFrame, pages_per_url: int = 3, orders=VALID_ORDERS) -> DataFrame:
    """Crawl targets: every page URL x listing page 1..n x order (A05). The fan-out
    is a generator over a fixed small array per row, not a join."""
    combos = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(o).alias("order"))
                       for p in range(1, pages_per_url + 1) for o in orders])
    rows = pages.select("page_id", "url", F.inline(combos))
    return rows.select("page_id", "page", "order",
                       with_page_params(F.col("url"), F.col("page"), F.col("order")).alias("target_url"))


# The ranking pages of the site and the suffix of an article's comment pages.
RANKING_BASES = ("https://news.example/ranking/comment", "https://news.example/ranking/access/news")
COMMENT_SUFFIX = "/comments"


def ranking_targets(genres: DataFrame, genre: str, bases=RANKING_BASES) -> DataFrame:
    """Ranking pages to crawl: every base on its own and with every genre (A05). ``genres`` has
    one row per genre; the bases are a generator over a fixed array per row."""
    overall = genres.sparkSession.createDataFrame([("",)], "genre string")
    named = genres.select(F.col(genre).alias("genre")).where("genre IS NOT NULL AND genre <> ''").distinct()
    rows = overall.union(named).select("genre", F.explode(F.array(*map(F.lit, bases))).alias("base"))
    return rows.select("genre", F.concat_ws("/", "base", F.nullif("genre", F.lit(""))).alias("target_url"))


def comment_targets(articles: DataFrame) -> DataFrame:
    """First comment page of every article."""
    return articles.select("article_id", F.concat("article_link", F.lit(COMMENT_SUFFIX)).alias("target_url"))


def archive_name(title: Column) -> Column:
    """File name for a saved page: the title without forbidden characters, or the
    default when there is no title (B09)."""
    return F.concat(F.regexp_replace(F.coalesce(title, F.lit(DEFAULT_TITLE)), FORBIDDEN_FILENAME, ""),
                    F.lit(".html"))
