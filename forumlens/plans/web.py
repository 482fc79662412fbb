"""Page jobs over the raw ``pages`` table: fields, link lists, frontier, archive names."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import pages as P
from ..sources import selectors
from .catalog import register


def _q(p: str) -> str:
    return p.replace("'", "''")


def _clean_sql(col="html"):
    return f"regexp_replace({col}, '{_q(P.NOISE)}', '', 'g')"


def _unescape_sql(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def _strip_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '<[^>]*>', '', 'g'))"


def _field_sql(patterns, is_link):
    hits = []
    for p in patterns:
        raw = f"regexp_extract(c, '{_q(p)}', 1)"
        val = raw if is_link else _unescape_sql(_strip_sql(raw))
        hits.append(f"nullif({val}, '')")
    return f"coalesce({', '.join(hits)})"


_FIELDS_SQL = ", ".join(f"{_field_sql(pats, name.endswith('_link'))} AS {name}"
                        for name, pats in P.PAGE_FIELDS.items())


_PAGE_FIELDS = f"""
SELECT page_id, {_FIELDS_SQL} FROM (SELECT page_id, {_clean_sql()} AS c FROM pages) t"""


@register("page_fields", oracle=_PAGE_FIELDS)
def page_fields(v):
    """Title (title tag, then h1), language, article lead paragraph, first link."""
    return P.extract_fields(v.pages)


# The same fields as paths on the page's structure.
FIELD_PATHS = {"title": ["//title", "//h1"], "lang": ["//html/@lang"], "lead": ["//article//p"],
               "first_link": ["//body//a/@href"]}
LINK_PATHS = {"href": ["/@href"], "text": [""]}    # of the link itself


@register("page_fields_by_path", oracle=_PAGE_FIELDS)
def page_fields_by_path(v):
    """A03 by selector paths: title, language, lead paragraph and first link of every page."""
    return selectors.fields_by_path(v.pages, FIELD_PATHS)


_PAGE_LINKS = f"""
WITH s AS (SELECT page_id, regexp_extract({_clean_sql()}, '{_q(P.NAV)}', 1) AS sec FROM pages),
l AS (SELECT page_id, regexp_extract_all(sec, '{_q(P.ANCHOR)}', 1) AS hrefs,
             regexp_extract_all(sec, '{_q(P.ANCHOR)}', 2) AS texts FROM s)
SELECT page_id, CAST(generate_subscripts(hrefs, 1) - 1 AS INTEGER) AS position, unnest(hrefs) AS href,
       {_unescape_sql(_strip_sql('unnest(texts)'))} AS text
FROM l"""


@register("page_links", oracle=_PAGE_LINKS)
def page_links(v):
    """Navigation links of every page as rows with their position."""
    return P.section_links(v.pages)


@register("page_links_by_path", oracle=_PAGE_LINKS)
def page_links_by_path(v):
    """A04 by selector paths: navigation links of every page as rows with their position."""
    return selectors.items_by_path(v.pages, "//nav//a", LINK_PATHS)


_SET = """CASE WHEN len(list_filter(ps, lambda x: split_part(x, '=', 1) = '{k}')) > 0
     THEN list_transform(ps, lambda x: CASE WHEN split_part(x, '=', 1) = '{k}' THEN '{k}=' || {v} ELSE x END)
     ELSE list_append(ps, '{k}=' || {v}) END"""


@register("frontier_urls", oracle=f"""
WITH c AS (
  SELECT page_id, url, pg AS page, od AS "order",
         regexp_extract(url, '{P.URL_PARTS}', 1) AS base,
         regexp_extract(url, '{P.URL_PARTS}', 2) AS query,
         regexp_extract(url, '{P.URL_PARTS}', 3) AS frag
  FROM pages, (VALUES (1), (2), (3)) a(pg), (VALUES ('newer'), ('recommended')) b(od)),
p0 AS (SELECT *, list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]+=.+')) AS ps FROM c),
p1 AS (SELECT * REPLACE ({_SET.format(k='order', v='"order"')} AS ps) FROM p0),
p2 AS (SELECT * REPLACE ({_SET.format(k='page', v='CAST(page AS VARCHAR)')} AS ps) FROM p1)
SELECT page_id, page, "order",
       base || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END
            || CASE WHEN frag <> '' THEN '#' || frag ELSE '' END AS target_url
FROM p2""")
def frontier_urls(v):
    """Every page URL x listing pages 1-3 x both orders, parameters set."""
    return P.frontier(v.pages)


_BASES = ", ".join(f"('{b}')" for b in P.RANKING_BASES)


@register("ranking_frontier", views=("articles_v",), oracle=f"""
SELECT 'ranking' AS kind, base || CASE WHEN genre = '' THEN '' ELSE '/' || genre END AS target_url
FROM (VALUES {_BASES}) b(base), (SELECT '' AS genre UNION SELECT article_genre FROM articles_v
                                 WHERE article_genre IS NOT NULL AND article_genre <> '') g
UNION ALL SELECT 'comments' AS kind, article_link || '{P.COMMENT_SUFFIX}' AS target_url
FROM articles_v WHERE article_content IS NOT NULL""")
def ranking_frontier(v):
    """Ranking pages by base and genre, and the comment pages of fetched articles."""
    ranking = P.ranking_targets(v.articles_v, "article_genre")
    comments = P.comment_targets(v.articles_v.where(F.col("article_content").isNotNull()))
    return (ranking.select(F.lit("ranking").alias("kind"), "target_url")
            .unionByName(comments.select(F.lit("comments").alias("kind"), "target_url")))


@register("archive_names", oracle=f"""
SELECT page_id, title,
       regexp_replace(coalesce(title, '{P.DEFAULT_TITLE}'), '{_q(P.FORBIDDEN_FILENAME)}', '', 'g') || '.html' AS file_name
FROM (SELECT page_id, {_field_sql([P.PAGE_FIELDS['title'][0]], False)} AS title
      FROM (SELECT page_id, {_clean_sql()} AS c FROM pages) t) u""")
def archive_names(v):
    """Archive file name per page from its title."""
    t = P.extract_fields(v.pages, {"title": [P.PAGE_FIELDS["title"][0]]})
    return t.select("page_id", "title", P.archive_name(F.col("title")).alias("file_name"))
