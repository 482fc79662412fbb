"""Crawl-side selections over the article, user and comment tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing, parts
from ..operators import select as S
from ..session import scratch_path
from .catalog import register

MIN_ACTIVE = 60         # minimum events per active user (C05)
TOP = 10                # size of top-n reports
PARTS = 16              # parts of the stored tables of counters (B03, E06)
MIN_TOTAL = 50          # minimum stored comment total (F01)


@register("unprocessed_articles", views=("articles_v",), oracle="""
SELECT article_id, article_link, scraped_time FROM articles_v
WHERE article_content IS NULL ORDER BY scraped_time DESC, article_id""")
def unprocessed_articles(v):
    """Articles without text, newest first."""
    return S.unprocessed(v.articles_v)


@register("unprocessed_seen_articles", views=("articles_v", "comments_v", "users_v"), oracle="""
SELECT article_id, article_link, scraped_time FROM articles_v
WHERE article_content IS NULL AND article_link IN (
  SELECT a.article_link FROM articles_v a
  JOIN (SELECT DISTINCT user_link, article_id FROM comments_v
        WHERE user_link IN (SELECT user_link FROM users_v) AND article_id IS NOT NULL) r
    ON r.article_id = a.article_id)""")
def unprocessed_seen_articles(v):
    """C02 (+D04): unprocessed articles among those the known users commented on."""
    read = S.articles_read_by(v.comments_v, v.users_v.select("user_link"), v.articles_v)
    return S.unprocessed_in(v.articles_v, read.select("article_link"))


@register("active_users", views=(), oracle=f"""
SELECT event_id, user_id FROM events
WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING COUNT(*) >= {MIN_ACTIVE})""")
def active_users(v):
    """Rows of users with at least MIN_ACTIVE rows."""
    return S.keep_keys_with_at_least(v.events.select("event_id", "user_id"), "user_id", MIN_ACTIVE)


@register("unseen_users", views=("comments_v", "users_v"), oracle="""
SELECT user_link, comment_id, scraped_time FROM (
  SELECT user_link, comment_id, scraped_time,
         ROW_NUMBER() OVER (PARTITION BY user_link ORDER BY scraped_time DESC, comment_id) AS rn
  FROM comments_v) t
WHERE rn = 1 AND user_link NOT IN (SELECT user_link FROM users_v)""")
def unseen_users(v):
    """Commenters missing from users (NULL-aware NOT IN), latest comment each."""
    return S.unseen_users(v.comments_v, v.users_v)


@register("commenting_users", views=("comments_v", "users_v"), oracle="""
SELECT DISTINCT u.user_id, u.total_comment_count
FROM users_v u JOIN comments_v c ON u.user_id = c.user_id
ORDER BY u.total_comment_count DESC""")
def commenting_users(v):
    """Users with comments, by total descending."""
    from ..operators.training import commenting_users as cu
    return cu(v.users_v, v.comments_v).orderBy(F.col("total_comment_count").desc(), "user_id")


@register("comments_with_user_id", views=("comments_v", "users_v"), oracle="""
SELECT c.comment_id, c.user_link, u.user_id
FROM comments_v c LEFT JOIN users_v u ON u.user_link = c.user_link""")
def comments_with_user_id(v):
    """User id attached by user link."""
    return S.attach_user_id(v.comments_v.select("comment_id", "user_link", "user_id"), v.users_v)


@register("articles_read_by_top_users", views=("comments_v", "users_v", "articles_v"), oracle=f"""
WITH top AS (SELECT user_link FROM users_v WHERE total_comment_count >= {MIN_TOTAL}
             ORDER BY total_comment_count DESC, user_id LIMIT {TOP})
SELECT p.user_link, p.article_id, a.article_link
FROM (SELECT DISTINCT user_link, article_id FROM comments_v
      WHERE user_link IN (SELECT user_link FROM top) AND article_id IS NOT NULL) p
JOIN articles_v a ON a.article_id = p.article_id""")
def articles_read_by_top_users(v):
    """D04 (+F01): articles read by the top commenters."""
    top = S.top_n(v.users_v, [F.col("total_comment_count").desc(), "user_id"], TOP,
                  F.col("total_comment_count") >= MIN_TOTAL)
    return S.articles_read_by(v.comments_v, top, v.articles_v)


@register("natural_key_lookup", views=("comments_v",), oracle="""
SELECT c.comment_id, k.key_comment_id
FROM comments_v c LEFT JOIN (
  SELECT article_id, user_link, comment_content, MIN(comment_id) AS key_comment_id
  FROM comments_v GROUP BY article_id, user_link, comment_content) k
ON k.article_id = c.article_id AND k.user_link = c.user_link AND k.comment_content = c.comment_content""")
def natural_key_lookup(v):
    """Natural key -> first surrogate id."""
    return S.first_id_per_key(v.comments_v, ["article_id", "user_link", "comment_content"])


@register("top_users_by_agreement", views=("comments_v",), oracle=f"""
SELECT user_id, MAX(agreements_count) AS max_agreements FROM comments_v
GROUP BY user_id ORDER BY max_agreements DESC, user_id LIMIT {TOP}""")
def top_users_by_agreement(v):
    """Top users by their most agreed comment."""
    return S.max_per_key_top(v.comments_v, "user_id", "agreements_count", TOP, "max_agreements")


@register("user_value_counts", views=(), oracle="""
SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id""")
def user_value_counts(v):
    """Rows per user, descending."""
    return S.value_counts(v.events, "user_id")


@register("user_article_pairs", views=("comments_v",), oracle="""
SELECT user_link, article_id FROM comments_v GROUP BY user_link, article_id ORDER BY user_link, article_id""")
def user_article_pairs(v):
    """Distinct (user, article) pairs."""
    return S.distinct_pairs(v.comments_v, "user_link", "article_id")


@register("latest_comment_per_user", views=("comments_v",), oracle="""
SELECT user_link, comment_id, scraped_time, article_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_link ORDER BY scraped_time DESC, comment_id) AS rn
  FROM comments_v) t WHERE rn = 1""")
def latest_comment_per_user(v):
    """DISTINCT ON (user_link) with a stated order."""
    return S.latest_per_key(v.comments_v, "user_link", ["comment_id", "scraped_time", "article_id"])


@register("user_reaction_totals", views=("comments_v", "users_v"), oracle="""
SELECT u.user_id, s.comment_count, s.agreements, s.acknowledgements, s.disagreements,
       u.total_comment_count - COALESCE(s.comment_count, 0) AS comment_count_diff,
       u.total_agreements_count - COALESCE(s.agreements, 0) AS agreements_diff
FROM users_v u LEFT JOIN (
  SELECT user_id, COUNT(*) AS comment_count, CAST(SUM(agreements_count) AS BIGINT) AS agreements,
         CAST(SUM(acknowledgements_count) AS BIGINT) AS acknowledgements,
         CAST(SUM(disagreements_count) AS BIGINT) AS disagreements
  FROM comments_v WHERE user_id IS NOT NULL GROUP BY user_id) s ON s.user_id = u.user_id""")
def user_reaction_totals(v):
    """Reaction totals per user against the stored totals."""
    return S.reaction_totals(v.comments_v, v.users_v)


@register("article_comment_counters", views=("comments_v", "articles_v"), oracle="""
SELECT a.article_id,
       CAST(COALESCE(c.with_reply, 0) AS BIGINT) AS total_comment_count_with_reply,
       CAST(COALESCE(c.without_reply, 0) AS BIGINT) AS total_comment_count_without_reply
FROM articles_v a LEFT JOIN (
  SELECT article_id, COUNT(*) AS with_reply,
         COUNT(*) FILTER (WHERE parent_comment_id IS NULL) AS without_reply
  FROM comments_v WHERE article_id IS NOT NULL GROUP BY article_id) c ON c.article_id = a.article_id""")
def article_comment_counters(v):
    """The two comment counters per article."""
    return S.comment_counters(v.articles_v, v.comments_v)


def _in_three_batches(v, rows, key, sums):
    """Sums per ``key`` kept on a stored table while comments come in three batches in the order of their ids."""
    path = scratch_path(v.spark, "sums")
    parts.create_sums(v.spark, path, f"{key} bigint", sums)
    top = v.events.agg(F.max("event_id")).first()[0] or 0
    for number in range(3):
        third = F.floor(F.col("comment_id") * 3 / (top + 1)) == number
        parts.add_sums(rows.where(third).drop("comment_id"), path, [key], sums, number, PARTS)
    return parts.read(v.spark, path).where(F.col(key).isNotNull())


@register("counters_by_deltas", views=("comments_v", "articles_v"), oracle="""
SELECT a.article_id,
       CAST(COALESCE(c.with_reply, 0) AS BIGINT) AS total_comment_count_with_reply,
       CAST(COALESCE(c.without_reply, 0) AS BIGINT) AS total_comment_count_without_reply
FROM articles_v a LEFT JOIN (
  SELECT article_id, COUNT(*) AS with_reply,
         COUNT(*) FILTER (WHERE parent_comment_id IS NULL) AS without_reply
  FROM comments_v GROUP BY article_id) c ON c.article_id = a.article_id""")
def counters_by_deltas(v):
    """B03 as scraped: three batches of comments added to stored counters equal one full count."""
    rows = v.comments_v.select("comment_id", "article_id", F.lit(1).alias("with_reply"),
                               F.col("parent_comment_id").isNull().cast("int").alias("without_reply"))
    kept = _in_three_batches(v, rows, "article_id", ["with_reply", "without_reply"])
    return (v.articles_v.select("article_id").join(kept, "article_id", "left")
            .select("article_id", F.coalesce("with_reply", F.lit(0)).cast("bigint").alias("total_comment_count_with_reply"),
                    F.coalesce("without_reply", F.lit(0)).cast("bigint").alias("total_comment_count_without_reply")))


@register("reaction_totals_by_deltas", views=("comments_v",), oracle="""
SELECT user_id, COUNT(*) AS comment_count,
       CAST(COALESCE(SUM(agreements_count), 0) AS BIGINT) AS agreements,
       CAST(COALESCE(SUM(acknowledgements_count), 0) AS BIGINT) AS acknowledgements,
       CAST(COALESCE(SUM(disagreements_count), 0) AS BIGINT) AS disagreements
FROM comments_v WHERE user_id IS NOT NULL GROUP BY user_id""")
def reaction_totals_by_deltas(v):
    """E06 as scraped: reaction totals per user kept while three batches of comments arrive."""
    sums = ["comment_count", "agreements", "acknowledgements", "disagreements"]
    rows = v.comments_v.select("comment_id", "user_id", F.lit(1).alias("comment_count"),
                               *[F.col(f"{c}_count").alias(c) for c in sums[1:]])
    return _in_three_batches(v, rows, "user_id", sums)


@register("top_commenters", views=("users_v",), oracle=f"""
SELECT user_id, user_link, total_comment_count FROM users_v
WHERE total_comment_count >= {MIN_TOTAL}
ORDER BY total_comment_count DESC, user_id LIMIT {TOP}""")
def top_commenters(v):
    """F01 (+C04): users by total with a minimum, top n."""
    return S.top_n(v.users_v.select("user_id", "user_link", "total_comment_count"),
                   [F.col("total_comment_count").desc(), "user_id"], TOP,
                   F.col("total_comment_count") >= MIN_TOTAL)


@register("busiest_articles", views=("articles_v",), oracle=f"""
SELECT article_id, article_link, comment_count_per_hour FROM articles_v
WHERE comment_count_per_hour IS NOT NULL
ORDER BY comment_count_per_hour DESC, article_id LIMIT {TOP}""")
def busiest_articles(v):
    """articles by comments per hour, NULL excluded, top n."""
    return S.top_n(v.articles_v.select("article_id", "article_link", "comment_count_per_hour"),
                   [F.col("comment_count_per_hour").desc(), "article_id"], TOP,
                   F.col("comment_count_per_hour").isNotNull())


@register("best_ranked_articles", views=("ranking_v",), oracle=f"""
SELECT article_link, best_ranking FROM (
  SELECT article_link, ranking AS best_ranking,
         ROW_NUMBER() OVER (PARTITION BY article_link ORDER BY ranking) AS rn FROM ranking_v) t
WHERE rn = 1 ORDER BY best_ranking, article_link LIMIT {TOP * 2}""")
def best_ranked_articles(v):
    """Best rank per link over ranking runs, top n."""
    best = S.best_rank_per_key(v.ranking_v, "article_link")
    return best.orderBy("best_ranking", "article_link").limit(TOP * 2)


PAGE = 2


_COMMENT_PAGE = f"""
SELECT 'newer' AS listing, article_id, comment_id, position FROM (
  SELECT article_id, comment_id, ROW_NUMBER() OVER (PARTITION BY article_id
         ORDER BY normalized_posted_time DESC, comment_id DESC) AS position
  FROM comments_v WHERE article_id IS NOT NULL) t WHERE position > {(PAGE - 1) * 10} AND position <= {PAGE * 10}
UNION ALL
SELECT 'recommended' AS listing, article_id, comment_id, position FROM (
  SELECT article_id, comment_id, ROW_NUMBER() OVER (PARTITION BY article_id
         ORDER BY agreements_count DESC, comment_id) AS position
  FROM comments_v WHERE article_id IS NOT NULL) t WHERE position > {(PAGE - 1) * 10} AND position <= {PAGE * 10}"""


@register("comment_page", views=("comments_v",), oracle=_COMMENT_PAGE)
def comment_page(v):
    """page 2 of every article's comment listing in both orders."""
    c = v.comments_v.where(F.col("article_id").isNotNull()).select(
        "article_id", "comment_id", "normalized_posted_time", "agreements_count")
    newer = S.listing_page(c, "article_id",
                           [F.col("normalized_posted_time").desc(), F.col("comment_id").desc()], PAGE)
    recommended = S.listing_page(c, "article_id",
                                 [F.col("agreements_count").desc(), F.col("comment_id").asc()], PAGE)
    cols = ["article_id", "comment_id", F.col("position").cast("bigint").alias("position")]
    return (newer.select(F.lit("newer").alias("listing"), *cols)
                 .unionByName(recommended.select(F.lit("recommended").alias("listing"), *cols)))


@register("comment_page_stored", views=("comments_v",), oracle=_COMMENT_PAGE)
def comment_page_stored(v):
    """F04 on stored listings: both orders are written once by page, and page 2 is read from them."""
    c = v.comments_v.select("article_id", "comment_id", "normalized_posted_time", "agreements_count")
    orders = {"newer": [F.col("normalized_posted_time").desc(), F.col("comment_id").desc()],
              "recommended": [F.col("agreements_count").desc(), F.col("comment_id").asc()]}
    pages = []
    for name, order in orders.items():
        path = scratch_path(v.spark, "listing")
        listing.store(c, path, "article_id", order)
        pages.append(listing.read_pages(v.spark, path, PAGE).select(
            F.lit(name).alias("listing"), "article_id", "comment_id", "position"))
    return pages[0].unionByName(pages[1])


CAP_N = 25
REPLY_CAP = 10
SHOWN_REPLIES = 3


@register("capped_comments", views=("comments_v",), oracle=f"""
SELECT article_id, comment_id, position FROM (
  SELECT article_id, comment_id, ROW_NUMBER() OVER (PARTITION BY article_id
         ORDER BY normalized_posted_time DESC, comment_id DESC) AS position
  FROM comments_v WHERE article_id IS NOT NULL) t WHERE position <= {-(-CAP_N // 10) * 10}""")
def capped_comments(v):
    """The first ceil(n/10)*10 comments per article, newest first."""
    c = v.comments_v.where(F.col("article_id").isNotNull()).select(
        "article_id", "comment_id", "normalized_posted_time")
    out = S.capped(c, "article_id", [F.col("normalized_posted_time").desc(), F.col("comment_id").desc()], CAP_N)
    return out.select("article_id", "comment_id", F.col("position").cast("bigint").alias("position"))


@register("capped_replies", views=("comments_v",), oracle=f"""
SELECT parent_comment_id, comment_id, position FROM (
  SELECT parent_comment_id, comment_id, ROW_NUMBER() OVER (PARTITION BY parent_comment_id
         ORDER BY normalized_posted_time, comment_id) AS position
  FROM comments_v WHERE parent_comment_id IS NOT NULL) t WHERE position <= {-(-REPLY_CAP // 10) * 10}""")
def capped_replies(v):
    """The replies per comment that are loaded to show REPLY_CAP of them."""
    c = v.comments_v.where(F.col("parent_comment_id").isNotNull()).select(
        "parent_comment_id", "comment_id", "normalized_posted_time")
    out = S.capped(c, "parent_comment_id", S.reply_order(), REPLY_CAP)
    return out.select("parent_comment_id", "comment_id", F.col("position").cast("bigint").alias("position"))


@register("capped_user_page", views=("comments_v",), oracle=f"""
SELECT user_id, comment_id, position FROM (
  SELECT user_id, comment_id, ROW_NUMBER() OVER (PARTITION BY user_id
         ORDER BY normalized_posted_time DESC, comment_id DESC) AS position
  FROM comments_v) t WHERE position <= {(CAP_N // 10 + 1) * 10}""")
def capped_user_page(v):
    """The comments a user page has loaded after CAP_N were asked for, newest first."""
    c = v.comments_v.select("user_id", "comment_id", "normalized_posted_time")
    out = S.capped(c, "user_id", [F.col("normalized_posted_time").desc(), F.col("comment_id").desc()], CAP_N,
                   pages=True)
    return out.select("user_id", "comment_id", F.col("position").cast("bigint").alias("position"))


@register("thread_replies", views=("comments_v",), oracle=f"""
SELECT parent_comment_id, position, comment_id, user_id, comment_content, reply_count FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_comment_id ORDER BY normalized_posted_time, comment_id) AS position,
         COUNT(*) OVER (PARTITION BY parent_comment_id) AS reply_count
  FROM comments_v WHERE parent_comment_id IS NOT NULL) t WHERE position <= {SHOWN_REPLIES}""")
def thread_replies(v):
    """The first replies under every parent comment, with the number of all of them."""
    return S.thread_rows(v.comments_v, SHOWN_REPLIES).select(
        "parent_comment_id", F.col("position").cast("bigint").alias("position"), "comment_id", "user_id",
        "comment_content", "reply_count")


@register("block_kinds", views=("blocks_v",), oracle="""
SELECT section, kind, COUNT(*) AS n FROM (
  SELECT section, CASE WHEN has_anchor THEN 'article_header' WHEN has_reply_count THEN 'comment'
                       WHEN has_text THEN 'reply' WHEN has_reply_link THEN 'parent_link'
                       WHEN has_reply_text THEN 'deleted_parent' ELSE 'other' END AS kind
  FROM blocks_v) t GROUP BY section, kind""")
def block_kinds(v):
    """Block counts per section and kind (first matching rule)."""
    return (v.blocks_v.withColumn("kind", S.block_kind())
             .groupBy("section", "kind").agg(F.count(F.lit(1)).alias("n")))


# --- normalisation and quarantine -------------------------------------------

from ..functions.normalize import normalize_count, normalize_time  # noqa: E402
from ..operators import quarantine  # noqa: E402
from .normal_sql import NUM_ORACLE, TIME_ORACLE  # noqa: E402

@register("normalized_counts", views=("number_text_v",), oracle=f"""
SELECT id, number_text, {NUM_ORACLE} AS value FROM number_text_v""")
def normalized_counts(v):
    """Count texts to integers."""
    t = v.number_text_v
    return t.select("id", "number_text", normalize_count("number_text").alias("value"))


@register("normalized_times", views=("time_text_v",), oracle=TIME_ORACLE)
def normalized_times(v):
    """Posted-time texts to timestamps against each row's base time."""
    t = v.time_text_v
    return t.select("id", "time_text", normalize_time("time_text", "base_time").alias("normalized_time"))


@register("quarantine_report", views=("number_text_v", "time_text_v", "comments_v", "articles_v"),
          oracle=f"""
WITH nums AS (SELECT id, number_text, {NUM_ORACLE} AS value FROM number_text_v),
times AS ({TIME_ORACLE})
SELECT 'number_text' AS source, id, 'bad_number' AS reason FROM nums WHERE number_text IS NOT NULL AND value IS NULL
UNION ALL
SELECT 'time_text' AS source, id, 'bad_time' AS reason FROM times WHERE time_text IS NOT NULL AND normalized_time IS NULL
UNION ALL
SELECT 'comments' AS source, comment_id AS id, 'missing_article' AS reason FROM comments_v c
WHERE NOT EXISTS (SELECT 1 FROM articles_v a WHERE a.article_id = c.article_id)""")
def quarantine_report(v):
    """Unusable numbers, times and foreign keys with their reasons."""
    return quarantine.report(v.number_text_v, v.time_text_v, v.comments_v, v.articles_v)
