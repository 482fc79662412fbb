"""Selections a crawl or modelling run needs: unprocessed items, unseen users,
rankings, counts and pages. All are joins, partial aggregations or top-k; none
gathers a group into one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequence
from .key_index import HIGH, LOW, key_hashes
from .training import left_join_keyed


# --- filters -----------------------------------------------------------------

def unprocessed(articles: DataFrame) -> DataFrame:
    """Articles whose text has not been fetched yet, newest first."""
    return (articles.where(F.col("article_content").isNull())
                    .select("article_id", "article_link", "scraped_time")
                    .orderBy(F.col("scraped_time").desc(), "article_id"))


def unprocessed_in(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Unprocessed articles whose link is in ``links`` (C02): a semi-join, so an
    empty link set gives an empty result (K16)."""
    return unprocessed(articles.join(links.select("article_link"), "article_link", "left_semi"))


def keep_keys_with_at_least(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key occurs at least ``n`` times (C05). Counts are partially
    aggregated before the shuffle; the semi-join back is split by AQE when a key
    is hot."""
    big = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(key)
    return df.join(big, key, "left_semi")


# --- joins -------------------------------------------------------------------

def not_in(df: DataFrame, col: str, other: DataFrame, other_col: str | None = None) -> DataFrame:
    """SQL ``col NOT IN (SELECT other_col FROM other)`` with its NULL rules (D01):
    an empty ``other`` keeps every row, a NULL in it empties the result, and a NULL ``col``
    qualifies only against an empty ``other``.

    Written as a (shuffle or broadcast, chosen by AQE) anti-join plus scalar
    checks, so it does not depend on the subquery side fitting in memory.
    """
    other_col = other_col or col
    keys = other.select(F.col(other_col).alias(col))
    nulls_in_other = keys.select(F.count_if(F.col(col).isNull())).scalar()
    others = keys.select(F.count(F.lit(1))).scalar()
    return (df.join(keys.where(F.col(col).isNotNull()), col, "left_anti")
              .where((others == 0) | (F.col(col).isNotNull() & (nulls_in_other == 0))))


def latest_per_key(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per key (E05, K13): latest ``scraped_time``, then lowest comment_id.
    A partial aggregation (``max_by``), so a hot key is combined map-side."""
    pick = F.max_by(F.struct(*cols), F.struct(F.col("scraped_time"), -F.col("comment_id")))
    return df.groupBy(key).agg(pick.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in cols])


def unseen_users(comments: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    """Commenters not yet in ``users`` (D01): one row per user link (its latest
    comment), newest first; ``limit`` keeps the first n as the crawl does."""
    latest = latest_per_key(comments, "user_link", ["comment_id", "scraped_time"])
    out = not_in(latest, "user_link", users).orderBy(F.col("scraped_time").desc(), "user_link")
    return out.limit(limit) if limit else out


def attach_user_id(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Set ``user_id`` from ``users`` by ``user_link`` (D03); unknown links stay NULL."""
    return left_join_keyed(comments.drop("user_id"), users.select("user_link", "user_id"), "user_link")


def articles_read_by(comments: DataFrame, chosen_links: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct (user, article) pairs of the chosen users, NULL articles dropped,
    with the article link (D04, C03)."""
    pairs = (comments.join(chosen_links.select("user_link"), "user_link", "left_semi")
                     .select("user_link", "article_id")
                     .where(F.col("article_id").isNotNull())
                     .distinct())
    return pairs.join(articles.select("article_id", "article_link"), "article_id")


def first_id_per_key(df: DataFrame, keys: list[str], id_col: str = "comment_id",
                     name: str = "key_comment_id") -> DataFrame:
    """Natural key -> surrogate id, first (lowest) match (D08). Keys with a NULL
    never match, as with SQL equality. Keys are told apart by their 128-bit hash, so no text is shuffled."""
    hashed = df.select(id_col, *key_hashes(keys))
    known = hashed.where(F.col(HIGH).isNotNull())
    firsts = known.groupBy(HIGH, LOW).agg(F.min(id_col).alias(name))
    return known.join(firsts, [HIGH, LOW]).select(id_col, name).unionByName(
        hashed.where(F.col(HIGH).isNull()).select(id_col, F.lit(None).cast(df.schema[id_col].dataType).alias(name)))


# --- aggregations ------------------------------------------------------------

def max_per_key_top(df: DataFrame, key: str, col: str, n: int, name: str) -> DataFrame:
    """Largest ``col`` per key, the n keys with the largest values."""
    return (df.groupBy(key).agg(F.max(col).alias(name))
              .orderBy(F.col(name).desc(), key).limit(n))


def value_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Frequency per key, descending."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), key)


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs through a grouping, ordered."""
    return df.select(a, b).distinct().orderBy(a, b)


def reaction_totals(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: sums of reactions and comment count, next to the stored totals."""
    sums = comments.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("comment_count"),
        F.sum("agreements_count").cast("bigint").alias("agreements"),
        F.sum("acknowledgements_count").cast("bigint").alias("acknowledgements"),
        F.sum("disagreements_count").cast("bigint").alias("disagreements"))
    return (users.select("user_id", "total_comment_count", "total_agreements_count")
                 .join(sums, "user_id", "left")
                 .select("user_id", "comment_count", "agreements", "acknowledgements", "disagreements",
                         (F.col("total_comment_count") - F.coalesce("comment_count", F.lit(0)))
                         .alias("comment_count_diff"),
                         (F.col("total_agreements_count") - F.coalesce("agreements", F.lit(0)))
                         .alias("agreements_diff")))


def comment_counters(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments per article with and without replies, 0 when none."""
    counts = comments.where(F.col("article_id").isNotNull()).groupBy("article_id").agg(
        F.count(F.lit(1)).alias("with_reply"),
        F.count_if(F.col("parent_comment_id").isNull()).alias("without_reply"))
    return (articles.select("article_id").join(counts, "article_id", "left")
                    .select("article_id",
                            F.coalesce("with_reply", F.lit(0)).cast("bigint").alias("total_comment_count_with_reply"),
                            F.coalesce("without_reply", F.lit(0)).cast("bigint")
                            .alias("total_comment_count_without_reply")))


# --- top-k and pages ---------------------------------------------------------

def top_n(df: DataFrame, order: list[Column], n: int, where: Column | None = None) -> DataFrame:
    """Filter, total order, first n rows (C04, C07, F01, F02): planned as a
    per-partition top-n followed by one merge of n rows per partition."""
    if where is not None:
        df = df.where(where)
    return df.orderBy(*order).limit(n)


def best_rank_per_key(ranking: DataFrame, key: str, rank: str = "ranking") -> DataFrame:
    """Best (lowest) rank per key (W01) as a partial aggregation."""
    return ranking.groupBy(key).agg(F.min(rank).alias("best_ranking"))


def listing_page(df: DataFrame, key: str, order: list[Column], page: int, size: int = 10) -> DataFrame:
    """Rows on page ``page`` (1-based, ``size`` rows each) of every key's listing."""
    first = sequence.first_n_per_key(df, key, order, page * size, "position")
    return first.where(F.col("position") > (page - 1) * size)


PAGE_ROWS = 10   # rows a listing page loads at a time


def loaded_rows(n: int, pages: bool = False) -> int:
    """Rows that are loaded to show ``n``: whole pages of ten; a user page (``pages``) starts
    with one page and loads another for every ten begun."""
    return PAGE_ROWS * (n // PAGE_ROWS + 1 if pages else -(-n // PAGE_ROWS))


def capped(df: DataFrame, key: str, order: list[Column], n: int, pages: bool = False) -> DataFrame:
    """The rows per key that are loaded to show ``n``."""
    return sequence.first_n_per_key(df, key, order, loaded_rows(n, pages), "position")


def reply_order() -> list[Column]:
    return [F.col("normalized_posted_time").asc(), F.col("comment_id").asc()]


def thread_rows(comments: DataFrame, replies: int = 10) -> DataFrame:
    """The first replies of every parent comment, oldest first, each with its position and
    the number of all replies to that parent (D13)."""
    answers = comments.where(F.col("parent_comment_id").isNotNull())
    sizes = answers.groupBy("parent_comment_id").agg(F.count(F.lit(1)).alias("reply_count"))
    shown = sequence.first_n_per_key(answers, "parent_comment_id", reply_order(), replies, "position")
    return shown.join(sizes, "parent_comment_id")


# --- page blocks -------------------------------------------------------------

def block_kind() -> Column:
    """First matching rule decides the kind of a user-page block."""
    return (F.when(F.col("has_anchor"), "article_header")
             .when(F.col("has_reply_count"), "comment")
             .when(F.col("has_text"), "reply")
             .when(F.col("has_reply_link"), "parent_link")
             .when(F.col("has_reply_text"), "deleted_parent")
             .otherwise("other"))


# --- scans ---------------------------------------------------------------------

def slice_by(df: DataFrame, col: str, value, order: list[Column] | None = None) -> DataFrame:
    """Rows with ``col == value`` (A01); with a literal value the filter is pushed
    into the Parquet scan (row-group statistics skip the rest)."""
    v = value if isinstance(value, Column) else F.lit(value)
    out = df.where(F.col(col) == v)
    return out.orderBy(*order) if order else out
