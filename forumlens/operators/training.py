"""Training-set assembly: users, comments, articles and parent comments joined
into one per-user, time-ordered table (one row per comment)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import sequence

# Sequence order used everywhere: oldest first, ties by the larger comment id first.
def comment_order() -> list:
    return [F.col("normalized_posted_time").asc(), F.col("comment_id").desc()]


SPREAD = "_spread"
SPREAD_TASKS = 1 << 16


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Left join on ``keys`` in which rows with a NULL in the first key, which match nothing, are dealt to
    the tasks by the hash of ``by`` instead of meeting in one. ``rows`` are worked out once."""
    known = F.col(keys[0]).isNotNull()
    left = rows.withColumn(SPREAD, F.when(known, F.lit(0)).otherwise(
        1 + F.pmod(F.xxhash64(*by), F.lit(SPREAD_TASKS)).cast("int")))
    right = lookup.withColumn(SPREAD, F.when(known, F.lit(0)).otherwise(F.lit(-1)))
    return left.join(right, [*keys, SPREAD], "left").drop(SPREAD)


def left_join_keyed(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; NULL keys, which match nothing, spread by the row's numbers."""
    numbers = [c for c, kind in rows.dtypes if kind in ("bigint", "int") and c != key]
    return spread_join(rows, lookup, [key], numbers or rows.columns)


def commenting_users(users: DataFrame, comments: DataFrame) -> DataFrame:
    """Users that have at least one comment (distinct), by total comments descending."""
    authors = comments.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    return (users.join(authors, "user_id", "left_semi")
                 .select("user_id", "total_comment_count"))


def build_training_raw(users: DataFrame, comments: DataFrame, articles: DataFrame,
                       with_step: bool = True) -> DataFrame:
    """One row per comment of a known user, with its article text, parent comment
    text (NULL for top-level comments) and step index in the user's sequence.

    Comments whose article is unknown are left out (see ``quarantine``). The step
    index is computed on the narrow comment rows; the article and parent texts are
    joined last, so no shuffle carries an article text once per comment.
    """
    chosen = commenting_users(users, comments).select("user_id")
    c = (comments.select("user_id", "article_id", "parent_comment_id", "comment_id",
                         "comment_content", "normalized_posted_time")
                 .join(chosen, "user_id", "left_semi")
                 .join(articles.select("article_id"), "article_id", "left_semi"))
    if with_step:
        c = sequence.with_index(c, "user_id", comment_order(), "step")
    a = articles.select("article_id", "article_content")
    parents = comments.select(F.col("comment_id").alias("parent_comment_id"),
                              F.col("comment_content").alias("parent_comment_content"))
    rows = left_join_keyed(c, parents, "parent_comment_id").join(a, "article_id")
    cols = ["user_id", "article_id", "article_content", "parent_comment_id",
            "parent_comment_content", "comment_id", "comment_content", "normalized_posted_time"]
    return rows.select(*cols, *(["step"] if with_step else []))


# --- sequences of state vectors ---------------------------------------------

def next_state_pairs(vectors: DataFrame, missing_parent=None, index: str | None = None) -> DataFrame:
    """Inputs at t (article, parent, own state) with the target state at t+1; the
    last row of each user has no target and is dropped (W02). A missing parent
    becomes ``missing_parent`` (zeros by default, H05/K6). ``index`` names a column for the
    position in the user's sequence, taken from the same ranges."""
    from ..functions import arrays as A

    missing = A.zeros(3) if missing_parent is None else missing_parent
    vectors = vectors.select("user_id", "comment_id", "normalized_posted_time", "article_vec", "parent_vec", "comment_vec")
    rows = sequence.ranged(vectors, "user_id", comment_order())
    if index:
        rows = sequence.with_index(rows, "user_id", comment_order(), index)
    nxt = sequence.with_neighbours(rows, "user_id", comment_order(), ["comment_vec"], direction=+1, prefix="next_")
    return (nxt.where(F.col("next_comment_vec").isNotNull())
               .select("user_id", "comment_id", "normalized_posted_time", *([index] if index else []),
                       F.col("article_vec").alias("p"),
                       F.coalesce(F.col("parent_vec"), missing).alias("q"),
                       F.col("comment_vec").alias("s"),
                       F.col("next_comment_vec").alias("y")))


def split_order() -> list:
    return [F.md5(F.col("comment_id").cast("string")).asc(), F.col("comment_id").asc()]


def train_val_split(rows: DataFrame, ratio_tenths: int = 8, keep_rank: bool = False) -> DataFrame:
    """Exact, repeatable split per user: the first floor(n * ratio) rows in md5 order
    are ``train``, the rest ``val`` (W08). ``keep_rank`` keeps the md5-order
    position as ``split_rank`` (the fits cut users into shards by it), for which all rows are put in order;
    without it the split is found by selection."""
    if not keep_rank:
        return split_by_selection(rows, ratio_tenths)
    ranked = sequence.with_index(rows, "user_id", split_order(), "split_rank", total="_n")
    first = F.col("split_rank") < F.floor(F.col("_n") * ratio_tenths / 10)
    return ranked.withColumn("split", F.when(first, "train").otherwise("val")).drop("_n")


DIGITS = "0123456789abcdef"
MOST_ORDERED = 1_000_000    # rows of one user that are put in order in one task


def split_by_selection(rows: DataFrame, ratio_tenths: int = 8, most: int = MOST_ORDERED) -> DataFrame:
    """The split of ``train_val_split`` without ordering all rows.

    Counts per user and hash digit tell in which of 16 buckets a user's first ``val`` row lies; this is
    repeated inside the bucket, digit by digit, until no user's bucket has more than ``most`` rows. Only those are
    ordered, and the first ``val`` row of each user, one row, is joined to all rows. Rows without a user are left
    out; a comment id is unique within a user, and rows that repeat one fall on the same side."""
    kept = rows.where(F.col("user_id").isNotNull())
    if not 0 <= ratio_tenths < 10:
        raise ValueError("ratio_tenths must be 0 to 9")
    hashed = kept.select("user_id", "comment_id", split_order_hash().alias("_h"))
    cuts, digits = None, 0
    while cuts is None or (digits < 32 and (cuts.agg(F.max("_n")).first()[0] or 0) > most):
        cuts, digits = materialize(_narrowed(_inside(hashed, cuts, digits), digits, ratio_tenths)), digits + 1
    order = Window.partitionBy("user_id").orderBy("_h", "comment_id")
    firsts = (_inside(hashed, cuts, digits).withColumn("_r", F.row_number().over(order) - 1).where("_r = _left")
              .select("user_id", F.struct("_h", "comment_id").alias("_first")))
    train = F.struct(split_order_hash().alias("_h"), "comment_id") < F.col("_first")
    return (kept.join(firsts, "user_id")
            .select(*rows.columns, F.when(train, "train").otherwise("val").alias("split")))


def split_order_hash() -> F.Column:
    return F.md5(F.coalesce(F.col("comment_id").cast("string"), F.lit("")))


def _inside(hashed: DataFrame, cuts: DataFrame | None, digits: int) -> DataFrame:
    """Rows of their user's bucket, with its digits and the place of the first ``val`` row in it."""
    if cuts is None:
        return hashed.select("*", F.lit("").alias("_p"), F.lit(None).cast("bigint").alias("_left"))
    return hashed.withColumn("_p", F.substring("_h", 1, digits)).join(cuts.drop("_n"), ["user_id", "_p"])


def _narrowed(inside: DataFrame, digits: int, ratio_tenths: int) -> DataFrame:
    """The 16th part of each user's bucket that holds the first ``val`` row."""
    counts = [F.count_if(F.substring("_h", digits + 1, 1) == d).alias(f"_{d}") for d in DIGITS]
    sums = inside.groupBy("user_id", "_p", "_left").agg(F.count(F.lit(1)).alias("_all"), *counts)
    left = F.coalesce(F.col("_left"), F.floor(F.col("_all") * ratio_tenths / 10))
    before, buckets = F.lit(0), []
    for d in DIGITS:
        n = F.col(f"_{d}")
        buckets.append(F.when((before <= left) & (left < before + n), F.struct(
            F.concat("_p", F.lit(d)).alias("_p"), (left - before).cast("bigint").alias("_left"), n.alias("_n"))))
        before = before + n
    return sums.select("user_id", F.coalesce(*buckets).alias("_b")).select("user_id", "_b.*")


def aligned_predictions(rows: DataFrame, pred_col: str, sentinel=None) -> DataFrame:
    """Place the prediction made at t on row t+1; the first row of each user gets
    ``sentinel`` ([2, 2, 2] by default) (W04)."""
    from ..functions import arrays as A

    sentinel = A.const(3, 2.0) if sentinel is None else sentinel
    shifted = sequence.with_neighbours(rows, "user_id", comment_order(), [pred_col], direction=-1, prefix="prev_")
    return shifted.withColumn("aligned_pred", F.coalesce(F.col("prev_" + pred_col), sentinel)) \
                  .drop("prev_" + pred_col)


# --- user-page blocks ----------------------------------------------------------

def block_order() -> list:
    return [F.col("seq").asc()]


def carry_article_forward(blocks: DataFrame) -> DataFrame:
    """Each block gets the article of the nearest header at or above it."""
    return sequence.with_carry_forward(blocks, "section", block_order(), "article_id", "current_article_id")


def reply_parent_pairs(blocks: DataFrame, kind_col: str = "kind") -> DataFrame:
    """Replies paired with the parent link directly above them (W10). A deleted
    parent has no link, so its reply stays unpaired (K10)."""
    prev = sequence.with_neighbours(blocks, "section", block_order(), [kind_col, "reply_link"],
                                    direction=-1, prefix="prev_")
    return (prev.where((F.col(kind_col) == "reply") & (F.col("prev_" + kind_col) == "parent_link"))
                .select("section", F.col("block_id").alias("reply_block_id"),
                        F.col("prev_reply_link").alias("parent_link")))


def link_to_comment_id(link) -> F.Column:
    return F.regexp_extract(link, "/comments/([0-9]+)$", 1).try_cast("bigint")
