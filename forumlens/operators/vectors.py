"""Label-probability vectors: classifier output handling and text scoring."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import left_join_keyed
from .word_chunks import TOKEN_SPLIT, word_sums

# The label orders of the two vector tables.
SENTIMENT_LABELS = ("positive", "neutral", "negative")


def classifier_output(df: DataFrame, scores_col: str, labels) -> DataFrame:
    """Zero-shot style output: ``labels`` and ``scores`` sorted by score descending."""
    pairs = F.arrays_zip(F.col(scores_col).alias("score"),
                         F.array(*[F.lit(x) for x in labels]).alias("label"))
    ranked = F.array_sort(pairs, lambda x, y: F.when(x["score"] > y["score"], -1)
                          .when(x["score"] < y["score"], 1).otherwise(0))
    return df.withColumn("labels", F.transform(ranked, lambda x: x["label"])) \
             .withColumn("scores", F.transform(ranked, lambda x: x["score"]))


def in_label_order(labels_col: str, scores_col: str, order) -> Column:
    """Scores re-ordered into the fixed label order."""
    m = F.map_from_arrays(F.col(labels_col), F.col(scores_col))
    return F.transform(F.array(*[F.lit(x) for x in order]), lambda lab: m[lab])


# --- text scoring ------------------------------------------------------------------
#
# Built-in scorer: multinomial naive Bayes with add-one smoothing, trained and
# applied with SQL aggregates. For a document d and class c
#   score(d, c) = log(n_c / n) - N_d * log(T_c + V) + sum_{w in d, cnt(c,w) > 0} tf(d, w) * log(cnt(c, w) + 1)
# where N_d counts the tokens of d that occur in training, T_c the training tokens of
# class c and V the vocabulary size; only non-zero (class, token) counts are stored
# and joined, so there is no vocabulary x class product. Probabilities are the
# softmax of the scores, in the given label order.

def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(t), TOKEN_SPLIT), "")


def fit_naive_bayes(train: DataFrame, text: str, label: str, labels=None) -> dict[str, DataFrame]:
    """Fit the scorer: token counts per class, class priors and normalisers.

    Fitting is eager, like any model fit: the (class, token) counts are computed
    once and written to the shared checkpoint folder, so every later use reads
    the model instead of re-tokenising the training texts. ``words`` has one row
    per vocabulary token with log(cnt + 1) per label (0 for a class that never saw
    the token), so scoring is a single equi-join on the token.
    """
    from ..session import materialize

    toks = train.select(F.col(label).alias("label"), F.explode(tokens(text)).alias("w"))
    counts = materialize(toks.groupBy("label", "w").agg(F.count(F.lit(1)).alias("cnt")))
    docs = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    totals = counts.groupBy("label").agg(F.sum("cnt").alias("t_c"))
    vocab = counts.agg(F.count_distinct("w").alias("v"))
    per_class = docs.join(totals, "label", "left")
    # one-row tables joined on a constant: bounded, broadcast
    n_all = per_class.agg(F.sum("n_c").alias("n"))
    consts = vocab.withColumn("_one", F.lit(1)).join(n_all.withColumn("_one", F.lit(1)), "_one")
    classes = (per_class.withColumn("_one", F.lit(1)).join(F.broadcast(consts), "_one")
                        .select("label", (F.log(F.col("n_c")) - F.log(F.col("n"))).alias("prior"),
                                F.log(F.coalesce("t_c", F.lit(0)) + F.col("v")).alias("log_norm")))
    model = {"counts": counts, "classes": classes}
    if labels is not None:
        model["words"] = word_table(counts, labels)
    return model


def word_table(counts: DataFrame, labels) -> DataFrame:
    return counts.groupBy("w").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("label") == x, F.log(F.col("cnt") + 1))), F.lit(0.0))
        for x in labels]).alias("lw"))


def score_naive_bayes(docs: DataFrame, key: str, text: str, model: dict[str, DataFrame],
                      labels, out: str = "vec") -> DataFrame:
    """Probability vector over ``labels`` per row of ``docs``; NULL text -> NULL vector.

    The words of each chunk of documents are joined with the per-token table and summed per
    document; the per-class constants come as one broadcast row.
    """
    labels = list(labels)
    words = model.get("words")
    if words is None:
        words = word_table(model["counts"], labels)
    sums = word_sums(docs, key, text, words.select("w", F.col("lw").alias("v")), len(labels))
    cls = model["classes"]
    row = cls.agg(*[F.max(F.when(F.col("label") == x, F.col("prior"))).alias(f"_prior{i}")
                    for i, x in enumerate(labels)],
                  *[F.max(F.when(F.col("label") == x, F.col("log_norm"))).alias(f"_norm{i}")
                    for i, x in enumerate(labels)]).withColumn("_one", F.lit(1))
    present = (docs.where(F.col(text).isNotNull()).select(key).join(sums, key, "left")
                   .withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one"))
    n_d = F.coalesce(F.col("n"), F.lit(0))
    scores = F.array(*[F.col(f"_prior{i}") - n_d * F.col(f"_norm{i}") + F.coalesce(F.col(f"s{i}"), F.lit(0.0))
                       for i in range(len(labels))])
    from ..functions.arrays import softmax
    probs = present.select(key, scores.alias("_scores")).select(key, softmax("_scores").alias(out))
    return docs.select(key).join(probs, key, "left")


def score_with_model(df: DataFrame, text: str, predict, labels, out: str = "vec") -> DataFrame:
    """Plug-in slot for a user model: ``predict(list[str | None]) -> list[dict label->score | None]``
    is called on Arrow batches (iterator pandas UDF) and its scores are put in
    label order; a NULL text keeps its row and gets NULL."""
    from pyspark.sql.functions import pandas_udf

    order = list(labels)

    @pandas_udf("array<double>")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [None if pd.isna(x) else x for x in s.tolist()]
            res = predict(texts)
            yield pd.Series([None if r is None else [float(r[lab]) for lab in order] for r in res])

    return df.withColumn(out, _score(F.col(text)))


def vectorize_training_rows(rows: DataFrame, articles: DataFrame, comments: DataFrame,
                            model: dict[str, DataFrame], labels) -> DataFrame:
    """Training rows (ids only) with article, parent and comment texts as vectors.

    Texts are scored where they live: each referenced article once by article_id,
    each referenced comment once by comment_id (a comment used as a parent and as
    a row is scored once), and the vectors are joined back by id. No shuffle
    carries an article text once per comment.
    """
    from ..session import materialize
    ids = materialize(rows.select("comment_id", "user_id", "article_id", "parent_comment_id"))  # read four times
    used_articles = ids.select("article_id").distinct()
    used_comments = (ids.select("comment_id")
                        .unionByName(ids.select(F.col("parent_comment_id").alias("comment_id"))
                                        .where(F.col("comment_id").isNotNull()))
                        .distinct())
    art = articles.select("article_id", "article_content").join(used_articles, "article_id", "left_semi")
    com = comments.select("comment_id", "comment_content").join(used_comments, "comment_id", "left_semi")
    a_vec = score_naive_bayes(art, "article_id", "article_content", model, labels, "article_vec")
    # comment vectors are looked up twice (as the row and as the parent): written once
    c_vec = materialize(score_naive_bayes(com, "comment_id", "comment_content", model, labels, "vec"))
    return (ids.join(a_vec, "article_id", "left")
               .join(c_vec.withColumnRenamed("vec", "comment_vec"), "comment_id", "left")
               .transform(left_join_keyed, c_vec.select(F.col("comment_id").alias("parent_comment_id"),
                                                        F.col("vec").alias("parent_vec")), "parent_comment_id"))
