"""Texts to label-probability vectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import training
from ..operators import vectors as V
from ..operators import word_vectors as W
from .catalog import register

CATEGORY_LABELS = ("de", "en", "es", "fr")
_SPLIT = V.TOKEN_SPLIT


def _tok_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{_SPLIT}'), lambda x: x <> '')"


def _nb_sql(train: str, score: str, labels) -> str:
    """Oracle SQL text of the same naive Bayes: ``train`` yields (label, text),
    ``score`` yields (key, text); the result has key, v0..v(k-1)."""
    k = len(labels)
    lab_values = ", ".join(f"('{x}', {i})" for i, x in enumerate(labels))
    return f"""
nb_train AS ({train}),
nb_tok AS (SELECT label, unnest({_tok_sql('text')}) AS w FROM nb_train),
nb_cnt AS (SELECT label, w, COUNT(*) AS cnt FROM nb_tok GROUP BY label, w),
nb_cls AS (SELECT d.label, ln(d.n_c) - ln((SELECT COUNT(*) FROM nb_train)) AS prior,
                  ln(COALESCE(t.t_c, 0) + (SELECT COUNT(DISTINCT w) FROM nb_cnt)) AS log_norm
           FROM (SELECT label, COUNT(*) AS n_c FROM nb_train GROUP BY label) d
           LEFT JOIN (SELECT label, SUM(cnt) AS t_c FROM nb_cnt GROUP BY label) t ON t.label = d.label),
nb_docs AS ({score}),
nb_tf AS (SELECT key, w, COUNT(*) AS tf FROM (SELECT key, unnest({_tok_sql('text')}) AS w FROM nb_docs) x
          GROUP BY key, w),
nb_known AS (SELECT * FROM nb_tf WHERE w IN (SELECT w FROM nb_cnt)),
nb_nd AS (SELECT key, SUM(tf) AS n_d FROM nb_known GROUP BY key),
nb_part AS (SELECT k.key, c.label, SUM(k.tf * ln(c.cnt + 1)) AS part
            FROM nb_known k JOIN nb_cnt c ON c.w = k.w GROUP BY k.key, c.label),
nb_labels AS (SELECT * FROM (VALUES {lab_values}) l(label, pos)),
nb_score AS (SELECT d.key, l.pos, cl.prior - COALESCE(n.n_d, 0) * cl.log_norm + COALESCE(p.part, 0.0) AS score
             FROM (SELECT key FROM nb_docs WHERE text IS NOT NULL) d
             CROSS JOIN nb_labels l
             JOIN nb_cls cl ON cl.label = l.label
             LEFT JOIN nb_nd n ON n.key = d.key
             LEFT JOIN nb_part p ON p.key = d.key AND p.label = l.label),
nb_max AS (SELECT key, MAX(score) AS m FROM nb_score GROUP BY key),
nb_exp AS (SELECT s.key, s.pos, exp(s.score - m.m) AS e FROM nb_score s JOIN nb_max m ON m.key = s.key),
nb_vec AS (SELECT key, {', '.join(f"MAX(CASE WHEN pos = {i} THEN e END) AS e{i}" for i in range(k))}
           FROM nb_exp GROUP BY key),
nb_out AS (SELECT d.key, {', '.join(f"e{i} / ({' + '.join(f'e{j}' for j in range(k))}) AS v{i}" for i in range(k))}
           FROM (SELECT DISTINCT key FROM nb_docs) d LEFT JOIN nb_vec v ON v.key = d.key)"""


def _flat(df, col, n, prefix):
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, *[F.round(F.col(col)[i], 6).alias(f"{prefix}{i}") for i in range(n)])


def _r(prefix, n):
    return ", ".join(f"round({prefix}{i}, 6) AS {prefix}{i}" for i in range(n))


def sentiment_model(v):
    return V.fit_naive_bayes(v.labelled_docs_v, "text", "label")


@register("sentiment_vectors", views=("labelled_docs_v",), oracle="WITH " + _nb_sql(
    "SELECT label, text FROM labelled_docs_v",
    "SELECT doc_id AS key, text FROM documents", V.SENTIMENT_LABELS) + f"""
SELECT key AS doc_id, {_r('v', 3)} FROM nb_out""")
def sentiment_vectors(v):
    """Every document scored against the sentiment labels (model from labelled documents)."""
    model = sentiment_model(v)
    out = V.score_naive_bayes(v.documents.select("doc_id", "text"), "doc_id", "text", model,
                              V.SENTIMENT_LABELS, "v")
    return _flat(out, "v", 3, "v")


@register("category_vectors", views=(), oracle="WITH " + _nb_sql(
    "SELECT lang AS label, text FROM documents",
    "SELECT doc_id AS key, text FROM documents", CATEGORY_LABELS) + f"""
SELECT key AS doc_id, {_r('v', 4)} FROM nb_out""")
def category_vectors(v):
    """Second label set (category = language) on the same texts."""
    docs = v.documents.select("doc_id", "text", "lang")
    model = V.fit_naive_bayes(docs, "text", "lang")
    out = V.score_naive_bayes(docs, "doc_id", "text", model, CATEGORY_LABELS, "v")
    return _flat(out, "v", 4, "v")


# A label set as a caller would give it: names with a few words that describe them.
LANGUAGES = {"de": ("der", "und", "mit"), "en": ("the", "and", "that"), "es": ("los", "el", "por"), "fr": ("les", "et", "pour")}


@register("zero_shot_vectors")
def zero_shot_vectors(v):
    """T01/T02 without labelled texts: probabilities over a label set given at call time."""
    out = W.score_zero_shot(v.documents.select("doc_id", "text"), "doc_id", "text", LANGUAGES, out="v")
    return _flat(out, "v", len(LANGUAGES), "v")


_RAW_SQL = """
SELECT c.user_id, c.article_id, a.article_content, c.parent_comment_id,
       p.comment_content AS parent_comment_content, c.comment_id, c.comment_content
FROM comments_v c
JOIN articles_v a ON a.article_id = c.article_id
LEFT JOIN comments_v p ON p.comment_id = c.parent_comment_id
WHERE c.user_id IN (SELECT user_id FROM users_v)"""


@register("training_vectorized", views=("labelled_docs_v", "comments_v", "users_v", "articles_v"),
          oracle="WITH raw AS (" + _RAW_SQL + ")," + _nb_sql(
              "SELECT label, text FROM labelled_docs_v",
              """SELECT DISTINCT sha256(t) AS key, t AS text FROM (
                   SELECT article_content AS t FROM raw UNION ALL SELECT parent_comment_content FROM raw
                   UNION ALL SELECT comment_content FROM raw) u WHERE t IS NOT NULL""",
              V.SENTIMENT_LABELS) + """
SELECT r.comment_id, r.user_id,
       round(a.v0, 6) AS a0, round(a.v1, 6) AS a1, round(a.v2, 6) AS a2,
       round(p.v0, 6) AS p0, round(p.v1, 6) AS p1, round(p.v2, 6) AS p2,
       round(c.v0, 6) AS c0, round(c.v1, 6) AS c1, round(c.v2, 6) AS c2
FROM raw r
LEFT JOIN nb_out a ON a.key = sha256(r.article_content)
LEFT JOIN nb_out p ON p.key = sha256(r.parent_comment_content)
LEFT JOIN nb_out c ON c.key = sha256(r.comment_content)""")
def training_vectorized(v):
    """The training table with article, parent and comment texts as sentiment
    vectors; every article and comment is scored once and joined back by id."""
    raw = training.build_training_raw(v.users_v, v.comments_v, v.articles_v, with_step=False)
    out = V.vectorize_training_rows(raw, v.articles_v, v.comments_v, sentiment_model(v), V.SENTIMENT_LABELS)
    flat = out.select("comment_id", "user_id", F.col("article_vec").alias("a"),
                      F.col("parent_vec").alias("p"), F.col("comment_vec").alias("c"))
    return _flat(_flat(_flat(flat, "a", 3, "a"), "p", 3, "p"), "c", 3, "c")
