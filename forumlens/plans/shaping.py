"""Training-set queries (joins and per-user sequences)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import dynamics, key_index, maintain, parts, training
from ..operators import select as S
from ..session import materialize, scratch_path
from ..sources.views import STATE_DIM
from .catalog import register
from .normal_sql import NUM_ORACLE, TIME_ORACLE


@register("training_raw", views=("comments_v", "users_v", "articles_v"), oracle="""
SELECT c.user_id, c.article_id, a.article_content, c.parent_comment_id,
       p.comment_content AS parent_comment_content, c.comment_id, c.comment_content,
       c.normalized_posted_time,
       CAST(ROW_NUMBER() OVER (PARTITION BY c.user_id
                               ORDER BY c.normalized_posted_time, c.comment_id DESC) - 1 AS BIGINT) AS step
FROM comments_v c
JOIN articles_v a ON a.article_id = c.article_id
LEFT JOIN comments_v p ON p.comment_id = c.parent_comment_id
WHERE c.user_id IN (SELECT user_id FROM users_v)
""")
def training_raw(v):
    """Per-user training table (flagship)."""
    return training.build_training_raw(v.users_v, v.comments_v, v.articles_v)
KEY = ["article_id", "user_link", "comment_content"]
_HALF = "comment_id * 2 < (SELECT MAX(comment_id) FROM comments_v)"
_NK = "article_id IS NULL OR user_link IS NULL OR comment_content IS NULL"


def _halves(c):
    top = c.select(F.max("comment_id")).scalar()
    return c.where(F.col("comment_id") * 2 < top), c.where(F.col("comment_id") * 2 >= top)


@register("insert_first_wins", views=("comments_v",), oracle=f"""
WITH tgt AS (SELECT * FROM comments_v WHERE {_HALF}),
bat AS (SELECT * FROM comments_v WHERE NOT ({_HALF})),
kd AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id, user_link, comment_content
                                                   ORDER BY comment_id) AS rn
                      FROM bat WHERE NOT ({_NK})) t WHERE rn = 1),
fresh AS (SELECT * FROM kd WHERE NOT EXISTS (
            SELECT 1 FROM tgt WHERE tgt.article_id = kd.article_id AND tgt.user_link = kd.user_link
                              AND tgt.comment_content = kd.comment_content)
          UNION ALL SELECT *, 0 AS rn FROM bat WHERE {_NK})
SELECT comment_id, article_id, user_link, comment_content FROM tgt
UNION ALL SELECT comment_id, article_id, user_link, comment_content FROM fresh""")
def insert_first_wins(v):
    """Target after inserting the second half of comments, first write wins."""
    c = v.comments_v.select("comment_id", *KEY)
    target, batch = _halves(c)
    return maintain.apply_insert(target, batch, KEY, ["comment_id"])


@register("insert_through_index", views=("comments_v",), oracle=f"""
WITH tgt AS (SELECT * FROM comments_v WHERE {_HALF}),
bat AS (SELECT * FROM comments_v WHERE NOT ({_HALF})),
kd AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id, user_link, comment_content
                                                   ORDER BY comment_id) AS rn
                      FROM bat WHERE NOT ({_NK})) t WHERE rn = 1),
fresh AS (SELECT * FROM kd WHERE NOT EXISTS (
            SELECT 1 FROM tgt WHERE tgt.article_id = kd.article_id AND tgt.user_link = kd.user_link
                              AND tgt.comment_content = kd.comment_content)
          UNION ALL SELECT *, 0 AS rn FROM bat WHERE {_NK}),
top AS (SELECT MAX(comment_id) AS id, MAX(normalized_posted_time) - INTERVAL 1 HOUR AS since FROM comments_v)
SELECT comment_id, article_id, user_link, comment_content FROM tgt
UNION ALL SELECT comment_id, article_id, user_link, comment_content FROM fresh
UNION ALL SELECT comment_id + top.id + 1 AS comment_id, article_id, user_link, comment_content
FROM comments_v, top WHERE normalized_posted_time >= top.since AND ({_NK})""")
def insert_through_index(v):
    """B01 on a stored table: the second half of comments inserted, then the last hour sent again
    under new ids; only the row groups that may hold a key are read for the second batch."""
    c = v.comments_v.select("comment_id", *KEY, "normalized_posted_time")
    top, last = c.agg(F.max("comment_id"), F.max("normalized_posted_time")).first()
    path = scratch_path(v.spark, "comments")
    rows = c.drop("normalized_posted_time")
    key_index.append_rows(rows.where(F.col("comment_id") * 2 < top), path, KEY)
    key_index.insert(v.spark, path, rows.where(F.col("comment_id") * 2 >= top), KEY, ["comment_id"])
    again = (c.where(F.col("normalized_posted_time") >= F.lit(last) - F.expr("INTERVAL 1 HOUR"))
             .drop("normalized_posted_time").withColumn("comment_id", F.col("comment_id") + (top + 1)))
    key_index.insert(v.spark, path, again, KEY, ["comment_id"])
    return key_index.read_rows(v.spark, path)


_UPDATED = """
SELECT a.article_id, a.article_link, a.article_title,
       COALESCE(d.text, a.article_content) AS article_content,
       COALESCE(d.source, a.article_genre) AS article_genre
FROM articles_v a LEFT JOIN (
  SELECT 'https://news.example/articles/' || CAST(doc_id AS STRING) AS article_link, text, source
  FROM documents WHERE doc_id % 3 <> 1) d ON d.article_link = a.article_link"""
_ARTICLE_PARTS = 16


def _articles_and_fetched(v):
    batch = v.documents.where(F.col("doc_id") % 3 != 1).select(
        "doc_id", F.concat(F.lit("https://news.example/articles/"), F.col("doc_id").cast("string")).alias("article_link"),
        F.col("text").alias("article_content"), F.col("source").alias("article_genre"),
        F.lit(None).cast("string").alias("article_title"))
    target = v.articles_v.select("article_id", "article_link", "article_title", "article_content", "article_genre")
    return target, batch


@register("update_matched", views=("articles_v",), oracle=_UPDATED)
def update_matched(v):
    """Fill articles from later-fetched documents; only present attributes overwrite."""
    target, batch = _articles_and_fetched(v)
    return maintain.update_matched(target, batch, "article_link",
                                   ["article_title", "article_content", "article_genre"], order="doc_id")


@register("update_stored_parts", views=("articles_v",), oracle=_UPDATED)
def update_stored_parts(v):
    """B02 on a stored table: only the parts that hold a fetched article are read and replaced."""
    target, batch = _articles_and_fetched(v)
    path = scratch_path(v.spark, "articles")
    parts.write(target, path, ["article_link"], _ARTICLE_PARTS)
    parts.update(batch, path, scratch_path(v.spark, "fetched"), "article_link",
                 ["article_title", "article_content", "article_genre"], "doc_id", _ARTICLE_PARTS)
    return parts.read(v.spark, path).select(*target.columns)


@register("latest_run", views=(), oracle="""
SELECT event_type, event_id, ts FROM (
  SELECT event_type, event_id, ts,
         ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) t
WHERE rn = 1""")
def latest_run(v):
    """Newest row per group (here: per event type)."""
    return maintain.latest_per_group(v.events, "event_type", ["ts", "event_id"], ["event_id", "ts"])


_RUN_SETTINGS = ["state_dim", "k_max", "kind"]
_RUNS = """SELECT event_id, 2 + event_id % 4 AS state_dim, CASE event_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE 50 END AS k_max,
       event_type AS kind, ts AS created FROM {events}"""


@register("run_registry", oracle=f"""
WITH runs AS ({_RUNS.replace('{events}', 'events')}),
firsts AS (SELECT * FROM (SELECT *, event_id * 5 >= (SELECT MAX(event_id) FROM events) AS later,
             ROW_NUMBER() OVER (PARTITION BY state_dim, k_max, kind ORDER BY event_id) AS rn FROM runs) t WHERE rn = 1)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY later, created, state_dim, k_max, kind) AS BIGINT) AS run_id,
       state_dim, k_max, kind, created,
       ROW_NUMBER() OVER (ORDER BY later DESC, created DESC, state_dim DESC, k_max DESC, kind DESC) = 1 AS newest
FROM firsts""")
def run_registry(v):
    """Runs recorded in two waves; settings that are recorded already are rejected, and
    the newest run is marked."""
    runs = v.spark.sql(_RUNS, events=v.events)
    top = v.events.agg(F.max("event_id")).first()[0] or 0
    wave = F.col("event_id") * 5 >= top
    empty = runs.select(F.lit(0).cast("long").alias("run_id"), *_RUN_SETTINGS, "created").limit(0)
    recorded = empty
    for part in (runs.where(~wave), runs.where(wave)):
        first = maintain.first_per_key(part, _RUN_SETTINGS, ["event_id"])
        recorded = maintain.record_runs(recorded, first.withColumn("run_id", F.lit(None).cast("long"))
                                        .select(*empty.columns), _RUN_SETTINGS)
    recorded = materialize(recorded)
    newest = recorded.select(F.max("run_id")).scalar()
    return recorded.withColumn("newest", F.col("run_id") == newest)


@register("merged_comment_sources", views=("comments_v",), oracle=f"""
WITH src AS (
  SELECT 0 AS prio, 'article_page' AS origin, comment_id, article_id, user_link, comment_content
  FROM comments_v WHERE comment_id % 3 <> 0
  UNION ALL
  SELECT 1 AS prio, 'user_page' AS origin, comment_id, article_id, user_link, comment_content
  FROM comments_v WHERE comment_id % 3 <> 1)
SELECT origin, comment_id, article_id, user_link, comment_content FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id, user_link, comment_content
                               ORDER BY prio, comment_id) AS rn FROM src WHERE NOT ({_NK})) t WHERE rn = 1
UNION ALL SELECT origin, comment_id, article_id, user_link, comment_content FROM src WHERE {_NK}""")
def merged_comment_sources(v):
    """Comments from article pages and user pages in one deduplicated table."""
    c = v.comments_v.select("comment_id", *KEY)
    art = c.where(F.col("comment_id") % 3 != 0)
    usr = c.where(F.col("comment_id") % 3 != 1)
    return maintain.merge_sources([("article_page", art), ("user_page", usr)], KEY, ["comment_id"])


_KIND_SQL = """CASE WHEN has_anchor THEN 'article_header' WHEN has_reply_count THEN 'comment'
                    WHEN has_text THEN 'reply' WHEN has_reply_link THEN 'parent_link'
                    WHEN has_reply_text THEN 'deleted_parent' ELSE 'other' END"""

_PAIRS_SQL = f"""
SELECT section, block_id AS reply_block_id, prev_link AS parent_link FROM (
  SELECT section, block_id, kind,
         LAG(kind) OVER (PARTITION BY section ORDER BY seq) AS prev_kind,
         LAG(reply_link) OVER (PARTITION BY section ORDER BY seq) AS prev_link
  FROM (SELECT *, {_KIND_SQL} AS kind FROM blocks_v) b) t
WHERE kind = 'reply' AND prev_kind = 'parent_link'"""


@register("reply_parent_pairs", views=("blocks_v",), oracle=_PAIRS_SQL)
def reply_parent_pairs(v):
    """Each reply paired with the parent link directly above it."""
    return training.reply_parent_pairs(v.blocks_v.withColumn("kind", S.block_kind()))


@register("resolve_parent_ids", views=("blocks_v", "comments_v"), oracle=f"""
WITH known AS MATERIALIZED (SELECT comment_id, parent_comment_id FROM comments_v),
links AS MATERIALIZED (SELECT reply_block_id, TRY_CAST(regexp_extract(parent_link, '/comments/([0-9]+)$', 1) AS BIGINT) AS parent
                       FROM ({_PAIRS_SQL}) p),
found AS MATERIALIZED (SELECT l.reply_block_id AS comment_id, l.parent AS new_parent
                       FROM links l SEMI JOIN known c ON c.comment_id = l.parent)
SELECT c.comment_id, COALESCE(f.new_parent, c.parent_comment_id) AS parent_comment_id
FROM known c LEFT JOIN found f ON f.comment_id = c.comment_id""")
def resolve_parent_ids(v):
    """Parent comment ids found later on user pages, set by comment id."""
    pairs = training.reply_parent_pairs(v.blocks_v.withColumn("kind", S.block_kind()))
    linked = pairs.select(F.col("reply_block_id").alias("comment_id"),
                          training.link_to_comment_id("parent_link").alias("parent_comment_id"))
    known = v.comments_v.select(F.col("comment_id").alias("parent_comment_id"))
    found = linked.join(known, "parent_comment_id", "left_semi")
    target = v.comments_v.select("comment_id", "parent_comment_id")
    return maintain.update_matched(target, found, "comment_id", ["parent_comment_id"], order="parent_comment_id")


@register("carry_article_forward", views=("blocks_v",), oracle="""
SELECT block_id, section, seq,
       LAST_VALUE(article_id IGNORE NULLS) OVER (PARTITION BY section ORDER BY seq
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_article_id
FROM blocks_v""")
def carry_article_forward(v):
    """The latest article header carried down to the blocks below it."""
    b = v.blocks_v.select("block_id", "section", "seq", "article_id")
    return training.carry_article_forward(b).select("block_id", "section", "seq", "current_article_id")


_ORDER = "ORDER BY normalized_posted_time, comment_id DESC"


def _r6_all(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@register("next_state_pairs", views=("vectors_v",), oracle=f"""
SELECT user_id, comment_id, {_r6_all(['p0', 'p1', 'p2', 'q0', 'q1', 'q2', 's0', 's1', 's2', 'y0', 'y1', 'y2'])}
FROM (SELECT user_id, comment_id, a0 AS p0, a1 AS p1, a2 AS p2,
             COALESCE(p0, 0.0) AS q0, COALESCE(p1, 0.0) AS q1, COALESCE(p2, 0.0) AS q2, s0, s1, s2,
             LEAD(s0) OVER (PARTITION BY user_id {_ORDER}) AS y0,
             LEAD(s1) OVER (PARTITION BY user_id {_ORDER}) AS y1,
             LEAD(s2) OVER (PARTITION BY user_id {_ORDER}) AS y2
      FROM vectors_v) t
WHERE y0 IS NOT NULL""")
def next_state_pairs(v):
    """W02 (+H05): (article, parent, state) at t with the state at t+1."""
    pairs = training.next_state_pairs(v.vectors())
    return _flat(pairs.select("user_id", "comment_id", "p", "q", "s", "y"), ["p", "q", "s", "y"])


def _flat(df, vec_cols, places=6):
    """Vectors as rounded scalar columns (x0, x1, x2) for comparison."""
    keep = [c for c in df.columns if c not in vec_cols]
    out = [F.col(c) for c in keep]
    for c in vec_cols:
        out += [F.round(F.col(c)[i], places).alias(f"{c}{i}") for i in range(3)]
    return df.select(*out)


@register("user_step_index", views=("vectors_v",), oracle=f"""
SELECT user_id, comment_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id {_ORDER}) - 1 AS BIGINT) AS step
FROM vectors_v""")
def user_step_index(v):
    """Step index per user, oldest first, ties by the larger id first."""
    rows = v.vectors_v.select("user_id", "comment_id", "normalized_posted_time")
    return training.sequence.with_index(rows, "user_id", training.comment_order(), "step").select(
        "user_id", "comment_id", "step")


@register("train_val_split", views=("vectors_v",), oracle="""
SELECT user_id, comment_id,
       CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY md5(CAST(comment_id AS STRING)), comment_id) - 1
                 < floor(COUNT(*) OVER (PARTITION BY user_id) * 8 / 10) THEN 'train' ELSE 'val' END AS split
FROM vectors_v""")
def train_val_split(v):
    """Exact 80/20 split per user in md5 order."""
    return training.train_val_split(v.vectors_v.select("user_id", "comment_id"))


def _pred_sql(a="a", q="q", s="s"):
    from .sqlgen import matvec
    rows = []
    for i in range(3):
        wp = matvec("wp", [f"{a}{j}" for j in range(3)])[i]
        wq = matvec("wq", [f"{q}{j}" for j in range(3)])[i]
        ws = matvec("ws", [f"{s}{j}" for j in range(3)])[i]
        rows.append(f"tanh({wp} + {wq} + {ws} + b_{i})")
    return rows


_LIN = _pred_sql()


@register("aligned_predictions", views=("vectors_v", "weights_v"), oracle=f"""
WITH pr AS (
  SELECT v.user_id, v.comment_id, v.normalized_posted_time,
         {_LIN[0]} AS e0, {_LIN[1]} AS e1, {_LIN[2]} AS e2
  FROM (SELECT user_id, comment_id, normalized_posted_time, a0, a1, a2,
               COALESCE(p0, 0.0) AS q0, COALESCE(p1, 0.0) AS q1, COALESCE(p2, 0.0) AS q2, s0, s1, s2
        FROM vectors_v) v JOIN weights_v w ON w.user_id = v.user_id)
SELECT user_id, comment_id,
       round(COALESCE(LAG(e0) OVER (PARTITION BY user_id {_ORDER}), 2.0), 6) AS aligned_pred0,
       round(COALESCE(LAG(e1) OVER (PARTITION BY user_id {_ORDER}), 2.0), 6) AS aligned_pred1,
       round(COALESCE(LAG(e2) OVER (PARTITION BY user_id {_ORDER}), 2.0), 6) AS aligned_pred2
FROM pr""")
def aligned_predictions(v):
    """The linear prediction made at t shown on row t+1; first row [2, 2, 2]."""
    rows = v.vectors().join(v.weights(), "user_id")
    rows = rows.withColumn("pred", dynamics.linear_step(
        "article_vec", F.coalesce(F.col("parent_vec"), A.zeros(3)), "comment_vec", d=STATE_DIM))
    out = training.aligned_predictions(rows.select("user_id", "comment_id", "normalized_posted_time", "pred"),
                                       "pred")
    return _flat(out.select("user_id", "comment_id", "aligned_pred"), ["aligned_pred"])


@register("sentiment_series", views=("vectors_v",), oracle="""
SELECT comment_id, user_id, normalized_posted_time, round(s0 - s2, 6) AS sentiment FROM vectors_v""")
def sentiment_series(v):
    """Sentiment scalar v[0] - v[2]."""
    x = v.vectors()
    return x.select("comment_id", "user_id", "normalized_posted_time",
                    F.round(F.col("comment_vec")[0] - F.col("comment_vec")[2], 6).alias("sentiment"))


@register("vector_table_roundtrip", views=("vectors_v",), oracle="""
SELECT comment_id, user_id, parent_comment_id, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2,
       round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2,
       p0 IS NULL AS parent_missing FROM vectors_v""")
def vector_table_roundtrip(v):
    """Vector rows written to Parquet (typed NULL array for a missing parent) and read back."""
    spark = v.spark
    rows = v.vectors().select("comment_id", "user_id", "parent_comment_id",
                              F.col("comment_vec").alias("s"),
                              F.when(F.col("parent_vec").isNotNull(), F.col("parent_vec"))
                              .cast("array<double>").alias("p"))
    path = scratch_path(spark, "vectors")
    rows.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return _flat(back, ["s", "p"]).withColumn("parent_missing", F.col("p0").isNull())


_SCRAPED = """SELECT c.comment_id, c.article_id, c.user_link, c.comment_content, n.number_text AS agreements_text,
       t.time_text AS posted_text, t.base_time AS scraped_time
FROM {comments_v} c JOIN {number_text_v} n ON n.id = c.comment_id JOIN {time_text_v} t ON t.id = c.comment_id"""


@register("stream_ingest_comments", views=("comments_v", "number_text_v", "time_text_v"), oracle=f"""
WITH nums AS (SELECT id, number_text, {NUM_ORACLE} AS value FROM number_text_v),
times AS ({TIME_ORACLE}),
good AS (SELECT c.comment_id, c.article_id, c.user_link, c.comment_content, n.value AS agreements_count,
                t.normalized_time AS normalized_posted_time
         FROM comments_v c JOIN nums n ON n.id = c.comment_id JOIN times t ON t.id = c.comment_id
         WHERE n.value IS NOT NULL AND t.normalized_time IS NOT NULL)
SELECT comment_id, article_id, user_link, comment_content, agreements_count, normalized_posted_time FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id, user_link, comment_content ORDER BY comment_id) AS rn
  FROM good WHERE NOT ({_NK})) t WHERE rn = 1
UNION ALL
SELECT comment_id, article_id, user_link, comment_content, agreements_count, normalized_posted_time
FROM good WHERE {_NK}""")
def stream_ingest_comments(v):
    """Scraped comments arrive in two waves; the stream runs after each wave and once more
    with nothing new. The sink must equal one normalised first-write-wins load."""
    from ..streaming.ingest import read_sink, run_ingest

    spark = v.spark
    scraped = spark.sql(_SCRAPED, comments_v=v.comments_v, number_text_v=v.number_text_v, time_text_v=v.time_text_v)
    base = scratch_path(spark, "ingest")
    source, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    top = v.events.agg(F.max("event_id")).first()[0] or 0
    for wave in (F.col("comment_id") * 2 < top, F.col("comment_id") * 2 >= top):
        scraped.where(wave).write.mode("append").parquet(source)
        run_ingest(spark, source, sink, ckpt, scraped.schema)
    run_ingest(spark, source, sink, ckpt, scraped.schema)   # nothing new: adds nothing
    return read_sink(spark, sink).select("comment_id", *KEY, "agreements_count", "normalized_posted_time")


@register("stream_late_parents", views=("comments_v",), oracle="""
SELECT c.comment_id, p.comment_id AS parent_comment_id
FROM comments_v c LEFT JOIN (SELECT comment_id FROM comments_v WHERE article_id IS NOT NULL) p
  ON p.comment_id = c.parent_comment_id""")
def stream_late_parents(v):
    """S01 + D12: all replies are scraped before the comments that reply to nothing; each waits in the state
    store for its parent. After both waves the links equal one join over all comments; a comment
    without an article (K20) is no parent."""
    from ..streaming import late_parents

    spark = v.spark
    scraped = v.comments_v.select("comment_id", "parent_comment_id", F.col("article_id").isNotNull().alias("usable"),
                                  F.col("scraped_time").cast("timestamp").alias("scraped_time"))
    base = scratch_path(spark, "late-parents")
    for wave in (F.col("parent_comment_id").isNotNull(), F.col("parent_comment_id").isNull()):
        scraped.where(wave).write.mode("append").parquet(f"{base}/source")
        late_parents.run(spark, f"{base}/source", f"{base}/sink")
    return late_parents.read_threads(spark, f"{base}/sink")


@register("scan_user_slice", views=("vectors_v",), oracle=f"""
SELECT comment_id, user_id, normalized_posted_time, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2
FROM vectors_v
WHERE user_id = (SELECT user_id FROM vectors_v GROUP BY user_id ORDER BY COUNT(*) DESC, user_id LIMIT 1)
{_ORDER}""")
def scan_user_slice(v):
    """One user's vector rows in sequence order (the user with the most rows)."""
    x = v.vectors_v
    busiest = (x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.col("n").desc(), "user_id").limit(1).select("user_id").scalar())
    out = S.slice_by(x, "user_id", busiest, training.comment_order())
    return out.select("comment_id", "user_id", "normalized_posted_time",
                      *[F.round(c, 6).alias(c) for c in ("s0", "s1", "s2")])
