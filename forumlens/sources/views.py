"""Discussion tables derived from the input tables.

Each view is one SQL text rendered for two dialects: Spark SQL (executed here with
the input DataFrames bound as ``{name}`` parameters) and DuckDB (used as an
independent oracle). Only integer and IEEE arithmetic on input columns is used, so
both engines see identical rows. The views stand in for the crawled tables
(articles, users, comments, page blocks, texts to normalise, vector tables, step
graph); every one of them reads its whole input tables and grows with them.

An event's article is the square of its id modulo a number a little above the number of
documents, so articles differ in their comments and some events have an absent article. In the step graph a user's node has one step
per comment of the user, and an article's node one step per comment on the article; node
ids are even for articles and odd for users.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

SPARK = "spark"
DUCKDB = "duckdb"


def _ntz(expr: str, d: str) -> str:
    return f"CAST({expr} AS TIMESTAMP_NTZ)" if d == SPARK else expr


def _ts_lit(text: str, d: str) -> str:
    return f"TIMESTAMP_NTZ '{text}'" if d == SPARK else f"TIMESTAMP '{text}'"


def _plus_minutes(ts: str, n: str, d: str) -> str:
    if d == SPARK:
        return f"{ts} + make_dt_interval(0, 0, CAST({n} AS INT), 0)"
    return f"{ts} + to_minutes(CAST({n} AS BIGINT))"


def _k(d: str) -> str:  # the integer inside events.props ('{"k": 69}')
    return "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"


# Sizes of input tables that views use: name -> SQL over one table. The oracle has them as
# subqueries, Spark as numbers counted when a view is bound (a subquery in a join key or
# range key is not evaluated before the exchange that needs it).
SIZES = {
    "article_ids": ("SELECT CAST(floor(COUNT(*) * 21 / 20) AS BIGINT) + 1 FROM {documents}", "documents"),
    "conversation_ids": ("SELECT MAX(conv_id) + 1 FROM {conversations}", "conversations"),
}


def _article_id(d: str) -> str:
    rest = f"event_id % {_size('article_ids', d)}"
    return f"CASE WHEN event_id % 97 = 5 THEN NULL ELSE ({rest}) * ({rest}) % {_size('article_ids', d)} END"


def _size(name: str, d: str) -> str:
    return "{" + name + "}" if d == SPARK else f"({SIZES[name][0]})"


def _parent_id() -> str:
    return ("CASE WHEN event_type IN ('view', 'error') AND event_id >= 14 "
            "THEN event_id - 1 - event_id % 13 END")


def _ranked_events(d: str) -> str:
    """Events with their article (``_aid``) and their 0-based rank in time order among the
    events of their user (``_rk``) and of their article (``_ak``). In Spark the events come
    with these columns from the sequence index instead of windows per user and article."""
    if d == SPARK:
        return "{ranked_events}"
    return f"""(
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS _rk,
         CASE WHEN _aid IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY _aid ORDER BY ts, event_id) - 1 END AS _ak
  FROM (SELECT *, {_article_id(d)} AS _aid FROM {{events}}) a)"""


def _user_link(uid: str = "user_id") -> str:
    return f"'https://news.example/users/' || CAST({uid} AS STRING)"


def comments_v(d: str) -> str:
    return f"""
SELECT event_id AS comment_id,
       {_article_id(d)} AS article_id,
       {_parent_id()} AS parent_comment_id,
       e.user_id,
       'user' || CAST(user_id AS STRING) AS username,
       CASE WHEN event_id % 101 = 7 THEN NULL ELSE {_user_link()} END AS user_link,
       {_ntz("date_trunc('minute', ts)", d)} AS normalized_posted_time,
       ts + INTERVAL 1 HOUR AS scraped_time,
       t.text AS comment_content,
       CAST(floor(value) AS INT) AS agreements_count,
       {_k(d)} AS acknowledgements_count,
       CAST(event_id % 11 AS INT) AS disagreements_count
FROM {{events}} e JOIN {{conversations}} t
  ON t.conv_id = event_id % {_size('conversation_ids', d)} AND t.turn = 0"""


def users_v(d: str) -> str:
    return f"""
SELECT user_id,
       'user' || CAST(user_id AS STRING) AS username,
       {_user_link()} AS user_link,
       CAST(COUNT(*) AS BIGINT) AS total_comment_count,
       CAST(SUM(CAST(floor(value) AS INT)) AS BIGINT) AS total_agreements_count,
       MAX(ts) AS scraped_time
FROM {{events}}
WHERE user_id % 10 <> 3
GROUP BY user_id"""


def articles_v(d: str) -> str:
    return f"""
SELECT doc_id AS article_id,
       'https://news.example/articles/' || CAST(doc_id AS STRING) AS article_link,
       'title ' || CAST(doc_id AS STRING) AS article_title,
       CASE WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS article_content,
       CAST(doc_id % 50 + 1 AS INT) AS ranking,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(n_chars % 500 AS INT) END AS comment_count_per_hour,
       lang AS article_genre,
       {_plus_minutes(_ts_lit('2024-02-01 00:00:00', d), 'doc_id', d)} AS scraped_time
FROM {{documents}}"""


def ranking_v(d: str) -> str:
    return """
SELECT 1 AS run_id, article_id, article_link, ranking FROM {articles_v}
UNION ALL
SELECT 2 AS run_id, article_id, article_link, CAST(article_id * 7 % 50 + 1 AS INT) AS ranking
FROM {articles_v}"""


def blocks_v(d: str) -> str:
    # Page blocks of user pages: one section per user, blocks in time order.
    # Marker flags overlap on purpose (comments and replies both carry text),
    # so the kind is decided by the first matching rule.
    return f"""
SELECT event_id AS block_id,
       user_id AS section,
       CAST(_rk + 1 AS BIGINT) AS seq,
       event_type = 'signup' AS has_anchor,
       event_type = 'click' AS has_reply_count,
       event_type IN ('click', 'view') AS has_text,
       event_type = 'purchase' AS has_reply_link,
       event_type IN ('purchase', 'error') AS has_reply_text,
       CASE WHEN event_type = 'signup' THEN _aid END AS article_id,
       CASE WHEN event_type = 'purchase'
            THEN 'https://news.example/comments/' || CAST(event_id - 1 - event_id % 17 AS STRING) END AS reply_link
FROM {_ranked_events(d)} e"""


def number_text_v(d: str) -> str:
    tenths = "CAST(CAST(floor((event_id % 90 + 1) / 10) AS BIGINT) AS STRING) || '.' || CAST((event_id % 90 + 1) % 10 AS STRING)"
    return f"""
SELECT event_id AS id,
       CASE event_id % 6
         WHEN 0 THEN {tenths} || '万'
         WHEN 1 THEN {tenths} || '千'
         WHEN 2 THEN CAST(event_id % 9 + 1 AS STRING) || ',' || lpad(CAST(event_id % 1000 AS STRING), 3, '0')
         WHEN 3 THEN CAST(event_id % 500 AS STRING) || '件'
         WHEN 4 THEN ''
         ELSE 'x' || CAST(event_id AS STRING)
       END AS number_text
FROM {{events}}"""


def time_text_v(d: str) -> str:
    md = ("CAST(event_id % 12 + 1 AS STRING) || '/' || CAST(event_id % 28 + 1 AS STRING) || '(木) ' "
          "|| CAST(event_id % 24 AS STRING) || ':05'")
    return f"""
SELECT event_id AS id,
       ts AS base_time,
       CASE event_id % 6
         WHEN 0 THEN 'たった今'
         WHEN 1 THEN CAST(event_id % 59 + 1 AS STRING) || '分前'
         WHEN 2 THEN CAST(event_id % 23 + 1 AS STRING) || '時間前'
         WHEN 3 THEN CAST(event_id % 6 + 1 AS STRING) || '日前'
         WHEN 4 THEN {md}
         ELSE '2022/' || {md}
       END AS time_text
FROM {{events}}"""


def vectors_v(d: str) -> str:
    a = "(1 + CAST(floor(value) AS INT) % 17)"
    b = f"(1 + {_k(d)} % 13)"
    c = "(1 + event_id % 11)"
    ssum = f"CAST({a} + {b} + {c} AS DOUBLE)"
    asum = "CAST(3 + event_id % 5 + event_id % 7 + event_id % 9 AS DOUBLE)"
    psum = "CAST(3 + event_id % 4 + event_id % 6 + event_id % 8 AS DOUBLE)"
    par = "event_type IN ('view', 'error')"
    return f"""
SELECT event_id AS comment_id,
       user_id,
       {_ntz("date_trunc('minute', ts)", d)} AS normalized_posted_time,
       {_article_id(d)} AS article_id,
       {_parent_id()} AS parent_comment_id,
       {a} / {ssum} AS s0, {b} / {ssum} AS s1, {c} / {ssum} AS s2,
       (1 + event_id % 5) / {asum} AS a0, (1 + event_id % 7) / {asum} AS a1, (1 + event_id % 9) / {asum} AS a2,
       CASE WHEN {par} THEN (1 + event_id % 4) / {psum} END AS p0,
       CASE WHEN {par} THEN (1 + event_id % 6) / {psum} END AS p1,
       CASE WHEN {par} THEN (1 + event_id % 8) / {psum} END AS p2
FROM {{events}}"""


# Weight-formula multipliers per matrix (W_p, W_q, W_s) for row i, column j:
# W[i][j] = ((user_id * m0 + i * m1 + j * m2) % 11 - 5) / 10; b[i] = ((user_id + i) % 5 - 2) / 10.
WEIGHT_MULTIPLIERS = {"wp": (7, 3, 5), "wq": (5, 2, 7), "ws": (3, 7, 2)}
STATE_DIM = 3


def weight_columns() -> list[str]:
    cols = []
    for m in WEIGHT_MULTIPLIERS:
        cols += [f"{m}_{i}_{j}" for i in range(STATE_DIM) for j in range(STATE_DIM)]
    return cols + [f"b_{i}" for i in range(STATE_DIM)]


def weights_v(d: str) -> str:
    exprs = []
    for m, (m0, m1, m2) in WEIGHT_MULTIPLIERS.items():
        for i in range(STATE_DIM):
            for j in range(STATE_DIM):
                exprs.append(
                    f"CAST((user_id * {m0} + {i * m1} + {j * m2}) % 11 - 5 AS DOUBLE) / 10 AS {m}_{i}_{j}")
    for i in range(STATE_DIM):
        exprs.append(f"CAST((user_id + {i}) % 5 - 2 AS DOUBLE) / 10 AS b_{i}")
    return "\nSELECT user_id,\n       " + ",\n       ".join(exprs) + \
        "\nFROM (SELECT DISTINCT user_id FROM {events}) u"


def nodes_v(d: str) -> str:
    a = "(1 + CAST(floor(e.value) AS INT) % 17)"
    b = f"(1 + {_k(d).replace('props', 'e.props')} % 13)"
    c = "(1 + e.event_id % 11)"
    ssum = f"CAST({a} + {b} + {c} AS DOUBLE)"
    first = "e._rk > 0 AND e._aid IS NOT NULL"
    return f"""
SELECT CAST(e.user_id * 2 + 1 AS BIGINT) AS node_id,
       CAST(e._rk AS INT) AS k,
       'user' AS node_type,
       1 AS metadata_id,
       {a} / {ssum} AS x0, {b} / {ssum} AS x1, {c} / {ssum} AS x2,
       CAST((e.user_id * 6 + 3 + e._rk) % 10 AS DOUBLE) / 10 AS strength,
       CASE WHEN {first} THEN CAST(e._aid * 2 AS BIGINT) END AS p1_id,
       CASE WHEN {first} THEN CAST(e._ak AS INT) END AS p1_k,
       CASE WHEN {first} THEN CAST(r.user_id * 2 + 1 AS BIGINT) END AS p2_id,
       CASE WHEN {first} THEN CAST(r._rk AS INT) END AS p2_k
FROM {_ranked_events(d)} e
LEFT JOIN {_ranked_events(d)} r ON r.event_id = {_parent_id().replace('event_id', 'e.event_id').replace('event_type', 'e.event_type')}
UNION ALL
SELECT CAST(dd.doc_id * 2 AS BIGINT) AS node_id,
       CAST(e._ak AS INT) AS k,
       'article' AS node_type,
       1 AS metadata_id,
       CAST((dd.doc_id + e._ak) % 5 - 2 AS DOUBLE) / 2 AS x0,
       CAST((dd.doc_id + e._ak) % 3 - 1 AS DOUBLE) / 1 AS x1,
       CAST((dd.doc_id + e._ak) % 7 - 3 AS DOUBLE) / 3 AS x2,
       CAST((dd.doc_id * 6 + e._ak) % 10 AS DOUBLE) / 10 AS strength,
       CAST(NULL AS BIGINT) AS p1_id, CAST(NULL AS INT) AS p1_k,
       CAST(NULL AS BIGINT) AS p2_id, CAST(NULL AS INT) AS p2_k
FROM {_ranked_events(d)} e JOIN {{documents}} dd ON dd.doc_id = e._aid"""


def labelled_docs_v(d: str) -> str:
    return """
SELECT dd.doc_id, dd.text,
       CASE WHEN l.toxic = 1 THEN 'negative'
            WHEN l.quality = 1 THEN 'positive'
            ELSE 'neutral' END AS label
FROM {documents} dd JOIN {labels} l ON dd.doc_id = l.doc_id"""


# view name -> (sql builder, dependencies)
VIEWS = {
    "comments_v": (comments_v, ("events", "documents", "conversations")),
    "users_v": (users_v, ("events",)),
    "articles_v": (articles_v, ("documents",)),
    "ranking_v": (ranking_v, ("articles_v",)),
    "blocks_v": (blocks_v, ("events", "documents")),
    "number_text_v": (number_text_v, ("events",)),
    "time_text_v": (time_text_v, ("events",)),
    "vectors_v": (vectors_v, ("events", "documents")),
    "weights_v": (weights_v, ("events",)),
    "nodes_v": (nodes_v, ("events", "documents")),
    "labelled_docs_v": (labelled_docs_v, ("documents", "labels")),
}


def _closure(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n not in VIEWS or n in seen:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def duckdb_with(views, body: str) -> str:
    """Oracle SQL: the named views as CTEs in front of ``body``."""
    ctes = []
    for name in _closure(views):
        text = VIEWS[name][0](DUCKDB)
        for dep in VIEWS[name][1]:
            text = text.replace("{" + dep + "}", dep)
        ctes.append(f"{name} AS ({text}\n)")
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + stripped[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Views:
    """Lazily built view DataFrames for one input directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                text = self._with_sizes(VIEWS[name][0](SPARK))
                deps = [dep for dep in (*VIEWS[name][1], "ranked_events") if "{" + dep + "}" in text]
                bound = {dep: self.ranked_events() if dep == "ranked_events" else self.get(dep) for dep in deps}
                self._cache[name] = self.spark.sql(text, **bound)
            else:
                self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def _with_sizes(self, text: str) -> str:
        for size, (query, table) in SIZES.items():
            if "{" + size + "}" in text:
                if size not in self._cache:
                    found = self.spark.sql(query, **{table: self.get(table)}).first()[0]
                    self._cache[size] = max(1, found or 1)  # empty tables: any number will do
                text = text.replace("{" + size + "}", str(self._cache[size]))
        return text

    def ranked_events(self) -> DataFrame:
        """Events with ``_aid``, ``_rk`` and ``_ak`` (see ``_ranked_events``)."""
        if "_ranked" not in self._cache:
            from ..operators import sequence
            order = [F.col("ts").asc(), F.col("event_id").asc()]
            ev = self.spark.sql(self._with_sizes(f"SELECT *, {_article_id(SPARK)} AS _aid FROM {{events}}"),
                                events=self.get("events"))
            by_user = sequence.with_index(ev, "user_id", order, "_rk")
            on_article = sequence.with_index(by_user, "_aid", order, "_ak")
            loose = by_user.where(F.col("_aid").isNull())
            self._cache["_ranked"] = on_article.unionByName(loose, allowMissingColumns=True)
        return self._cache["_ranked"]

    # Array-shaped forms used by the library (the reference's data model).
    def vectors(self) -> DataFrame:
        v = self.get("vectors_v")
        return v.select(
            "comment_id", "user_id", "normalized_posted_time", "article_id", "parent_comment_id",
            F.array("s0", "s1", "s2").alias("comment_vec"),
            F.array("a0", "a1", "a2").alias("article_vec"),
            F.when(F.col("p0").isNotNull(), F.array("p0", "p1", "p2")).alias("parent_vec"),
        )

    def weights(self) -> DataFrame:
        w = self.get("weights_v")
        n = STATE_DIM

        def mat(m):
            return F.array(*[F.array(*[F.col(f"{m}_{i}_{j}") for j in range(n)]) for i in range(n)])

        return w.select("user_id", mat("wp").alias("w_p"), mat("wq").alias("w_q"),
                        mat("ws").alias("w_s"), F.array(*[F.col(f"b_{i}") for i in range(n)]).alias("b"))

    def nodes(self) -> DataFrame:
        """The step graph, written once, for queries that look nodes up several times
        (parents, previous state, targets)."""
        if "_nodes" not in self._cache:
            from ..session import materialize
            self._cache["_nodes"] = materialize(self.graph())
        return self._cache["_nodes"]

    def graph(self) -> DataFrame:
        """The step graph as a plan, for queries that read it once."""
        v = self.get("nodes_v")
        return v.select(
            "node_id", "k", "node_type", "metadata_id",
            F.array("x0", "x1", "x2").alias("state"), "strength",
            F.filter(F.array("p1_id", "p2_id"), lambda x: x.isNotNull()).alias("parent_ids"),
            F.filter(F.array("p1_k", "p2_k"), lambda x: x.isNotNull()).alias("parent_ks"),
        )
