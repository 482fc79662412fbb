"""The registered queries: each applies one operator to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from ..sources.tables import read_table
from .common import documents, prepared

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_digest, write_token_files

    prepared(spark)
    files = write_token_files(documents(spark, sf_dir), scratch_path(spark, "tokens"), vocabulary_path())
    return token_digest(files)


def span_text(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data

    prepared(spark)
    return span_digest(find_personal_data(documents(spark, sf_dir)), KINDS)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken_words

    prepared(spark)
    return taken_words(mix(documents(spark, sf_dir)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    prepared(spark)
    found = contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    prepared(spark)
    return scan_licenses(documents(spark, sf_dir))


def op6_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph_ann import build_index, nearest

    prepared(spark)
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(build_index(vectors), vectors.where("vec_id % 100 = 0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    prepared(spark)
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import delete_common_blocks

    prepared(spark)
    docs = documents(spark, sf_dir)
    return delete_common_blocks(docs).select("doc_id", "lines_deleted", "text")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify_languages

    prepared(spark)
    docs = documents(spark, sf_dir)
    found = identify_languages(docs, docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, find_secrets

    prepared(spark)
    return span_digest(find_secrets(documents(spark, sf_dir)), KINDS[:3])


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score_texts

    prepared(spark)
    return score_texts(documents(spark, sf_dir)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import search

    prepared(spark)
    found = search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    prepared(spark)
    drawn = resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_personal_data": op2_personal_data,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_licenses": op5_licenses,
    "op6_graph_ann": op6_graph_ann,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_language": op9_language,
    "op10_secrets": op10_secrets,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_ranked_search": op12_ranked_search,
    "op13_importance_resampling": op13_importance_resampling,
}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op4_sql() -> str:
    words = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH item AS (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM item WHERE len(w) > 0) t),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM documents),
gram AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
         FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
               FROM doc JOIN (SELECT DISTINCT n FROM win) l ON len(w) >= n) t),
hit AS (SELECT r, s, n, item_id FROM gram JOIN win USING (n, k)),
covered AS (SELECT r, COUNT(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit) a) b GROUP BY r),
found AS (SELECT r, COUNT(DISTINCT item_id) AS n_items,
                 sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items
          FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""


def _op5_sql() -> str:
    from .licenses import TEMPLATES, THRESHOLD

    words = f"string_split(trim(regexp_replace(translate(body, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    quoted = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in TEMPLATES)
    return f"""
WITH template AS (SELECT license, body, {grams} AS g FROM (SELECT *, {words} AS w FROM (VALUES {quoted}) t(license, body)) t),
line AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
unit AS (SELECT r, doc_id, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS body FROM line
         UNION ALL SELECT r, doc_id, -1 AS line, text AS body FROM line WHERE len(lines) > 1),
passage AS (SELECT r, doc_id, line, {grams} AS g FROM (SELECT r, doc_id, line, {words} AS w FROM unit) u),
common AS (SELECT p.r, p.doc_id, p.line, len(p.g) AS n, t.license, t.body, len(t.g) AS m, COUNT(*) AS c
           FROM (SELECT r, doc_id, line, g, unnest(g) AS gram FROM passage) p
           JOIN (SELECT license, body, g, unnest(g) AS gram FROM template) t USING (gram)
           GROUP BY ALL),
scored AS (SELECT r, doc_id, line, license, 2 * c / (n + m) AS dice FROM common WHERE 2 * c / (n + m) >= {THRESHOLD})
SELECT doc_id, CAST(line AS INTEGER) AS line, license, dice FROM (
  SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, license) AS rn FROM scored) s WHERE rn = 1"""


def _words_sql(column: str) -> str:
    return f"regexp_extract_all(translate({column}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _op12_sql() -> str:
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
posting AS (SELECT r, term, COUNT(*) AS tf FROM (SELECT r, unnest(w) AS term FROM doc) t GROUP BY r, term),
sizes AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM doc WHERE len(w) > 0),
total AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS words FROM sizes),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * COUNT(*) + 1)::DOUBLE)) AS BIGINT) AS w
           FROM posting, total GROUP BY term, docs),
item AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_words_sql("text")}) AS w FROM benchmark),
scored AS (SELECT i, r, doc_id, CAST(SUM(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
           FROM (SELECT i, unnest(w) AS term FROM item) q JOIN weight USING (term) JOIN posting USING (term)
                JOIN sizes USING (r), total
           GROUP BY i, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) s
     JOIN item USING (i) WHERE rank <= 10"""


def _op13_sql() -> str:
    return f"""
WITH tbl AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_words_sql("text")}, []) AS w FROM documents),
doc_word AS (SELECT r, word, COUNT(*) AS n FROM (SELECT r, unnest(w) AS word FROM doc) t GROUP BY r, word),
item_word AS (SELECT word, COUNT(*) AS n FROM (SELECT unnest({_words_sql("text")}) AS word FROM benchmark) t GROUP BY word),
word AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM doc_word UNION SELECT word FROM item_word) u),
bucket AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
             lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1]))) % 10000 AS bucket FROM word, tbl),
source AS (SELECT bucket, SUM(n) AS s FROM doc_word JOIN bucket USING (word) GROUP BY bucket),
target AS (SELECT bucket, SUM(n) AS t FROM item_word JOIN bucket USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(SUM(s), 0) FROM source) + 10000))::DOUBLE
           / ((coalesce(s, 0) + 1) * ((SELECT coalesce(SUM(t), 0) FROM target) + 10000))::DOUBLE)) AS BIGINT) AS gain
         FROM (SELECT range AS bucket FROM range(10000)) b LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket)),
weight AS (SELECT r, CAST(SUM(n * gain) AS BIGINT) AS weight FROM doc_word JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
               + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
           FROM doc LEFT JOIN weight USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20),
size AS (SELECT 10 * COUNT(*) // 100 AS k FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (r), size"""


ORACLE_SQL: dict[str, str] = {"op4_decontamination": _op4_sql(), "op5_licenses": _op5_sql(),
                              "op12_ranked_search": _op12_sql(), "op13_importance_resampling": _op13_sql()}
