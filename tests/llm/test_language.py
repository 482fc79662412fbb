"""Language profiles: hand-made cases and held-out accuracy."""
from conftest import SMALL
from llm_tables import docs  # noqa: F401

from forumlens.llm.language import grams_of, held_out, identify_languages, profile_of
from forumlens.sources.tables import read_table

EN = "the cat and the dog are in the house with the other animals that they know"
DE = "die katze und der hund sind in dem haus mit den anderen tieren die sie kennen"


def pack(gram):
    value = 0
    for c in gram:
        value = value << 21 | (1 if c == "_" else ord(c))
    return value


def test_grams_and_ranks():
    grams, counts = grams_of("Ab ab")
    assert dict(zip(grams.tolist(), counts.tolist())) == {
        pack("a"): 2, pack("b"): 2, pack("_a"): 2, pack("ab"): 2, pack("b_"): 2, pack("_ab"): 2, pack("ab_"): 2}
    grams, places = profile_of("aab", 3)
    assert grams.tolist()[0] == pack("a") and places.tolist() == [0, 1, 1]


def test_cases(spark, docs):
    training = docs([(k, EN if k % 2 else DE, "en" if k % 2 else "de") for k in range(20)] + [(99, EN, None)])
    asked = docs([(1, "the dogs and cats"), (2, "der hund und die katze"), (3, None), (4, "123 !!"), (5, ""),
                  (1, "the dogs and cats"), (None, EN * 200)])
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in identify_languages(asked, training).collect()),
                 key=lambda r: (r[0] is None, r[0] or 0))
    assert [g[:2] for g in got] == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en")]
    assert all(0 <= g[2] <= 1 for g in got) and got[0] == got[1] and got[3][2] == 0


def test_no_training_and_empty(spark, docs):
    assert [r.lang_pred for r in identify_languages(docs([(1, EN)]), docs([])).collect()] == ["und"]
    assert identify_languages(docs([]), docs([(1, EN, "en")])).collect() == []


def test_kept_columns_with_clashing_names(spark, docs):
    rows = docs([(1, EN, "en", "s")]).withColumnRenamed("n_chars", "score")
    got = identify_languages(rows, rows, keep=("doc_id", "source", "score")).collect()[0]
    assert got.asDict().keys() == {"doc_id", "source", "lang_pred", "score"} and got.lang_pred == "en"


def test_held_out_accuracy(spark):
    table = read_table(spark, SMALL, "documents")
    found = identify_languages(table, table.where(~held_out()), keep=("doc_id", "lang")).where(held_out())
    rows = [r for r in found.collect() if r.lang]
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
