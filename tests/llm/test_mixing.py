"""The mix against its targets, its schedule and its own parts."""
import re
from collections import Counter

import pytest
from llm_tables import docs  # noqa: F401

from forumlens.llm.mixing import mix, mixed_documents, taken_parts, taken_words


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Source -> target by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, total, capped = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in capped]
        rate = (total - sum(3 * sizes[s] for s in capped)) / (sum(weight[s] for s in left) or 1)
        above = {s for s in left if rate * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else rate * weight[s] for s in order}
        capped |= above


ROWS = ([(k, "w " * (k % 37 + 1), None, f"s{k % 5}") for k in range(300)]
        + [(1000 + k, " x\ty\n" * 40, None, None) for k in range(10)]
        + [(2000, "few words", None, "Z"), (2001, None, None, "s1"), (2002, "", None, "empty"), (2003, " \t", None, "é"),
           (3000, "long " * 20_000, None, "s2"), (5, "w " * 6, None, "s0"), (None, "no key here", None, "s0")])


@pytest.mark.parametrize("block", [7, 1024])
def test_taken_words(spark, docs, block):
    found = mix(docs(ROWS), block=block)
    got = taken_words(found).collect()
    sizes = Counter()
    for _, text, _, source in ROWS:
        sizes[source] += words(text)
    targets = plain_targets(sizes)
    by_key = {(r.doc_id, r.size): r for r in got}
    assert len(got) == len(ROWS)
    for key, text, _, source in ROWS:
        r = by_key[key, words(text)]
        assert r.size == words(text) and r.source_size == sizes[source]
        assert r.target == pytest.approx(targets[source]) and 0 <= r.taken <= 3 * r.size
    source_of = {t.src: t.source for t in found.targets.collect()}
    taken = Counter()
    for p in taken_parts(found).join(found.sizes, "__row").collect():
        taken[source_of[p.src]] += p.words
        assert p.words > 0 and p["first"] + p.words <= p["size"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 0.5 + 1e-9
    assert sum(r.taken for r in got) == sum(taken.values())
    again = {(r.doc_id, r.size): r.taken for r in taken_words(mix(docs(ROWS).repartition(7), block=block)).collect()}
    assert again == {k: r.taken for k, r in by_key.items()}


def test_schedule_is_spread_evenly(spark, docs):
    """After any number of slots a source has had its share of them, but for a few."""
    found = mix(docs([(k, "w " * 50, None, f"s{k % 4}") for k in range(400)]), block=10)
    slots = sorted(found.schedule.collect(), key=lambda r: r.slot)
    share = {r.src: r.slots / len(slots) for r in found.targets.collect()}
    seen = Counter()
    for n, r in enumerate(slots, 1):
        seen[r.src] += 1
        assert all(abs(seen[s] - n * share[s]) < 6 for s in share)
    ranks = Counter()
    blocks = {r.src: r.blocks for r in found.targets.collect()}
    for r in slots:
        assert r["round"] * blocks[r.src] + r.block == ranks[r.src]
        ranks[r.src] += 1


def test_mixed_documents(spark, docs):
    rows = [*ROWS, (5, "w " * 6, None, "s0")]
    got = mixed_documents(docs(rows)).collect()
    copies = Counter((r.doc_id, r.text) for r in got)
    sizes, taken = Counter(), Counter()
    for _, text, _, source in rows:
        sizes[source] += words(text)
    source_of = {(k, t): s for k, t, _, s in rows}
    repeats = Counter((k, t) for k, t, _, _ in rows)
    for (key, text), n in copies.items():
        assert n <= 3 * repeats[key, text]
        taken[source_of[key, text]] += n * words(text)
    longest = {s: max(words(t) for _, t, _, x in rows if x == s) for s in sizes}
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= longest[source] + 1
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_empty(spark, docs):
    assert taken_words(mix(docs([]))).collect() == []
    assert mixed_documents(docs([])).collect() == []
    assert [r.taken for r in taken_words(mix(docs([(1, None)]))).collect()] == [0]


def test_clashing_columns(spark, docs):
    rows = docs(ROWS[:50]).withColumnRenamed("n_chars", "size").withColumnRenamed("lang", "slot")
    assert taken_words(mix(rows)).count() == 50 and mixed_documents(rows).columns == rows.columns


def test_repeated_rows_come_as_often_as_they_start(spark, docs):
    one, two = "a b c d e f", "g h i j k l"
    rows = docs([(1, one, "en", "s"), (1, one, "en", "s"), (2, two, "en", "t")])  # s: 6 of its 12 words
    got = [(r.doc_id, r.source) for r in mixed_documents(rows).collect()]
    assert sorted(got) == [(1, "s"), (2, "t"), (2, "t")]
    rows = docs([(1, one, "en", "s"), (1, one, "en", "t"), (1, one, "en", "t"), (None, two, "en", None), (None, two, "en", None)])
    found = mix(rows)
    starts = taken_parts(found).where("first = 0").join(found.sizes, "__row").groupBy("key", "source").count()
    want = {(r.key, r.source): r["count"] for r in starts.collect()}
    got = mixed_documents(rows).groupBy("doc_id", "source").count()
    assert {(r.doc_id, r.source): r["count"] for r in got.collect()} == want and len(want) == 3
