"""Ranked search against scoring every document, with many small shards and blocks."""
import random
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from llm_tables import docs  # noqa: F401

from forumlens.llm import ranked_search
from forumlens.llm.decontaminate import words_of
from forumlens.llm.ranked_search import PostingBlocks, Shard, search

ITEMS = "item_id string, text string"


def plain(texts, queries, k):
    """(query, rank, key, score) from every document's score."""
    bags = [(key, Counter(words_of((t or "").encode()))) for key, t in texts]
    bags = [(key, bag) for key, bag in bags if bag]
    total, held = sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for query, text in queries:
        scored = []
        for key, bag in bags:
            m = 10 + 90 * sum(bag.values()) * len(bags) // total
            score = sum(floor(1000 * log((2 * len(bags) + 2) / (2 * held[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in set(words_of((text or "").encode())) if t in bag)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(query, at + 1, row[3], -row[0]) for at, row in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return sorted(out, key=str)


@pytest.fixture
def texts():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(n, " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 40])))) for n in range(400)]
    rows += [(900 + n, rows[7][1]) for n in range(60)] + [(950, rows[7][1])] * 5
    return rows + [(1000, None), (1001, ""), (1002, "?!"), (None, rows[8][1]), (None, rows[8][1]), (5, "w1 " * 3000)]


def found(out):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=str)


@pytest.mark.parametrize("setting", [
    dict(), dict(shard_postings=50, sample_docs=40), dict(block_queries=2, max_terms=3, k=3), dict(k=1000)])
def test_as_scoring_every_document(spark, docs, texts, setting, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 4)
    queries = [("a", texts[7][1]), ("a", texts[7][1]), ("b", "w1 W2 w3, w1"), ("c", texts[20][1] + " unseen"),
               ("d", None), ("e", "unseen"), (None, texts[8][1])]
    got = found(search(docs(texts).repartition(3), spark.createDataFrame(queries, ITEMS), **setting))
    assert got == plain(texts, queries, setting.get("k", 10))


def test_a_term_in_every_document_may_weigh_nothing(spark, docs):
    rows = [(n, "same") for n in range(2000)]
    queries = [("a", "same")]
    assert found(search(docs(rows), spark.createDataFrame(queries, ITEMS))) == plain(rows, queries, 10) == []


def test_empty_tables_and_other_columns(spark, docs):
    items = spark.createDataFrame([("a", "x")], ITEMS)
    assert search(docs([]), items).collect() == []
    assert search(docs([(1, "x")]), items.limit(0)).collect() == []
    table = docs([(1, "x y"), (2, "z"), (3, "y")]).withColumnRenamed("lang", "score").withColumnRenamed("source", "key")
    assert [(r["rank"], r.doc_id) for r in search(table, items).collect()] == [(1, 1)]


def test_summaries_are_largest_impacts_and_bound_the_scores():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 9, 300)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate([np.sort(rng.choice(20, s, replace=False)) for s in sizes])
    shard = Shard(None, sizes * 3, starts, terms, rng.integers(1, 5, len(terms)), 300, int(sizes.sum()) * 3)
    weights = rng.integers(0, 9000, 20)
    for term in range(20):
        blocks = PostingBlocks(shard, shard.postings(term)[0], np.ones(20, bool))
        bounds = blocks.bounds(np.arange(20), weights)
        members = [blocks.members(np.array([b])) for b in range(blocks.size)]
        assert sorted(np.concatenate(members)) == sorted(shard.postings(term)[0])
        for bound, inside in zip(bounds, members):
            largest = np.zeros(20, dtype=np.int64)
            _, t, impact = shard.entries(inside)
            np.maximum.at(largest, t, impact)
            assert bound == largest @ weights and bound >= shard.scores(inside, weights).max()
