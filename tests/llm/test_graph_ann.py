"""Recall against brute force, and the cases of the contract."""
import math
import random

import numpy as np
from conftest import SMALL

from forumlens.llm.graph_ann import Graph, build_index, nearest
from forumlens.sources.tables import read_table


def plain(rows, queries, k=10):
    out = {}
    for q, x in queries:
        found = sorted({(math.dist(x, y), v) for v, y in rows if v != q and len(y) == len(x)})
        out[q] = found[:k]
    return out


def results(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_on_the_table(spark):
    table = read_table(spark, SMALL, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and None not in r.embedding]
    got = results(nearest(build_index(table), table.where("vec_id % 10 = 0")))
    want = plain(rows, [r for r in rows if r[0] % 10 == 0])
    hit = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert got.keys() == want.keys()


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    points = (centres[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(points)]
    table = vectors(spark, rows)
    index = build_index(table, shard=700)
    assert index.select("shard").distinct().count() == 5 and index.count() == 3000
    got = results(nearest(index, table.where("vec_id % 100 = 0"), query_block=7))
    want = plain(rows, [r for r in rows if r[0] % 100 == 0])
    hit = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hit >= 0.95 * 300
    for q in got:  # scores are exact
        point = points.astype(np.float64)
        assert all(abs(s - math.dist(point[q], point[v])) < 1e-12 for s, v in got[q])


def test_repeated_and_unusable_vectors(spark):
    rng = random.Random(2)
    spread = [(k, [rng.random() for _ in range(4)]) for k in range(50)]
    rows = spread + [(100 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(600)]
    unusable = [(900, None), (901, []), (902, [0.0] * 4), (903, [0.1, None, 0.2, 0.3]),
                (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4)]
    short = [(1000, [1.0, 2.0]), (1001, [1.0, 3.0])]
    table = vectors(spark, rows + unusable + short + [rows[3], (200, [0.5] * 4)]).selectExpr(
        "vec_id", "embedding", "vec_id AS shard", "1 AS dim")
    got = results(nearest(build_index(table, shard=200), table.where("vec_id % 100 = 0 OR vec_id = 901")))
    want = plain([(k, np.float32(x).astype(float).tolist()) for k, x in rows + short],
                 [(k, np.float32(x).astype(float).tolist()) for k, x in rows + short if k % 100 == 0])
    assert got.keys() == want.keys()
    assert got[300] == [(0.0, v) for v in range(100, 110)]
    assert got[100] == [(0.0, v) for v in range(101, 111)]
    assert got[1000] == [(1.0, 1001)]
    assert {q: [v for _, v in f] for q, f in got.items()} == {q: [v for _, v in f] for q, f in want.items()}


def test_repeated_rows_do_not_hide_other_ids(spark):
    rng = random.Random(3)
    spread = [(k, [2 + rng.random() for _ in range(4)]) for k in range(30)]
    rows = spread + [(100, [1.0] * 4)] * 20 + [(101, [1.0] * 4)] * 20 + [(k, [1.0] * 4) for k in range(102, 105)]
    table = vectors(spark, rows)
    got = results(nearest(build_index(table), table.where("vec_id IN (100, 104)").distinct(), k=3))
    assert got == {100: [(0.0, 101), (0.0, 102), (0.0, 103)], 104: [(0.0, 100), (0.0, 101), (0.0, 102)]}


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(4)
    for kind, sizes in (("float", (1e-25, 1.0, 1e30)), ("double", (1e200,)), ("double", (1e-200,))):
        points = np.concatenate([size * rng.normal(size=(40, 4)) for size in sizes]).astype(kind + ("32" if kind == "float" else ""))
        rows = [(k, x.tolist()) for k, x in enumerate(points)]
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got, want = results(nearest(build_index(table), table, k=5)), plain(rows, rows, k=5)
        assert {q: [v for _, v in f] for q, f in got.items()} == {q: [v for _, v in f] for q, f in want.items()}
        assert all(math.isclose(s, t) for q in want for (s, _), (t, _) in zip(got[q], want[q]))


def test_empty_and_tiny(spark):
    table = vectors(spark, [])
    assert nearest(build_index(table), table).collect() == []
    one = vectors(spark, [(0, [1.0])])
    assert nearest(build_index(one), one).collect() == []
    two = vectors(spark, [(0, [1.0]), (5, [3.0])])
    assert results(nearest(build_index(two), two)) == {0: [(2.0, 5)], 5: [(2.0, 0)]}


def test_pruning_keeps_diverse_edges():
    line = np.array([[0.0], [1.0], [1.1], [1.2], [-3.0]], dtype=np.float32)
    graph = Graph(line, entry=0, degree=3)
    kept = graph.prune(np.array([0]), np.array([[1, 2, 3, 4]]), 1.2)
    assert [k for k in kept[0].tolist() if k >= 0] == [1, 4]


def test_an_id_with_two_vectors_comes_once(spark):
    rng = np.random.default_rng(4)
    rows = [(k, x.tolist()) for k, x in enumerate(rng.normal(size=(60, 4)).astype(np.float32))]
    near = [(5, [v + 0.01 * n for v in rows[0][1]]) for n in range(1, 4)] + [(0, rows[7][1])]
    table = vectors(spark, rows + near)
    got = results(nearest(build_index(table, shard=20), table.where("vec_id = 0")))
    # The query id has two rows; both ask, and each id keeps its smallest score of either.
    ids = [v for _, v in got[0]]
    assert len(ids) == len(set(ids)) == 10 and ids[0] in (5, 7) and 0 not in ids
