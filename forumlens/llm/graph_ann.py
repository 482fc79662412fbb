"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt by a hash of their id into shards of about ``SHARD`` vectors. Each shard
is a graph built by inserting its vectors in a fixed shuffled order: a greedy search from the
shard's central vector proposes neighbours, and robust pruning keeps a neighbour only if no
kept one is ``ALPHA`` times nearer to it than the new vector is, so long and diverse edges
survive; reverse edges are added and pruned alike. A query is a beam search of every shard;
the shards' nearest are merged. Distances are in double precision; vectors whose squares would
leave its range are scaled by a power of two first.

Equal vectors of a shard share one node, so a vector that very many rows repeat neither
fills neighbour lists nor hides others; every row is in the index and can be returned.
Queries go to the shards in blocks, so a task holds one shard and one block.

Cases: rows with a NULL id, and NULL, empty or zero vectors or vectors with NULL or
non-finite components, take no part; vectors are compared with vectors of their own length
only; an id is returned at most once for a query and never for a query of the same id;
equal distances are ordered by id; a query finds fewer than ``k`` rows if there are fewer;
other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import prepared, written

SHARD = 8_192
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
QUERY_BLOCK = 2_048
BATCH = 256
EXPAND = 4


def distances(vectors, norms, ids, queries, query_norms):
    """Squared distances of each query to its row of node numbers."""
    import numpy as np

    dots = np.einsum("bcd,bd->bc", vectors[ids], queries)
    return norms[ids] - 2 * dots + query_norms[:, None]


class Graph:
    """Vectors (distinct), their out-neighbours (-1 pads) and the node where searches start."""

    def __init__(self, vectors, neighbours=None, entry: int | None = None, degree: int = DEGREE):
        import numpy as np

        self.vectors = np.ascontiguousarray(vectors, dtype=np.float64)
        self.norms = (self.vectors ** 2).sum(axis=1)
        if entry is None:
            entry = int(((self.vectors - self.vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
        self.entry = entry
        self.neighbours = np.full((len(vectors), degree), -1, np.int32) if neighbours is None else neighbours

    def search(self, queries, beam: int):
        """Per query the ``beam`` best nodes found, nearest first, and their squared distances."""
        import numpy as np

        queries = queries.astype(np.float64)
        count, nodes = len(queries), len(self.vectors)
        beam = min(beam, nodes)
        row = np.arange(count)[:, None]
        norms = (queries ** 2).sum(axis=1)
        seen = np.zeros((count, nodes + 1), dtype=bool)  # the last column takes the pads
        seen[:, nodes] = True
        ids = np.full((count, beam), nodes, dtype=np.int64)
        far = np.full((count, beam), np.inf)
        done = np.ones((count, beam), dtype=bool)
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        far[:, 0] = distances(self.vectors, self.norms, ids[:, :1], queries, norms)[:, 0]
        width = min(EXPAND, beam)
        while True:
            waiting = np.where(done, np.inf, far)
            pick = np.argpartition(waiting, width - 1, axis=1)[:, :width]
            open_ = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            if not open_.any():
                break
            np.put_along_axis(done, pick, True, axis=1)
            chosen = np.where(open_, np.take_along_axis(ids, pick, axis=1), nodes)
            near = np.concatenate([self.neighbours, np.full((1, self.neighbours.shape[1]), -1, np.int32)])[chosen]
            near = near.reshape(count, -1).astype(np.int64)
            near[near < 0] = nodes
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = nodes
            near[seen[row, near]] = nodes
            seen[row, near] = True
            live = near < nodes
            got = distances(self.vectors, self.norms, np.where(live, near, 0), queries, norms)
            got[~live] = np.inf
            ids = np.concatenate([ids, near], axis=1)
            far = np.concatenate([far, got], axis=1)
            done = np.concatenate([done, ~live], axis=1)
            best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            ids, far, done = (np.take_along_axis(x, best, axis=1) for x in (ids, far, done))
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)

    def prune(self, nodes, candidates, alpha: float):
        """Robust pruning of each node's candidate row (-1 pads) to its out-neighbours."""
        import numpy as np

        degree = self.neighbours.shape[1]
        own = self.vectors[nodes]
        candidates = np.sort(candidates, axis=1)
        live = (candidates >= 0) & (candidates != nodes[:, None])
        live[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
        safe = np.where(live, candidates, 0)
        far = distances(self.vectors, self.norms, safe, own, self.norms[nodes])
        far[~live] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        safe, far = np.take_along_axis(safe, order, axis=1), np.take_along_axis(far, order, axis=1)
        points, norms = self.vectors[safe], self.norms[safe]
        kept = np.full((len(nodes), degree), -1, dtype=np.int32)
        row = np.arange(len(nodes))
        alive = np.isfinite(far)
        for k in range(degree):
            any_left = alive.any(axis=1)
            if not any_left.any():
                break
            first = alive.argmax(axis=1)
            kept[any_left, k] = safe[row, first][any_left]
            between = norms - 2 * np.einsum("bcd,bd->bc", points, points[row, first]) + norms[row, first][:, None]
            alive &= alpha * alpha * between > far
            alive[row, first] = False
        return kept

    def insert(self, nodes, beam: int, alpha: float) -> None:
        import numpy as np

        found, _ = self.search(self.vectors[nodes], beam)
        candidates = np.concatenate([found, self.neighbours[nodes]], axis=1)
        candidates[candidates >= len(self.vectors)] = -1
        kept = self.prune(nodes, candidates.astype(np.int64), alpha)
        self.neighbours[nodes] = kept
        target, source = kept.ravel(), np.repeat(nodes, kept.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        degree = self.neighbours.shape[1]
        while len(target):  # at most ``degree`` new in-edges of a node at a time
            first = np.concatenate([[True], target[1:] != target[:-1]])
            start = np.flatnonzero(first)
            place = np.arange(len(target)) - np.repeat(start, np.diff(np.append(start, len(target))))
            now = place < degree
            touched = target[first]
            new = np.full((len(touched), degree), -1, dtype=np.int64)
            new[(np.cumsum(first) - 1)[now], place[now]] = source[now]
            old = self.neighbours[touched].astype(np.int64)
            both = np.concatenate([old, new], axis=1)
            both[:, degree:][(both[:, degree:, None] == old[:, None, :]).any(axis=2)] = -1
            size = (both >= 0).sum(axis=1)
            fits = size <= degree
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
            self.neighbours[touched[fits]] = packed[fits, :degree]
            for part in np.array_split(np.flatnonzero(~fits), max(1, (~fits).sum() // BATCH)):
                if len(part):
                    self.neighbours[touched[part]] = self.prune(touched[part], both[part], alpha)
            target, source = target[~now], source[~now]

    def build(self, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> "Graph":
        import numpy as np

        rng, nodes = np.random.default_rng(seed), len(self.vectors)
        if nodes > 1:
            start = rng.integers(0, nodes, size=(nodes, min(self.neighbours.shape[1] // 2, nodes - 1)))
            start[start == np.arange(nodes)[:, None]] = -1
            self.neighbours[:, :start.shape[1]] = start
            for value in (1.0, alpha):
                order = rng.permutation(nodes)
                for a in range(0, nodes, BATCH):
                    self.insert(order[a:a + BATCH], beam, value)
        return self


def valid_vector(column: str) -> Column:
    """Neither NULL nor zero, and all components finite numbers."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


INDEX_FIELDS = ("dim", "shard", "node", "vec_id", "same_as", "entry", "neighbours", "vector")


def _matrix(column, dim: int):
    import numpy as np

    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def scale(*matrices) -> float:
    """A power of two that brings the squares of the components within double precision, 1 if they are."""
    import numpy as np

    largest = max(float(np.abs(m).max(initial=0.0)) for m in matrices)
    return 1.0 if 1e-100 < largest < 1e100 else float(np.ldexp(1.0, min(1000, -int(np.frexp(largest)[1]))))


def _build(degree: int, beam: int, alpha: float):
    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("vec_id")
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        vectors = _matrix(table["vector"], dim) + 0.0  # -0.0 counts as 0.0
        _, first, same = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        graph = Graph(vectors[first] * scale(vectors), degree=degree).build(beam, alpha, seed=shard)
        # Numbers of graph nodes become numbers of rows.
        rows = np.append(first, -1)[graph.neighbours]
        own = np.full(len(vectors), -1)
        own[first] = np.arange(len(first))
        edges = [rows[g][rows[g] >= 0].tolist() if g >= 0 else None for g in own]
        number = np.arange(len(vectors))
        return pa.table({
            "dim": pa.array(np.full(len(vectors), dim), pa.int32()),
            "shard": pa.array(np.full(len(vectors), shard), pa.int32()),
            "node": pa.array(number, pa.int32()), "vec_id": table["vec_id"],
            "same_as": pa.array(first[same.ravel()], pa.int32()),
            "entry": pa.array(number == first[graph.entry]),
            "neighbours": pa.array(edges, pa.list_(pa.int32())), "vector": table["vector"]})
    return run


def vector_rows(vectors: DataFrame, key: str, column: str) -> DataFrame:
    return (vectors.where(F.col(key).isNotNull() & valid_vector(column))
            .select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("vector"),
                    F.size(column).alias("dim")))


def build_index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", shard: int = SHARD,
                degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> DataFrame:
    """One row per vector: dim, shard, node, vec_id, same_as (the node of the first equal
    vector), entry, neighbours (nodes; NULL for repeated vectors), vector."""
    prepared(vectors.sparkSession)
    rows = vector_rows(vectors, key, column)
    shards = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    tasks = shards.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]  # a shard is minutes of work: a task each
    dealt = (rows.join(shards, "dim")
             .select("dim", F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"), "vec_id", "vector")
             .repartition(2 * tasks, "dim", "shard"))
    kind = rows.schema["vector"].dataType.simpleString()
    built = dealt.groupBy("dim", "shard").applyInArrow(
        _build(degree, beam, alpha),
        f"dim int, shard int, node int, vec_id long, same_as int, entry boolean, neighbours array<int>, vector {kind}")
    return written(built, "vector-index")


def _search(k: int, beam: int):
    def run(index, queries):
        import numpy as np
        import pyarrow as pa

        if not len(index) or not len(queries):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        index = index.sort_by("node")
        dim = index["dim"][0].as_py()
        vectors, ids = _matrix(index["vector"], dim), index["vec_id"].to_numpy()
        same = index["same_as"].to_numpy()
        firsts = np.flatnonzero(same == np.arange(len(same)))
        number = np.full(len(same) + 1, -1, dtype=np.int32)
        number[firsts] = np.arange(len(firsts))
        lists = index["neighbours"].take(pa.array(firsts)).to_pylist()
        width = max(1, max(map(len, lists)))
        edges = number[np.array([x + [-1] * (width - len(x)) for x in lists], dtype=np.int64)]
        entry = int(number[index["entry"].to_numpy(zero_copy_only=False).argmax()])
        points, asked = _matrix(queries["vector"], dim), queries["vec_id"].to_numpy()
        unit = scale(vectors, points)
        vectors, points = vectors * unit, points * unit
        graph = Graph(vectors[firsts], edges, entry)
        # Ids of a node, each once; more than k + 1 of them can't be among the k nearest, of which
        # the query's own is not one.
        order = np.lexsort((ids, same))
        again = (np.diff(same[order]) == 0) & (np.diff(ids[order]) == 0)
        order = order[np.concatenate([[True], ~again])]
        starts = np.searchsorted(same[order], firsts)
        ends = np.minimum(np.searchsorted(same[order], firsts, side="right"), starts + k + 1)
        out = []
        for a in range(0, len(points), BATCH):
            found, _ = graph.search(points[a:a + BATCH], max(beam, k + 1))
            for q, nodes in zip(range(a, a + BATCH), found):
                nodes = nodes[nodes < len(firsts)]
                score = np.sqrt(((vectors[firsts[nodes]] - points[q]) ** 2).sum(axis=1)) / unit
                got: dict[int, float] = {}  # an id's smallest score: several vectors may have one id
                for s, n in zip(score.tolist(), nodes):
                    for v in ids[order[starts[n]:ends[n]]].tolist():
                        if v != asked[q] and s < got.get(v, np.inf):
                            got[v] = s
                out.extend((int(asked[q]), v, s) for s, v in sorted((s, v) for v, s in got.items())[:k])
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()),
                         "vec_id": pa.array([o[1] for o in out], pa.int64()),
                         "score": pa.array([o[2] for o in out], pa.float64())})
    return run


def nearest(index: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 10,
            beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows found for every query."""
    prepared(index.sparkSession)
    asked = vector_rows(queries, key, column)
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    blocks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
    each = shards.join(blocks, "dim")
    asked = (asked.join(each, "dim")
             .select("dim", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"),
                     F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "vector"))
    nodes = index.join(blocks, "dim").select(*INDEX_FIELDS, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    found = (nodes.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block"))
             .applyInArrow(_search(k, beam), "query_id long, vec_id long, score double")
             .groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
