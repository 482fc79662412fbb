"""Ranked lexical search over geometric blocks of posting lists.

1. One pass over the documents writes the forward index: per document its number of terms and
   the terms that some query holds, with their occurrences. Sums and grouped counts over it
   give the collection's figures and every term's weight.
2. A shard is a stretch of about ``SHARD_POSTINGS`` postings of the forward index, held by one
   task. In it a term's posting list is cut into blocks of similar documents: documents are
   dealt to the nearest of evenly drawn centres, by the inner product of signed
   projections of their impacts, and neighbours in that order share a block. A block stores
   the largest impact of each term among its documents, its summary, for the terms that a query
   which searches the list holds.
3. Terms are taken by falling bound (weight times largest impact in the shard). For the queries that
   hold the term, a block's bound is the product of its summary with the query's weights over this and
   all later terms: a document with an earlier term was met in that term's list. Blocks
   are visited by falling bound and skipped only if the bound lies below the query's threshold,
   its k-th best score so far; the documents of visited blocks are scored exactly. A
   whole list is skipped if the largest impacts of the shard already bound it.
4. The thresholds start at the k-th best scores of a sample of documents, which are lower bounds of
   the final ones; each shard returns k documents a query at most, and a ranked window
   merges them.

All scores and bounds are 64-bit integers, so that no rounding can lose a document.

Queries go to the tasks in blocks of ``BLOCK_QUERIES``, so that what a task holds is bounded; a block is
a pass over the forward index, not over the texts, and about ``MAX_TERMS`` terms share one forward index.

Cases: NULL, empty and wordless texts are no documents and no hits, as queries they find
nothing; repeated documents and repeated queries count and are answered row by row; equal scores
go by ascending key, NULL last; other columns are ignored; an empty table finds nothing.
"""
from __future__ import annotations

from itertools import repeat
from math import floor, log

from pyspark.sql import DataFrame, Window, functions as F

from .common import prepared, text_bytes, written
from .decontaminate import words_of

TOP = 10
SLOPE = 90  # percent of a document's length that counts against it
BLOCK_DOCS = 32
SHARD_POSTINGS = 2_000_000
SAMPLE_DOCS = 20_000
BLOCK_QUERIES = 5_000
MAX_TERMS = 1_000_000
PROJECTIONS = 16


# --- forward index --------------------------------------------------------------------

def _forward(numbers: dict[bytes, int]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column("__text"):
                words = words_of(text.as_py())
                found = np.fromiter(map(numbers.get, words, repeat(-1)), np.int32, len(words))
                term, count = np.unique(found[found >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(term)
                counts.append(count)
                ends.append(ends[-1] + len(term))
            ends = pa.array(ends, pa.int32())
            flat = [pa.array(np.concatenate(c) if c else [], t) for c, t in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(ends, f) for f in flat)],
                names=["key", "n", "terms", "tfs"])
    return run


def forward_index(docs: DataFrame, numbers: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (terms of the text), terms array<int> and tfs array<long> of the numbered terms; rows
    without any term at all are left out. Written once."""
    rows = docs.select(F.col(key).alias("key"), text_bytes(text).alias("__text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n long, terms array<int>, tfs array<long>"
    return written(rows.mapInArrow(_forward(numbers), schema).where("n > 0"), "forward-index")


class Collection:
    """The figures of a collection: documents, terms, and the weight of every numbered term."""

    def __init__(self, forward: DataFrame, n_terms: int):
        self.docs, words = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.words = max(words, 1)
        held = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        self.weights = [0] * n_terms
        for term, df in held.collect():  # the queries' terms, at most ``MAX_TERMS``
            self.weights[term] = floor(1000 * log((2 * self.docs + 2) / (2 * df + 1)))


# --- one shard ------------------------------------------------------------------------

class Shard:
    """Documents of one task as rows of (term, impact), and the same by term."""

    def __init__(self, keys, lengths, starts, terms, tfs, docs: int, words: int):
        import numpy as np

        m = 100 - SLOPE + SLOPE * lengths * docs // words
        owner = np.repeat(np.arange(len(lengths)), np.diff(starts))
        self.keys, self.starts, self.terms = keys, starts, terms
        self.impacts = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[owner])
        order = np.argsort(terms, kind="stable")
        self.by_term, self.owner = terms[order], owner[order]
        self.term_impacts = self.impacts[order]
        self.sketch = self._sketch()

    def _sketch(self):
        import numpy as np

        dims = []
        for d in range(PROJECTIONS):
            # Signs from a multiplicative hash of (term, dimension).
            bits = (self.terms.astype(np.uint64) * np.uint64(PROJECTIONS) + np.uint64(d + 1)) * np.uint64(0x9E3779B97F4A7C15)
            bits ^= bits >> np.uint64(32)
            bits *= np.uint64(0xBF58476D1CE4E5B9)
            sums = np.concatenate([[0], np.cumsum(np.where(bits >> np.uint64(63), self.impacts, -self.impacts))])
            dims.append(sums[self.starts[1:]] - sums[self.starts[:-1]])
        sketch = np.array(dims, dtype=np.float32).T
        norms = np.linalg.norm(sketch, axis=1, keepdims=True)
        return sketch / np.where(norms > 0, norms, 1)

    def postings(self, term: int):
        import numpy as np

        low, high = np.searchsorted(self.by_term, [term, term + 1])
        return self.owner[low:high], self.term_impacts[low:high]

    def entries(self, docs):
        """(position in ``docs``, term, impact) of all terms of the documents."""
        import numpy as np

        sizes = self.starts[docs + 1] - self.starts[docs]
        at = np.repeat(self.starts[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(docs)), sizes), self.terms[at], self.impacts[at]

    def scores(self, docs, weights):
        import numpy as np

        at, terms, impacts = self.entries(docs)
        sums = np.concatenate([[0], np.cumsum(weights[terms] * impacts)])
        ends = np.searchsorted(at, np.arange(len(docs) + 1))
        return sums[ends[1:]] - sums[ends[:-1]]


class PostingBlocks:
    """A term's posting list in blocks of similar documents, with their summaries over the terms
    ``asked`` (True: some query that searches the list holds it)."""

    def __init__(self, shard: Shard, docs, asked):
        import numpy as np

        centres = -(-len(docs) // BLOCK_DOCS)
        if centres > 1:
            points = shard.sketch[docs]
            drawn = points[np.linspace(0, len(docs) - 1, centres).astype(np.int64)]
            nearest = np.empty(len(docs), dtype=np.int64)
            for a in range(0, len(docs), 4096):
                nearest[a:a + 4096] = (points[a:a + 4096] @ drawn.T).argmax(axis=1)
            docs = docs[np.argsort(nearest, kind="stable")]
        self.docs = docs
        block, terms, impacts = shard.entries(docs)
        held = np.flatnonzero(asked[terms])
        block, terms, impacts = block[held] // BLOCK_DOCS, terms[held], impacts[held]
        order = np.argsort(terms * centres + block)
        block, terms, impacts = block[order], terms[order], impacts[order]
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (terms[1:] != terms[:-1])]))
        self.size, self.block, self.terms = centres, block[first], terms[first]
        self.largest = np.maximum.reduceat(impacts, first)

    def bounds(self, terms, weights):
        """The product of every summary with the weights of ``terms``."""
        import numpy as np

        out = np.zeros(self.size, dtype=np.int64)
        lows, highs = np.searchsorted(self.terms, terms), np.searchsorted(self.terms, terms, side="right")
        for term, low, high in zip(terms, lows, highs):
            out[self.block[low:high]] += weights[term] * self.largest[low:high]
        return out

    def members(self, blocks):
        import numpy as np

        at = (blocks[:, None] * BLOCK_DOCS + np.arange(BLOCK_DOCS)).ravel()
        return self.docs[at[at < len(self.docs)]]


class Best:
    """A query's best documents of a shard and its threshold."""

    def __init__(self, k: int, threshold: int):
        import numpy as np

        self.k, self.threshold = k, threshold
        self.docs, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, shard: Shard, docs, scores):
        import numpy as np

        docs, first = np.unique(np.concatenate([self.docs, docs]), return_index=True)
        scores = np.concatenate([self.scores, scores])[first]
        # Documents are numbered by ascending key, so that ties fall to the smaller one.
        order = np.lexsort((docs, -scores))[:self.k]
        self.docs, self.scores = docs[order], scores[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def search_shard(shard: Shard, queries: list, weights, k: int, thresholds) -> list[Best]:
    """The best documents of every query (its term numbers); those below its threshold may lack."""
    import numpy as np

    wanted = np.unique(np.concatenate([np.empty(0, np.int64), *queries]))
    largest = np.zeros(len(weights), dtype=np.int64)
    np.maximum.at(largest, shard.by_term, shard.term_impacts)
    caps = weights * largest
    wanted = wanted[caps[wanted] > 0]
    wanted = wanted[np.lexsort((wanted, -caps[wanted]))]
    place = np.full(len(weights), -1, dtype=np.int64)
    place[wanted] = np.arange(len(wanted))
    best = [Best(k, max(int(t), 1)) for t in thresholds]  # scores of 0 are no hits
    holders: dict[int, list] = {}
    for number, query in enumerate(queries):
        terms = query[place[query] >= 0]
        terms = terms[np.argsort(place[terms])]
        rest = np.cumsum(caps[terms][::-1])[::-1]
        for at, term in enumerate(terms.tolist()):
            holders.setdefault(term, []).append((number, terms[at:], int(rest[at])))
    own = np.zeros(len(weights), dtype=np.int64)
    held = np.zeros(len(weights), dtype=bool)
    for term in wanted.tolist():
        asked = [h for h in holders.get(term, ()) if h[2] >= best[h[0]].threshold]
        if not asked:
            continue
        coordinates = np.concatenate([h[1] for h in asked])
        held[coordinates] = True
        blocks = PostingBlocks(shard, shard.postings(term)[0], held)
        held[coordinates] = False
        for number, terms, _ in asked:
            found, query = best[number], queries[number]
            bounds = blocks.bounds(terms, weights)
            left = np.argsort(-bounds, kind="stable")
            left = left[bounds[left] >= found.threshold]
            own[query] = weights[query]
            step = 1
            while len(left):
                docs = blocks.members(left[:step])
                scores = shard.scores(docs, own)
                keep = scores >= found.threshold
                if keep.any():
                    found.add(shard, docs[keep], scores[keep])
                left = left[step:]
                left = left[bounds[left] >= found.threshold]
                step *= 2
            own[query] = 0
    return best


def _shards(batches, size: int):
    """Forward rows of a task in stretches of about ``size`` postings."""
    import pyarrow as pa

    held, postings = [], 0
    for batch in batches:
        held.append(batch)
        postings += len(batch.column("terms").flatten())
        if postings >= size:
            yield pa.Table.from_batches(held)
            held, postings = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(queries: list, weights: list[int], k: int, thresholds: list[int], docs: int, words: int,
            shard_postings: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = np.array(weights, dtype=np.int64)
        for rows in _shards(batches, shard_postings):
            rows = rows.filter(pc.greater(pc.list_value_length(rows["terms"]), 0))
            rows = rows.sort_by([("key", "ascending")]).combine_chunks()  # NULL last
            if not rows.num_rows:
                continue
            sizes = rows["terms"].combine_chunks()
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(sizes).to_numpy(zero_copy_only=False))])
            shard = Shard(rows["key"], rows["n"].to_numpy(), starts.astype(np.int64),
                          sizes.flatten().to_numpy().astype(np.int64),
                          rows["tfs"].combine_chunks().flatten().to_numpy(), docs, words)
            found = search_shard(shard, queries, table, k, thresholds)
            at = np.concatenate([np.empty(0, np.int64), *(b.docs for b in found)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(found)), [len(b.docs) for b in found]), pa.int32()),
                 rows["key"].take(pa.array(at)).combine_chunks(),
                 pa.array(np.concatenate([np.empty(0, np.int64), *(b.scores for b in found)]), pa.int64())],
                names=["query", "key", "score"])
    return run


# --- search ---------------------------------------------------------------------------

def _best(forward: DataFrame, queries: list, collection: Collection, k: int, thresholds: list[int],
          shard_postings: int) -> DataFrame:
    """query (number), key, score, rank of the k best documents."""
    kind = forward.schema["key"].dataType.simpleString()
    found = forward.select("key", "n", "terms", "tfs").mapInArrow(
        _search(queries, collection.weights, k, thresholds, collection.docs, collection.words, shard_postings),
        f"query int, key {kind}, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def query_groups(queries: DataFrame, key: str, text: str, max_terms: int):
    """(term numbers, list of (key, numbers of its distinct terms)), groups of about ``max_terms`` terms at most."""
    import numpy as np

    numbers: dict[bytes, int] = {}
    rows: list = []
    for row in queries.select(F.col(key).alias("key"), text_bytes(text).alias("text")).toLocalIterator():
        if len(numbers) >= max_terms:
            yield numbers, rows
            numbers, rows = {}, []
        terms = {numbers.setdefault(word, len(numbers)) for word in words_of(bytes(row["text"]))}
        rows.append((row["key"], np.array(sorted(terms), dtype=np.int64)))
    if rows:
        yield numbers, rows


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text",
           query_key: str = "item_id", query_text: str = "text", sample_docs: int = SAMPLE_DOCS,
           shard_postings: int = SHARD_POSTINGS, block_queries: int = BLOCK_QUERIES,
           max_terms: int = MAX_TERMS) -> DataFrame:
    """query_key, rank int (from 1), key, score long: the k best documents of every query."""
    spark = prepared(docs.sparkSession)
    kind, asked_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, key), (queries, query_key)))
    out = spark.createDataFrame([], f"{query_key} {asked_kind}, rank int, {key} {kind}, score long")
    for numbers, rows in query_groups(queries, query_key, query_text, max_terms):
        forward = forward_index(docs, numbers, key, text)
        collection = Collection(forward, len(numbers))
        for first in range(0, len(rows), block_queries):
            block = rows[first:first + block_queries]
            asked = [terms for _, terms in block]
            thresholds = [0] * len(asked)
            if collection.docs > sample_docs:
                steps = 1 << 20
                share = F.pmod(F.xxhash64("key", "n"), F.lit(steps)) < -(-sample_docs * steps // collection.docs)
                worst = _best(forward.where(share), asked, collection, k, thresholds, shard_postings)
                for number, score in worst.where(F.col("rank") == k).select("query", "score").collect():  # one a query
                    thresholds[number] = score
            names = spark.createDataFrame([(at, q) for at, (q, _) in enumerate(block)],
                                          f"query int, {query_key} {asked_kind}")
            found = _best(forward, asked, collection, k, thresholds, shard_postings)
            found = found.join(F.broadcast(names), "query")  # ``block_queries`` rows
            out = out.union(found.select(query_key, F.col("rank").cast("int").alias("rank"),
                                         F.col("key").alias(key), "score"))
    return out
