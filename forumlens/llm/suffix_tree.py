"""Language model scores by a probabilistic suffix tree over words.

A state is a context of up to ``max_context`` words. The root predicts words by smoothed counts; a
longer context is retained if its own next-word distribution diverges from that of the context
without its first word: the counts' log-likelihood ratio, each occurrence scored by the counts without
itself, must reach ``divergence`` nats. A retained context's distribution is its counts, smoothed by
``strength`` times the distribution of its longest retained suffix. A word of a text is
scored in the longest retained state that its history ends with; contexts do not cross texts.

The counts of all contexts of all training texts are kept; a context needs ``min_count``
occurrences to become a state, as a word seen once tells no distribution. How it runs:

1. Texts are read once into chunks of about ``CHUNK_TOKENS`` tokens (whole texts), written as word numbers
   with the chunk's vocabulary of 64-bit word hashes, bucketed by chunk.
2. For each context length, a chunk sends its distinct grams with their occurrences in training texts
   to buckets of the hash; a bucket sums them and returns the totals to the chunks that asked. Only
   grams whose context may be a state are sent, and none that begins or ends with a gram that this
   chunk alone has. A gram comes once from a chunk, so a frequent one is no hot key. Pairs and longer
   grams but the longest go in two halves of the hashes, so that half is on disk at a time.
3. The divergence of a context is a sum over its occurrences, so chunks send partial sums and get back
   whether it is retained; a context goes by its rank in its bucket, returned with its count. Scores are
   then worked out inside the chunk. Answers move once, to a table bucketed as the chunks are, and the
   shuffle files of an exchange are freed after it.

Nothing is gathered by the driver but two numbers, the training tokens and distinct words. Hashes
travel as compressed byte planes of their sorted differences.

Words are told apart by 64-bit hashes: among n distinct ones any two share a hash with odds of about
n * n / 2 ** 65. Grams of several words are told apart by 56 bits: a gram shares its hash, and so its
counts, with another one with odds of n / 2 ** 56.

Cases: a NULL text is empty; a text's end counts as a token, so an empty text has one; a NULL key is
learned from and not held out; repeated rows count and are scored row by row; other columns are
ignored; an empty table gives an empty result, and without training rows every token has
the root's probability.
"""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, functions as F, types as T

from .common import prepared, text_bytes, written

MAX_CONTEXT = 3
MIN_COUNT = 3
DIVERGENCE = 4.0
STRENGTH = 50.0
SMOOTHING = 0.1
CHUNK_TOKENS = 1_500_000
BUCKET_TOKENS = 1_000_000  # tokens of all texts to one bucket of gram hashes
PIECE_BYTES = 1 << 20
BLOCK = 1 << 15  # hashes worked on at a time: they fit a core's cache
GRAM_BITS = 0xFFFFFFFFFFFFFF00  # of a gram of several words the upper 56 bits count
BASE, INVERSE = 0x2545F4914F6CDD1B, pow(0x2545F4914F6CDD1B, -1, 1 << 64)


def held_out(key: str = "doc_id"):
    """Rows whose crc32 of the key as text is divisible by 10."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))


# --- words ----------------------------------------------------------------------------

def mixed(a):
    import numpy as np

    moved = a >> np.uint64(32)
    out = a ^ moved
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= np.right_shift(out, np.uint64(29), out=moved)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= np.right_shift(out, np.uint64(32), out=moved)
    return out


def joined(a, b):
    """Hash of the gram ``a`` followed by the word ``b``."""
    import numpy as np

    out = np.empty(len(a), dtype=np.uint64)
    for at in range(0, len(a), BLOCK):
        block = a[at:at + BLOCK] * np.uint64(0x9E3779B97F4A7C15)
        block += b[at:at + BLOCK]
        out[at:at + BLOCK] = mixed(block)
    return out


@lru_cache(maxsize=1)
def _tables():
    import numpy as np
    from xxhash import xxh64_intdigest

    values = np.array([xxh64_intdigest(bytes([b + 32 if 65 <= b <= 90 else b]), 42) for b in range(256)], dtype=np.uint64)
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True  # fixed values: the white space of the word pattern
    return values, blank


END = 0x5DEECE66D1234567  # stands for the end of a text


def _powers(base: int, n: int):
    import numpy as np

    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


@lru_cache(maxsize=1)
def _piece_powers():
    return _powers(BASE, PIECE_BYTES), _powers(INVERSE, PIECE_BYTES)


def word_hashes(data: bytes):
    """(hash of every word, its first byte's place). A-Z count as a-z."""
    import numpy as np

    values, blank = _tables()
    hashes, places, at = [], [], 0
    raw = np.frombuffer(data, np.uint8)
    while at < len(raw):
        piece = raw[at:at + PIECE_BYTES]
        gaps = blank[piece]
        if at + len(piece) < len(raw):
            last = np.flatnonzero(gaps)
            if len(last):
                piece, gaps = piece[:last[-1] + 1], gaps[:last[-1] + 1]
            else:  # a word longer than a piece
                more = np.flatnonzero(blank[raw[at:]])
                piece = raw[at:at + int(more[0]) + 1] if len(more) else raw[at:]
                gaps = blank[piece]
        up, down = _piece_powers() if len(piece) <= PIECE_BYTES else (_powers(BASE, len(piece)), _powers(INVERSE, len(piece)))
        word = np.concatenate([[False], ~gaps, [False]])
        first, end = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[piece] * up[:len(piece)])])
        hashes.append(mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)))
        places.append(first + at)
        at += len(piece)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def text_hashes(texts: list[bytes]):
    """(hashes of all words with an end after each text, tokens of each text)."""
    import numpy as np

    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hashes, places = word_hashes(b" ".join(texts))
    words = np.diff(np.searchsorted(places, starts))
    ends = np.cumsum(words + 1) - 1
    out = np.empty(len(hashes) + len(texts), dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside], out[ends] = hashes, np.uint64(END)
    return out, words + 1


# --- arrays as byte planes ------------------------------------------------------------

@lru_cache(maxsize=1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values) -> bytes:
    """Little-endian numbers, all lowest bytes first, compressed."""
    import numpy as np

    size = values.dtype.itemsize
    values = np.ascontiguousarray(values).view(f"<u{size}")
    planes = np.empty((size, len(values)), dtype=np.uint8)
    for place, plane in enumerate(planes):  # plane by plane: much faster than one transposed copy
        np.right_shift(values, values.dtype.type(8 * place), out=plane, casting="unsafe")
    return _codec()[0].compress(planes)


def unpack(data: bytes, kind: str):
    import numpy as np

    size, data = np.dtype(kind).itemsize, _codec()[1].decompress(data)
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    values = np.empty((planes.shape[1], size), dtype=np.uint8)
    for place, plane in enumerate(planes):
        values[:, place] = plane
    return values.view(kind).ravel()


def grouped(values):
    """(the distinct hashes in order, the place of each value among them, how often each occurs)."""
    import numpy as np

    if not len(values):
        return values, np.empty(0, np.int32), np.empty(0, np.int64)
    # Sorting plain numbers is much faster than sorting places: the low bits give way to the place.
    low = np.uint64((1 << (len(values) - 1).bit_length()) - 1)
    order = values & ~low
    order |= np.arange(len(values), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    ordered = values[order]
    if (ordered[1:] < ordered[:-1]).any():  # hashes that differ in the low bits only
        order = np.argsort(values)
        ordered = values[order]
    new = np.empty(len(values), dtype=bool)
    new[0] = False
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    kind = np.int32 if len(values) < 1 << 31 else np.int64
    which = np.empty(len(values), dtype=kind)
    which[order] = np.cumsum(new, dtype=kind)
    new[0] = True
    starts = np.flatnonzero(new)
    return ordered[starts], which, np.diff(starts, append=len(values))


def distinct(values):
    """(the distinct hashes in order, the place of each value among them)."""
    return grouped(values)[:2]


# --- chunks ---------------------------------------------------------------------------

def _chunks(key_type, size: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        keys, held, parts, sizes, total = [], [], [], [], 0

        def chunk():
            tokens = np.concatenate(parts)
            words, ids = distinct(tokens)
            order = np.argsort(-np.bincount(ids), kind="stable")  # frequent words get small numbers
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order))
            out = np.array(held, dtype=bool)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([keys], pa.list_(key_type)),
                 pa.array([held], pa.list_(pa.bool_())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                 pa.array([pack(words[order])], pa.binary()), pa.array([pack(place[ids])], pa.binary()),
                 pa.array([total], pa.int64()), pa.array([int(np.concatenate(sizes)[~out].sum())], pa.int64())],
                names=["chunk", "keys", "held", "sizes", "words", "ids", "n", "n_train"])
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            marks, names = batch.column("__held").to_pylist(), batch.column("key").to_pylist()
            at = 0
            while at < len(texts):
                # Texts of a few MB at a time, or one longer text.
                stop, taken = at, 0
                while stop < len(texts) and (stop == at or taken + len(texts[stop]) <= 4 * PIECE_BYTES):
                    taken += len(texts[stop])
                    stop += 1
                found, counts = text_hashes(texts[at:stop])
                keys += names[at:stop]
                held += marks[at:stop]
                parts.append(found)
                sizes.append(counts)
                total += len(found)
                at = stop
                if total >= size:
                    yield chunk()
                    number += 1
                    keys, held, parts, sizes, total = [], [], [], [], 0
        if keys:
            yield chunk()
    return run


class Model:
    """Settings, and the training tokens and distinct words once they are known."""

    def __init__(self, max_context: int, min_count: int, divergence: float, strength: float):
        self.max_context, self.min_count = max_context, min_count
        self.divergence, self.strength = divergence, strength
        self.tokens = self.words = 0

    def step(self, number: int) -> dict:
        """What an exchange asks for, kind -> half of the hashes (None: all): counts of grams, "c", and
        divergences of contexts, "s", by length. Large ones go in halves, so that half is on disk at a time."""
        steps = [{"c0": None}]
        for k in range(1, self.max_context + 1):
            last = {f"s{k - 1}": None} if k > 1 else {}
            if k == self.max_context and k > 1:
                steps += [last, {f"c{k}": None}]
            else:
                steps += [last | {f"c{k}": 0}, {f"c{k}": 1}]
        if self.max_context:
            steps.append({f"s{self.max_context}": None})
        return steps[number] if number < len(steps) else {}

    def root(self, counts):
        return (counts + SMOOTHING) / (self.tokens + SMOOTHING * (self.words + 1))


def work(row: dict, returned: dict, step: int, model: Model):
    """What a chunk asks of the buckets in a step, as (kind, sorted hashes, what a bucket knows them by, values);
    after the last step ``(tokens, known, base score, score)`` of its texts."""
    import numpy as np

    words, ids = unpack(row["words"], "<u8"), unpack(row["ids"], "<u4").astype(np.int64)
    sizes = np.array(row["sizes"], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    train = np.repeat(~np.array(row["held"], dtype=bool), sizes)
    follows = np.ones(len(ids), dtype=bool)  # the next token is of the same text
    follows[starts + sizes - 1] = False
    wanted, requests, order = model.step(step), [], np.argsort(words)
    if "c0" in wanted:
        sums = np.bincount(ids[train], minlength=len(words))
        return [("c0", words[order], words[order], sums[order].astype("<u4"))]
    totals = returned["c0"].astype(np.int64)
    sums, own = np.empty(len(words), np.int64), np.empty(len(words), dtype=bool)
    sums[order], own[order] = totals >> 1, (totals & 1) == 0
    # inside: the gram that ends at a token is in this chunk only; single: at this place only, as then all longer
    # ones that end there are. All are looked up at once.
    lone, frequent = own & (np.bincount(ids, minlength=len(words)) == 1), sums >= model.min_count
    marks = (own + 2 * lone + 4 * frequent).astype(np.uint8)[ids]
    inside, single = (marks & 1).astype(bool), (marks & 2).astype(bool)
    hashes = tokens = words[ids]
    keys, which, asked, counts = words, ids, None, None
    known, retained, root = sums > 0, None, model.root(sums)
    # Grams but the longest are counted with no need of the states.
    states = not wanted or f"c{model.max_context}" in wanted or any(kind[0] == "s" for kind in wanted)
    chance = root[ids] if states else None
    for k in range(1, model.max_context + 1):
        # live: tokens after k words that may be a state; a count of min_count has none that is single.
        if k == 1:
            after = np.flatnonzero((marks & 4).astype(bool) & follows)
            live = after + 1
        else:
            after = np.flatnonzero((counts >= model.min_count) & follows[asked])
            live = asked[after] + 1
        context = which[after]
        if k == model.max_context and k > 1:  # else these grams are still asked for as contexts
            kept = np.flatnonzero(retained[live])
            after, live, context = after[kept], live[kept], context[kept]
        before, alone = (keys, own, sums), single[live]
        several = np.flatnonzero(~alone)
        asked = live[several]
        # A gram that begins or ends with one that only this chunk has is counted here.
        inside[1:] |= inside[:-1].copy()
        edge = inside[asked]
        hashes = joined(hashes[after[several]], tokens[asked])
        hashes &= np.uint64(GRAM_BITS)
        if f"c{k}" in wanted:
            asks, half = ~edge, wanted[f"c{k}"]
            if half is not None:
                asks &= hashes >> np.uint64(63) == half
            keys, which, sums = grouped(hashes[asks])
            sums -= np.bincount(which[~train[asked[asks]]], minlength=len(keys))
            requests.append((f"c{k}", keys, keys, sums.astype("<u4")))
            break
        keys, which, places = grouped(hashes)
        own = np.zeros(len(keys), dtype=bool)
        own[which[edge]] = True
        sums = places - np.bincount(which[~train[asked]], minlength=len(keys))
        totals, others = returned[f"c{k}"].astype(np.int64), np.flatnonzero(~own)
        sums[others], own[others] = totals >> 1, (totals & 1) == 0
        found = sums * 4 + own * 2 + (own & (places == 1))  # looked up once, in few bytes
        found = found.astype(np.int32 if found.max(initial=0) < 1 << 31 else np.int64)[which]
        counts, all_counts = found >> 2, train[live].astype(found.dtype)
        all_counts[several] = counts
        if k < model.max_context:
            inside = np.zeros(len(ids), dtype=bool)
            inside[live[alone]] = True
            inside[asked] = found & 2
            single[asked[(found & 1) > 0]] = True
        if not states:
            continue
        # Contexts whose suffix is a state (the root is one) and their share of the divergence.
        contexts, own_before, sums_before = before
        at, seen = live, all_counts
        if retained is not None and k < model.max_context:
            kept = np.flatnonzero(retained[live])
            at, seen, context = at[kept], seen[kept], context[kept]
        by_hash = (lambda mask: order[mask[order]]) if k == 1 else np.flatnonzero
        used = np.zeros(len(contexts), dtype=bool)
        used[context] = True
        # Next to a word seen once every occurrence gains log(c - 1 + weight) - log(weight): nothing for one seen
        # once. The context's gain reaches the divergence where these reach its need.
        need, total = np.ones(len(contexts)), sums_before[used]
        need[used] = model.divergence + total * np.log1p((total - 1) / model.strength)
        local = own_before | (need <= 0)
        others = by_hash(used & ~local)
        # The shares of contexts that other chunks have as well are sent, in their step; the others are summed here.
        repeated = np.flatnonzero(train[at] & (seen > 1))
        mine = repeated[local[context[repeated]] ^ (f"s{k}" in wanted)]
        gains = np.log1p((seen[mine] - 1) / (model.strength * chance[at[mine]]))
        shares = np.bincount(context[mine], gains, len(contexts))
        if f"s{k}" in wanted:
            ranks = np.zeros(len(contexts), dtype="<u4")
            ranks[by_hash(~own_before & (sums_before >= model.min_count))] = returned["ranks"]
            requests.append((f"s{k}", contexts[others], ranks[others], (shares[others] / need[others]).astype("<f4")))
            if f"c{k + 1}" in wanted:
                continue
            break
        state = shares >= need
        state[others] = returned[f"s{k}"].astype(bool)
        kept = state[context]
        retained = np.zeros(len(ids), dtype=bool)
        retained[at] = kept
        # Only the scores need the chance of what is seen once: a longer gram is seen no more often.
        kept = repeated[kept[repeated]] if wanted else np.flatnonzero(kept)
        at, n = at[kept], sums_before[context[kept]]
        chance[at] = (seen[kept] + model.strength * chance[at]) / (n + model.strength)
    if wanted:
        return requests
    logs = [np.add.reduceat(p, starts) for p in (np.log10(root)[ids], np.log10(chance))]
    return sizes, np.add.reduceat(known[ids].astype(np.int64), starts), *logs


LAST = 1 << 20  # a step after all exchanges
REQUEST = "kind string, bucket int, chunk long, names binary, amounts binary"
RETURN = "chunk long, kind string, bucket int, amounts binary, ranks binary, n_words long"


def _requests(step: int, model: Model, bits: int):
    def run(rows, returned):
        import numpy as np
        import pyarrow as pa

        row = rows.to_pylist()[0]
        out = []
        for kind, hashes, names, amounts in work(row, _arrays(returned, model.step(step)), step, model):
            cuts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for bucket, (low, high) in enumerate(zip(cuts.tolist(), cuts.tolist()[1:])):
                if low < high:
                    mine = names[low:high]
                    deltas = np.concatenate([mine[:1], mine[1:] - mine[:-1]])
                    out.append((kind, bucket, row["chunk"], pack(deltas), pack(amounts[low:high])))
        columns = zip(*out) if out else [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "bucket", "chunk", "names", "amounts"])
    return run if step else lambda rows: run(rows, None)


def _arrays(returned, wanted: dict) -> dict:
    """kind -> what all buckets returned, in order of the hash; ranks: those of the contexts wanted."""
    import numpy as np

    found: dict[str, list] = {}
    if returned is not None:
        columns = ["kind", "bucket", "amounts", "ranks"]
        for row in sorted(returned.select(columns).to_pylist(), key=lambda r: (r["kind"], r["bucket"])):
            kind = row["kind"]
            found.setdefault(kind, []).append(unpack(row["amounts"], "<u8" if kind[0] == "c" else "u1"))
            if kind[0] == "c" and f"s{int(kind[1:]) + 1}" in wanted:
                found.setdefault("ranks", []).append(np.cumsum(unpack(row["ranks"], "<u4"), dtype="<u4"))
    empty = {f"{c}{k}": np.empty(0, np.int64) for c in "cs" for k in range(10)} | {"ranks": np.empty(0, np.uint32)}
    return empty | {kind: np.concatenate(parts) for kind, parts in found.items()}


def _totals(model: Model):
    def run(rows):
        import numpy as np
        import pyarrow as pa

        asked = sorted(rows.to_pylist(), key=lambda r: r["chunk"])  # sums of doubles in the same order on every run
        kind = asked[0]["kind"]
        counted = kind[0] == "c"
        names = [np.cumsum(unpack(r["names"], "<u8" if counted else "<u4")) for r in asked]
        amounts = np.concatenate([unpack(r["amounts"], "<u4" if counted else "<f4") for r in asked])
        cuts = np.cumsum([len(n) for n in names])[:-1]
        ranks = [b""] * len(asked)
        if counted:  # twice the occurrences in training texts, plus one if several chunks have the gram
            keys, which = distinct(np.concatenate(names))
            sums = np.bincount(which, amounts, len(keys)).astype("<u8")
            shared = np.bincount(which, minlength=len(keys)) > 1
            answer = 2 * sums + shared.astype("<u8")
            if kind != f"c{model.max_context}":  # shared contexts are asked for again, by their rank among all here
                context = shared & (sums >= model.min_count)
                rank = np.cumsum(context, dtype="<u4")
                mine = (rank[w[context[w]]] for w in np.split(which, cuts))
                ranks = [pack(np.diff(m, prepend=m.dtype.type(0))) for m in mine]
        else:
            which = np.concatenate(names)
            sums = np.bincount(which, amounts)
            answer = (sums >= 1).astype("u1")
        n_words = [int((sums > 0).sum())] + [0] * (len(asked) - 1)
        return pa.table([pa.array([r["chunk"] for r in asked], pa.int64()), pa.array([kind] * len(asked), pa.string()),
                         pa.array([r["bucket"] for r in asked], pa.int32()),
                         pa.array([pack(answer[w]) for w in np.split(which, cuts)], pa.binary()),
                         pa.array(ranks, pa.binary()), pa.array(n_words, pa.int64())],
                        ["chunk", "kind", "bucket", "amounts", "ranks", "n_words"])
    return run


def _scores(model: Model, schema):
    def run(rows, returned):
        import pyarrow as pa

        row = rows.to_pylist()[0]
        sizes, known, base, score = work(row, _arrays(returned, {}), LAST, model)
        return pa.table([rows["keys"].combine_chunks().flatten(), pa.array(row["held"], pa.bool_()), pa.array(sizes, pa.int64()),
                         pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                        schema.names)
    return run


def _returned(answers: DataFrame, name: str, buckets: int) -> DataFrame:
    """All answers so far, with these added: they move to their chunk's bucket once, and no later step
    moves them. The plan runs this once, so its shuffle files go with it."""
    spark = answers.sparkSession
    conf, setting = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, "false")
    conf.set(setting, "true")
    try:
        (answers.repartition(buckets, "chunk").write.mode("append").bucketBy(buckets, "chunk")
         .option("compression", "zstd").saveAsTable(name))
    finally:
        conf.set(setting, before)
    return spark.table(name)


def token_chunks(rows: DataFrame, name: str, chunk_tokens: int, buckets: int) -> DataFrame:
    """Texts (key, __held, __text) as a table of chunks, bucketed by chunk, so that no join with it moves it."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    key_type = rows.schema["key"].dataType
    schema = (f"chunk long, keys array<{key_type.simpleString()}>, held array<boolean>, sizes array<long>, "
              "words binary, ids binary, n long, n_train long")
    chunks = rows.mapInArrow(_chunks(to_arrow_type(key_type), chunk_tokens), schema)
    (chunks.write.bucketBy(buckets, "chunk")
     .option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", held=None, max_context: int = MAX_CONTEXT,
                min_count: int = MIN_COUNT, divergence: float = DIVERGENCE, strength: float = STRENGTH,
                chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row.

    ``held``: rows to score only (default: a tenth, by the key's checksum).
    """
    import uuid

    if min_count < 2:
        raise ValueError("a context of one occurrence tells no distribution")
    spark = prepared(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), (held_out(key) if held is None else held).alias("__held"),
                       text_bytes(text).alias("__text"))
    model = Model(max_context, min_count, divergence, strength)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"suffix_tree_{part}_{uuid.uuid4().hex}" for part in ("chunks", "returned")]
    try:
        chunks = token_chunks(rows, names[0], chunk_tokens, buckets)
        total, model.tokens = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
        bits = max(4, (total // bucket_tokens).bit_length())
        returned = None
        step = 0
        while model.step(step):
            groups = chunks.groupBy("chunk")
            if returned is None:
                asked = groups.applyInArrow(_requests(step, model, bits), REQUEST)
            else:
                asked = groups.cogroup(returned.groupBy("chunk")).applyInArrow(_requests(step, model, bits), REQUEST)
            answers = asked.groupBy("kind", "bucket").applyInArrow(_totals(model), RETURN)
            returned = _returned(answers, names[1], buckets)
            if step == 0:
                model.words = returned.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
            step += 1
        schema = T.StructType([rows.schema["key"], *(T.StructField(n, t) for n, t in (
            ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()),
            ("base_score", T.DoubleType()), ("score", T.DoubleType())))])
        scored = written(chunks.groupBy("chunk").cogroup(returned.groupBy("chunk"))
                         .applyInArrow(_scores(model, schema), schema), "suffix-tree-scores")
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
