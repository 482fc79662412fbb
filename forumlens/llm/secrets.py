"""Secret scan: fixed patterns, and character Markov models of random strings and identifiers.

Base spans are the matches of three fixed patterns (assignments, access keys, hexadecimal
strings). The runs of key characters beside them are cut at base spans, and strings in them are
scored by the log-likelihood ratio of two first-order character Markov models, one of random
strings and one of ordinary identifiers. Candidates start and end at an end of the stretch or
at a separator (``SEPARATORS``, which random strings may hold, too), have ``MIN_LENGTH`` or more
characters and mix letters and digits; the one of the highest ratio is a span of kind
``random`` if its ratio exceeds ``MARGIN`` nats, and what is left on both sides of it is
searched likewise.

Both models are trained from labelled samples: the values in base spans are random, all other
words of identifier characters are ordinary, both taken from a bounded sample of the texts and
counted in Spark. Counts are smoothed, so characters that a class never showed stay possible.

Cases: NULL and empty texts have no spans; repeated rows are scored alike and kept; other
columns are ignored; without labelled values the random model is uniform; positions are code
points, the end exclusive.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

from .common import prepared, text_bytes
from .pii import SPANS, Overlaps, code_points, span_array

KINDS = ("assign", "access", "hex", "random")
SAMPLE_DOCS = 4_000
MIN_LENGTH = 20
MARGIN = 10.0
SMOOTHING = 50.0  # weight of the smoothing distribution, in counts
EQUAL_SHARE = (0.02, 0.5)  # of equal chances in it: ordinary, random
# Symbols of the models: 0 stands for the edge of a string, then the key characters.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
WORD = re.compile(rb"[A-Za-z0-9_-]{4,}")
SEPARATORS = b"/=_-"
HINTS = (b"passw", b"secret", b"token", b"api")


def assignments(text: bytes):
    """Matches of the assignment pattern whose value is long enough."""
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield m


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in bytes."""
    found = [(0, *m.span()) for m in assignments(text)]
    found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return found


def symbols(value: bytes):
    """Symbol numbers of a string between two edges."""
    import numpy as np

    table = np.zeros(256, dtype=np.int64)
    table[np.frombuffer(ALPHABET, np.uint8)] = np.arange(1, len(ALPHABET) + 1)
    return np.concatenate([[0], table[np.frombuffer(value, np.uint8)], [0]])


def labelled(text: bytes):
    """(1 for random or 0 for ordinary, string) of a text."""
    base = base_spans(text)
    values = [m.group(2) for m in assignments(text)]
    values += [text[a:b] for k, a, b in base if k]
    yield from ((1, v) for v in values if any(48 <= c <= 57 for c in v))
    at = 0
    for _, a, b in sorted(base, key=lambda s: s[1]):
        yield from ((0, w) for w in WORD.findall(text[at:max(at, a)]))
        at = max(at, b)
    yield from ((0, w) for w in WORD.findall(text[at:]))


def _count_pairs(batches):
    import numpy as np
    import pyarrow as pa

    size = len(ALPHABET) + 1
    for batch in batches:
        counts = np.zeros((2, size * size), dtype=np.int64)
        for text in batch.column("__text").to_pylist():
            for label in (0, 1):
                strings = [v for x, v in labelled(text) if x == label]
                if strings:
                    ids = symbols(b"\0".join(strings))  # a byte outside the alphabet is an edge
                    np.add.at(counts[label], ids[:-1] * size + ids[1:], 1)
        label, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int64()), pa.array(pair, pa.int64()), pa.array(counts[label, pair], pa.int64())],
            names=["label", "pair", "n"])


class MarkovRatio:
    """Log-likelihood ratio of random strings to ordinary identifiers."""

    def __init__(self, counts):
        """``counts``: rows of (label, pair of symbols, number)."""
        import numpy as np

        size = len(ALPHABET) + 1
        models = np.zeros((2, size, size))
        for label, pair, n in counts:
            models[label, pair // size, pair % size] += n
        # Pairs are smoothed by the single counts, and those by equal shares: random strings may
        # hold any key character, identifiers seldom hold one that the sample never showed.
        for model, share in zip(models, EQUAL_SHARE):
            single = model.sum(axis=0) + 1 / size
            model += SMOOTHING * ((1 - share) * single / single.sum() + share / size)
        models /= models.sum(axis=2, keepdims=True)
        self.ratio = np.log(models[1]) - np.log(models[0])

    def score(self, value: bytes) -> float:
        ids = symbols(value)
        return float(self.ratio[ids[:-1], ids[1:]].sum())

    def best(self, value: bytes) -> tuple[float, int, int] | None:
        """Score, start and end of the best candidate in a stretch; linear in its length."""
        import numpy as np

        ids, codes, size = symbols(value), np.frombuffer(value, np.uint8), len(value)
        before = np.concatenate([[0.0], np.cumsum(self.ratio[ids[:-1], ids[1:]])])
        cuts = np.flatnonzero(np.isin(codes, np.frombuffer(SEPARATORS, np.uint8)))
        starts = np.concatenate([[0], cuts[cuts < size - 1] + 1])
        ends = np.concatenate([cuts[cuts > 0], [size]])
        opened = self.ratio[0, ids[starts + 1]] - before[starts + 1]
        closed = before[ends] + self.ratio[ids[ends], 0]
        # A start must leave room for the least length, a digit and a letter before the end.
        digit = (codes >= 48) & (codes <= 57)
        letter = (codes | 32 >= 97) & (codes | 32 <= 122)
        latest = ends - MIN_LENGTH
        for of in (digit, letter):
            latest = np.minimum(latest, np.maximum.accumulate(np.where(of, np.arange(size), -1))[ends - 1])
        count = np.searchsorted(starts, latest, side="right")
        scores = np.where(count > 0, closed + np.maximum.accumulate(opened)[count - 1], -np.inf)
        n = int(scores.argmax())
        if not count[n]:
            return None
        return float(scores[n]), int(starts[opened[:count[n]].argmax()]), int(ends[n])


def fit_models(docs: DataFrame, key: str = "doc_id", text: str = "text",
               sample_docs: int = SAMPLE_DOCS) -> MarkovRatio:
    """Both models from about ``sample_docs`` texts, those with the smallest hashes of the key."""
    steps = 1 << 20
    share = min(steps, -(-sample_docs * steps // max(1, docs.count())))
    counts = (docs.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(steps)) < share)
              .select(text_bytes(text).alias("__text")).mapInArrow(_count_pairs, "label long, pair long, n long")
              .groupBy("label", "pair").agg(F.sum("n").alias("n")))
    return MarkovRatio([tuple(r) for r in counts.collect()])  # two labels x pairs of symbols at most


def stretches(text: bytes, base) -> list[tuple[int, int]]:
    """Runs of key characters without the base spans in them, and without separators at the cuts."""
    out, overlaps = [], Overlaps(base)
    for m in RUN.finditer(text):
        at, end = m.span()
        for _, x, y in overlaps.of(at, end):
            if at < y:
                out.append((at, at + len(text[at:x].rstrip(SEPARATORS))) if at < x else (at, at))
                at = y
                at = min(at, end) + len(text[at:end]) - len(text[at:end].lstrip(SEPARATORS))
        out.append((at, end))
    return [(a, b) for a, b in out if b - a >= MIN_LENGTH]


def added_spans(text: bytes, base, model: MarkovRatio, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    todo, out = stretches(text, base), []
    while todo:
        a, b = todo.pop()
        best = model.best(text[a:b]) if b - a >= MIN_LENGTH else None
        if best and best[0] > margin:
            x, y = a + best[1], a + best[2]
            out.append((3, x, y))
            todo.append((a, a + len(text[a:x].rstrip(SEPARATORS))))
            todo.append((b - len(text[y:b].lstrip(SEPARATORS)), b))
    return sorted(out)


def _find(model: MarkovRatio):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column("__text").to_pylist():
                base = base_spans(text)
                own = code_points(text, [*base, *added_spans(text, base, model)])
                rows.append(sorted(((k, a, b, n < len(base)) for n, (k, a, b) in enumerate(own)),
                                   key=lambda s: (s[1], s[0], s[2])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), span_array(rows, KINDS)], names=["key", "spans"])
    return run


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 model: MarkovRatio | None = None) -> DataFrame:
    """key, spans array<struct<kind, start, end, base>> by start and kind; fits models if none are given."""
    prepared(docs.sparkSession)
    model = model or fit_models(docs, key, text)
    rows = docs.select(F.col(key).alias("key"), text_bytes(text).alias("__text"))
    schema = T.StructType([rows.schema["key"], T.StructField("spans", SPANS)])
    return rows.mapInArrow(_find(model), schema).withColumnRenamed("key", key)
