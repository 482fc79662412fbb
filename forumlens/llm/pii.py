"""Personal data: fixed patterns, and a semi-Markov conditional random field around them.

Base spans are the matches of four fixed patterns with their checks (e-mail, IPv4, payment
card with Luhn, international phone number). A semi-Markov CRF then reads the text around
every digit, ``@`` or written-out ``(at)``: it scores whole candidate segments of at most
``MAX_TOKENS`` tokens, blanks not counted, by features of the whole span (digit count, separators, Luhn, octets,
domain shape, words before it, what it cuts off at its ends), and a bounded-length dynamic
program chooses boundaries and kinds together. Base spans are fixed segments of that program;
segments that it adds (a phone number without ``+``, ``name (at) host dot org``) join them.

The weights are fitted by conditional likelihood on a bounded sample of the texts: snippets
labelled by the base patterns, and copies of them rewritten into common looser spellings.

Cases: NULL and empty texts have no spans; texts without a trigger are not scored; repeated
rows are scored alike and kept; other columns are ignored; with no labelled snippet the base
spans are returned alone; positions are code points, the end exclusive.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate, chain

from pyspark.sql import DataFrame, functions as F, types as T

from .common import prepared, text_bytes

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 4_000
SNIPPETS_PER_DOC = 4
TRAIN_SNIPPETS = 600
EPOCHS = 6
MAX_TOKENS = 14
CONTEXT = 40  # bytes of text on either side of a trigger
MARGIN = 2.0  # log-odds by which an added segment must beat leaving it out

DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(rb"[0-9][0-9 ().+-]*|@|[\[(] ?at ?[\])]", re.I)
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[ \t]+|.", re.S)
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# What follows the edge of a region within a written-out host.
HOST_REST = re.compile(rb"(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]+)+", re.I)
WORD_BYTES = LOCAL | frozenset(range(0x80, 0x100))
CUES = {b"tel": "phone", b"phone": "phone", b"call": "phone", b"fax": "phone", b"mobile": "phone",
        b"mail": "email", b"email": "email", b"contact": "email", b"card": "card", b"visa": "card",
        b"credit": "card", b"ip": "ip", b"host": "ip", b"addr": "ip", b"address": "ip", b"server": "ip"}


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def only_digits(raw: bytes) -> bytes:
    return bytes(c for c in raw if 48 <= c <= 57)


def _emails(text: bytes):
    last, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find(b"@", max(at + 1, last))


def _ips(text: bytes):
    for chain in CHAIN.finditer(text):
        parts = chain.group().split(b".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in bytes, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, a, b) for a, b in _ips(text)]
    for m in CARD.finditer(text):
        digits = only_digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m.group())) <= 15:
            found.append((3, *m.span()))
    return found


def regions(text: bytes):
    """Stretches of text around triggers, cut at line ends; overlapping ones are one.

    An edge within a word or an address moves to its end.
    """
    start = end = -1
    for m in TRIGGER.finditer(text):
        if len(m.group()) < 3 and m.group() != b"@":
            continue
        low, high = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        a = max(low, text.rfind(b"\n", low, m.start()) + 1)
        stop = text.find(b"\n", m.end(), high)
        b = stop if stop >= 0 else high
        while a > max(end, 0) and text[a - 1] in WORD_BYTES:
            a -= 1
        if b > end:
            while b < len(text) and text[b] in WORD_BYTES:
                b += 1
            if not m.group()[:1].isdigit():
                rests = (HOST_REST.match(text, k) for k in range(max(m.end(), b - 8), b + 1))
                b = max([b, *(rest.end() for rest in rests if rest)])
        if a <= end:
            end = max(b, end)
            continue
        if end >= 0:
            yield start, end
        start, end = a, b
    if end >= 0:
        yield start, end


class Region:
    """A stretch of text as tokens, with the candidate segments that may hold personal data."""

    def __init__(self, text: bytes):
        self.text = text
        bounds = [m.start() for m in TOKEN.finditer(text)]
        # Bounds inside a character that is more than a byte long are no bounds.
        self.bounds = [b for b in bounds if text[b] & 0xC0 != 0x80] + [len(text)]
        self.count = len(self.bounds) - 1

    def segments(self, gold: dict[tuple[int, int], int] | None = None, taken: bytearray | None = None):
        """(first token, end token, features, kinds) of the candidates; ``gold`` ones are always among
        them, and none that holds a ``taken`` token."""
        out = []
        starts = [self.text[b] for b in self.bounds[:-1]]
        signs = [m.span() for m in AT_SIGN.finditer(self.text)]
        sign_starts = [a for a, _ in signs]
        tokens = [self.text[a:b] for a, b in zip(self.bounds, self.bounds[1:])]
        digits = list(accumulate(chain([0], (len(t) if t[:1].isdigit() else 0 for t in tokens))))
        words = list(accumulate(chain([0], (t.strip(b"0123456789 ().+-") != b"" for t in tokens))))
        covered = list(accumulate(chain([0], taken or bytes(self.count))))
        for i in range(self.count):
            if not (48 <= starts[i] <= 57 or starts[i] in b"+(" or 65 <= starts[i] & 0xDF <= 90):
                continue
            size, sign = 0, bisect_left(sign_starts, self.bounds[i])
            reach = signs[sign][1] if sign < len(signs) else len(self.text) + 1
            for j in range(i + 1, self.count + 1):
                size += starts[j - 1] not in b" \t"
                if size > MAX_TOKENS or covered[j] > covered[i]:
                    break
                a, b = self.bounds[i], self.bounds[j]
                # Without an at-sign, no span of other than 4 to 19 digits and their separators has a kind.
                if b < reach and (words[j] > words[i] or not 4 <= digits[j] - digits[i] <= 19):
                    continue
                last = self.text[b - 1]
                if not (48 <= last <= 57 or 65 <= last & 0xDF <= 90) or b - a < 6:
                    continue
                features = span_features(self.text, a, b)
                kinds = possible_kinds(features, len(only_digits(self.text[a:b]))) if features else []
                if kinds:
                    out.append((i, j, features, kinds))
        for (i, j), kind in (gold or {}).items():
            if not any((i, j) == s[:2] and kind in s[3] for s in out):
                out.append((i, j, span_features(self.text, self.bounds[i], self.bounds[j]) or ["other"], [kind]))
        return out


AT_SIGN = re.compile(rb"[\[(] ?at ?[\])]|@", re.I)
AT = re.compile(rb" ?[\[(] ?at ?[\])] ?| ?@ ?", re.I)
DOT = re.compile(rb" ?[\[(] ?dot ?[\])] ?| dot |\.", re.I)
NAME = re.compile(rb"[A-Za-z0-9_%+.-]+\Z")


def _bucket(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


def span_features(text: bytes, a: int, b: int) -> list[str] | None:
    """Names of the features of a whole span; None if it can be no personal data."""
    span = text[a:b]
    digits = only_digits(span)
    ats = AT.findall(span)
    out = []
    if ats:
        local, _, host = span.partition(ats[0])
        labels = [x.strip() for x in DOT.split(host)]
        shaped = len(ats) == 1 and bool(NAME.match(local)) and len(labels) > 1 and all(
            re.fullmatch(rb"[A-Za-z0-9-]+", x) for x in labels)
        if not shaped:
            return None
        out.append("address")
        out.append(f"tail{_bucket(len(labels[-1]), 2, 3, 5, 8)}{labels[-1].isalpha()}")
        out.append("plain-at" if ats[0] == b"@" else "written-at")
    elif len(digits) >= 4 and not re.search(rb"[^0-9 ().+-]", span):
        groups = re.findall(rb"[0-9]+", span)
        signs = set(re.findall(rb"[^0-9]", span))
        out.append(f"digits{_bucket(len(digits), 7, 9, 11, 13, 16, 17, 20)}")
        out.append(f"groups{min(len(groups), 6)}")
        dotted = signs == {b"."} and len(groups) == 4 and span.count(b".") == 3
        octets = dotted and all(len(g) <= 3 and int(g) <= 255 for g in groups)
        out.append("octets" if octets else "no-octets")
        length = 13 <= len(digits) <= 19
        out.append(f"luhn{length and luhn(digits)}")
        card = length and (len(groups) == 1 or all(len(g) == 4 for g in groups[:-1]))
        out.append(f"card-shape{card}-luhn{card and luhn(digits)}")
        out.append("plus" if span[:1] == b"+" else "no-plus")
        nested = re.fullmatch(rb"(\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}", span)
        chunks = re.fullmatch(rb"\+?[0-9]{1,3}([ .-])[0-9]{3}\1[0-9]{3,4}(\1[0-9]{2,4})?", span)
        out.append("phone-brackets" if nested else "phone-chunks" if chunks and not octets else "no-phone-shape")
        if len(signs - {b"+"}) > 3 or re.search(rb"[ ().+-]{4}", span):
            out.append("loose")
        if span.count(b"(") != span.count(b")"):
            out.append("open-bracket")
    else:
        return None
    before, after = text[a - 1:a], text[b:b + 1]
    inner = rb"[A-Za-z0-9\x80-\xff]"
    out.append(f"cut-left{bool(re.match(inner, before))}")
    out.append(f"cut-right{bool(re.match(inner, after))}")
    if re.match(rb"[@.+%_-]", before) and before != b".":
        out.append("joined-left")
    if re.match(rb"[.@-][A-Za-z0-9]", text[b:b + 2]) or ats and HOST_REST.match(text, b):
        out.append("joined-right")
    for word in re.findall(rb"[a-z]+", text[max(0, a - 24):a].lower()):
        if word in CUES:
            out.append(f"cue-{CUES[word]}")
    return out


def possible_kinds(features: list[str], digits: int) -> list[int]:
    """Kinds that a span may have at all; the weights choose among them."""
    if "address" in features:
        return [0]
    return ([1] if "octets" in features else []) + ([2] if "luhnTrue" in features else []) + (
        [3] if 7 <= digits <= 15 and "octets" not in features else [])


def _log_sum(values) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class SemiMarkov:
    """Weights by (kind, feature); leaving a token outside scores 0."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}

    def score(self, kind: int, features: list[str]) -> float:
        get = self.weights.get
        return get((kind, "bias"), 0.0) + sum(get((kind, f), 0.0) for f in features)

    def _by_end(self, segments):
        ends = defaultdict(list)
        for i, j, features, kinds in segments:
            for kind in kinds:
                ends[j].append((i, kind, features, self.score(kind, features)))
        return ends

    def gradient(self, region: Region, segments, gold: dict[tuple[int, int], int]):
        """Observed minus expected feature counts of a labelled region."""
        n, ends = region.count, self._by_end(segments)
        forward = [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = _log_sum([forward[j - 1], *(forward[i] + s for i, _, _, s in ends[j])])
        backward, starts = [0.0] * (n + 1), defaultdict(list)
        for j, rows in ends.items():
            for i, _, _, s in rows:
                starts[i].append((j, s))
        for i in range(n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[j] + s for j, s in starts[i])])
        out = defaultdict(float)
        for j, rows in ends.items():
            for i, kind, features, s in rows:
                change = (gold.get((i, j)) == kind) - math.exp(forward[i] + s + backward[j] - forward[n])
                if abs(change) > 1e-6:
                    for f in (*features, "bias"):
                        out[kind, f] += change
        return out

    def fit(self, examples, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-3) -> "SemiMarkov":
        """Adagrad on the conditional likelihood; ``examples``: (region, segments, gold)."""
        square: dict = defaultdict(lambda: 1e-8)
        for _ in range(epochs):
            for example in examples:
                for f, g in self.gradient(*example).items():
                    g -= decay * self.weights.get(f, 0.0)
                    square[f] += g * g
                    self.weights[f] = self.weights.get(f, 0.0) + rate * g / math.sqrt(square[f])
        return self

    def decode(self, region: Region, segments, fixed: dict[tuple[int, int], int], margin: float = MARGIN):
        """Best segmentation that holds the ``fixed`` segments: (kind, start, end) in bytes."""
        taken = _covered(region, fixed)
        ends = defaultdict(list)
        for i, j, kind, s in ((i, j, kind, s) for j, rows in self._by_end(segments).items() for i, kind, _, s in rows):
            if s > margin and not any(taken[i:j]):
                ends[j].append((i, kind, s - margin))
        best, back = [0.0] * (region.count + 1), [None] * (region.count + 1)
        for j in range(1, region.count + 1):
            best[j] = best[j - 1]
            for i, kind, s in ends[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        out, j = [], region.count
        while j > 0:
            if back[j]:
                i, kind = back[j]
                out.append((kind, region.bounds[i], region.bounds[j]))
                j = i
            else:
                j -= 1
        return out[::-1]


def _aligned(region: Region, spans) -> dict[tuple[int, int], int]:
    """The spans as token ranges, widened to whole tokens."""
    out, taken = {}, bytearray(region.count)
    for kind, a, b in spans:
        i = bisect_right(region.bounds, a, 0, region.count) - 1
        j = bisect_left(region.bounds, b, 1, region.count)
        if not any(taken[i:j]):
            out[i, j] = kind
            taken[i:j] = b"\1" * (j - i)
    return out


class Overlaps:
    """Finds the spans that touch a stretch; the spans may overlap each other."""

    def __init__(self, spans):
        self.spans = sorted(spans, key=lambda s: s[1])
        self.starts = [s for _, s, _ in self.spans]
        self.reach = list(accumulate((e for _, _, e in self.spans), max))

    def of(self, a: int, b: int) -> list[tuple[int, int, int]]:
        low, high = bisect_right(self.reach, a), bisect_left(self.starts, b)
        return [s for s in self.spans[low:high] if s[2] > a]


def _covered(region: Region, fixed) -> bytearray:
    """1 for every token inside a fixed segment."""
    taken = bytearray(region.count)
    for i, j in fixed:
        taken[i:j] = b"\1" * (j - i)
    return taken


def added_spans(text: bytes, base, model: SemiMarkov) -> list[tuple[int, int, int]]:
    if not model.weights:
        return []
    out, overlaps = [], Overlaps(base)
    for a, b in regions(text):
        # A base span over the edge widens the region to its own end.
        inside = overlaps.of(a, b)
        a, b = min([a, *(s for _, s, _ in inside)]), max([b, *(e for _, _, e in inside)])
        region = Region(text[a:b])
        fixed = _aligned(region, [(k, s - a, e - a) for k, s, e in inside])
        segments = region.segments(taken=_covered(region, fixed))
        if segments:
            out += [(k, s + a, e + a) for k, s, e in model.decode(region, segments, fixed)]
    clean = []
    for k, s, e in sorted(out, key=lambda x: x[1]):
        if (not clean or s >= clean[-1][2]) and not overlaps.of(s, e):
            clean.append((k, s, e))
    return clean


def _looser(kind: int, span: bytes, turn: int) -> bytes | None:
    """A looser spelling of a labelled span, as people write it."""
    if kind == 0:
        local, _, host = span.partition(b"@")
        return (local + b" (at) " + host.replace(b".", b" dot "), local + b" @ " + host,
                local + b" [at] " + host, local + b"(at)" + host)[turn % 4]
    if kind == 3:
        digits = only_digits(span)
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return (b"(" + a + b") " + b + b"-" + c, a + b"-" + b + b"-" + c, a + b"." + b + b"." + c)[turn % 3]
    if kind == 2:
        digits = only_digits(span)
        return b".".join(digits[k:k + 4] for k in range(0, len(digits), 4)) if len(digits) == 16 else None
    return None


def training_examples(snippets: list[bytes]):
    """(region, segments, gold) of snippets as found and rewritten; labels are the base spans."""
    out = []
    for turn, snippet in enumerate(snippets):
        spans = base_spans(snippet)
        rows = [(snippet, spans)]
        if len(spans) == 1:
            kind, a, b = spans[0]
            other = _looser(kind, snippet[a:b], turn)
            if other and (snippet[:a][-1:] in (b" ", b"")):
                rows.append((snippet[:a] + other + snippet[b:], [(kind, a, a + len(other))]))
        for text, labels in rows:
            region = Region(text)
            gold = _aligned(region, labels)
            out.append((region, region.segments(gold), gold))
    return out


def _snippets(per_doc: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for text in batch.column("__text").to_pylist():
                found += [text[a:b] for a, b in list(regions(text))[:per_doc] if b - a <= 400]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["snippet"])
    return run


def fit_model(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS,
              train_snippets: int = TRAIN_SNIPPETS) -> SemiMarkov:
    """Fit on about ``sample_docs`` texts (smallest hashes of the key) and at most ``train_snippets`` snippets."""
    steps = 1 << 20
    total = docs.count()
    share = min(steps, -(-sample_docs * steps // max(1, total)))
    rows = (docs.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(steps)) < share)
            .select(text_bytes(text).alias("__text"))
            .mapInArrow(_snippets(SNIPPETS_PER_DOC), "snippet binary")
            .orderBy(F.xxhash64("snippet"), "snippet").limit(train_snippets).collect())
    return SemiMarkov().fit(training_examples([bytes(r[0]) for r in rows]))


def code_points(text: bytes, spans):
    """Byte positions as code points."""
    if text.isascii():
        return spans
    ends = sorted({p for _, a, b in spans for p in (a, b)})
    at, seen, last = {}, 0, 0
    for p in ends:
        seen += len(text[last:p].decode("utf-8", "replace"))
        at[p], last = seen, p
    return [(k, at[a], at[b]) for k, a, b in spans]


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def span_array(rows, names):
    """Arrow array of span lists; ``rows``: lists of (kind number, start, end, base)."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    return pa.array([[{"kind": names[k], "start": a, "end": b, "base": base} for k, a, b, base in row]
                     for row in rows], kind)


def _find(model: SemiMarkov):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column("__text").to_pylist():
                base = base_spans(text)
                added = added_spans(text, base, model)
                own = code_points(text, [*base, *added])
                rows.append(sorted((k, a, b, n < len(base)) for n, (k, a, b) in enumerate(own)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), span_array(rows, KINDS)], names=["key", "spans"])
    return run


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       model: SemiMarkov | None = None) -> DataFrame:
    """key, spans array<struct<kind, start, end, base>> by kind and start; fits a model if none is given."""
    prepared(docs.sparkSession)
    model = model or fit_model(docs, key, text)
    rows = docs.select(F.col(key).alias("key"), text_bytes(text).alias("__text"))
    schema = T.StructType([rows.schema["key"], T.StructField("spans", SPANS)])
    return rows.mapInArrow(_find(model), schema).withColumnRenamed("key", key)
