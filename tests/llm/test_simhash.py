"""Fingerprints and components against all pairs."""
import random
import re

import numpy as np
import pytest
from llm_tables import docs  # noqa: F401
import xxhash

from forumlens.llm.components import connected_components
from forumlens.llm.simhash import fingerprint, links, near_duplicates, representatives, star_of


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def near_prints(rng, groups, size, flips):
    out = set()
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


TEXTS = [None, "", " \n", "one", "One", "a b c d", "A B C D", "Ünï çödé words here AND there " * 9, "x " * 5000]


def test_fingerprints():
    for text in TEXTS:
        assert int.from_bytes(fingerprint((text or "").encode()), "big") == plain_fingerprint(text)


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_keep_every_component(spark, tile):
    rng = random.Random(tile)
    prints = near_prints(rng, 6, 60, 5) + near_prints(rng, 200, 1, 0) + near_prints(rng, 40, 3, 2)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    found = links(spark.createDataFrame(signed, "fp long"), tile=tile)
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in found.collect()]
    at = {x: k for k, x in enumerate(prints)}
    want = plain_components(prints)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(x) for x in range(len(prints))] == want


def test_star_is_linear():
    rng = random.Random(3)
    prints = np.array(near_prints(rng, 1, 500, 2), dtype=np.uint64)
    assert len(star_of(prints, 4)) <= len(prints) - 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 400)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 400)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(spark, docs):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, " ".join(["changed", *t.split()[1:]])) for k, t in enumerate(base)]
    rows += [(200 + k, t) for k, t in enumerate(TEXTS)] + [(200, None), (None, base[3])]
    prints = [plain_fingerprint(t) for _, t in rows]
    classes = plain_components(prints)
    lowest = {}
    for (key, _), c in zip(rows, classes):
        lowest[c] = min(x for x in (lowest.get(c), key) if x is not None)
    got = near_duplicates(docs(rows).withColumnRenamed("n_chars", "fp")).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=order) == sorted(
        ((k, p, lowest[c]) for (k, _), p, c in zip(rows, prints, classes)), key=order)
    kept = representatives(docs(rows)).collect()
    assert len(kept) == len(set(classes)) and {r.doc_id for r in kept} - {None} <= set(lowest.values())


def test_empty(spark, docs):
    assert near_duplicates(docs([])).collect() == []
    assert representatives(docs([])).collect() == []
