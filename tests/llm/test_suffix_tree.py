"""Suffix tree scores against a model counted word by word, in many small chunks."""
import random
import re
import zlib
from collections import Counter
from math import isclose, log, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_tables import docs  # noqa: F401

from forumlens.llm import suffix_tree as S
from forumlens.llm.suffix_tree import distinct, pack, score_texts, text_hashes, unpack, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]  # None: the end


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 10 == 0


def plain(rows, depth, least, divergence, strength):
    """(key, held out, tokens, known, N, base score, score) by counting every context."""
    training = [tokens(t) for key, t in rows if not held(key)]
    count = Counter()
    for words in training:
        count.update(tuple(words[a:b]) for b in range(1, len(words) + 1) for a in range(max(0, b - depth - 1), b))
    total, vocabulary = sum(map(len, training)), sum(len(g) == 1 for g in count)
    root = lambda w: (count[(w,)] + 0.1) / (total + 0.1 * (vocabulary + 1))
    states = {()}

    def chance(context, word):
        """In the longest state that ends ``context``."""
        while context not in states:
            context = context[1:]
        if not context:
            return root(word)
        return (count[(*context, word)] + strength * chance(context[1:], word)) / (count[context] + strength)

    for k in range(1, depth + 1):
        gain = Counter()
        for words in training:
            for i in range(k, len(words)):
                context = tuple(words[i - k:i])
                if count[context] >= least and context[1:] in states:
                    n, c, p = count[context], count[(*context, words[i])], chance(context[1:], words[i])
                    gain[context] += log((c - 1 + strength * p) / ((n - 1 + strength) * p))
        states |= {c for c, g in gain.items() if g >= divergence}
    out = []
    for key, text in rows:
        words = tokens(text)
        score = sum(log10(chance(tuple(words[max(0, i - depth):i]), w)) for i, w in enumerate(words))
        out.append((key, held(key), len(words), sum(count[(w,)] > 0 for w in words), total,
                    sum(log10(root(w)) for w in words), score))
    return out, states


def corpus(seed, n=120):
    rng = random.Random(seed)
    phrases = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(8)]
    rows = []
    for key in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else " ".join(rng.choice("Abcxyzé") * rng.randint(1, 3)
                                                                          for _ in range(4)) for _ in range(rng.randint(0, 8))]
        rows.append((key, rng.choice([" ", "\n", "\t "]).join(parts)))
    return rows + [(7, rows[9][1])] * 3 + [(None, rows[9][1]), (500, None), (501, " \n "), (502, "word one x")]


def rows_of(out):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                   for r in out.collect()), key=lambda r: (str(r[0]), r[2:]))


def same(got, want):
    want = sorted(want, key=lambda r: (str(r[0]), r[2:]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(isclose(a, b, rel_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


@pytest.mark.parametrize("setting", [(0, 2, 1.0, 5.0), (1, 2, 0.5, 5.0), (3, 3, 2.0, 20.0), (3, 2, -3.0, 2.0)])
def test_as_counted_word_by_word(spark, docs, setting, tmp_path):
    rows = corpus(sum(map(int, setting)))
    depth, least, divergence, strength = setting
    want, states = plain(rows, *setting)
    got = score_texts(docs(rows).repartition(3), max_context=depth, min_count=least, divergence=divergence,
                      strength=strength, chunk_tokens=150, bucket_tokens=100)
    same(rows_of(got), want)
    if depth == 3:
        assert {len(s) for s in states} >= {0, 1, 2, 3}
        tried = {c for _, t in rows if not held(_) for w in [tokens(t)] for i in range(len(w)) for c in [tuple(w[i:i + 1])]}
        assert divergence < 0 or not tried <= states  # the test turns some contexts down


def test_repeated_passages_of_the_training_texts_score_higher(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, vocabulary = [word() for _ in range(30)], [word() for _ in range(300)]
    trained = [k for k in range(300) if not held(k)]
    rows = [(k, " ".join([rng.choice(vocabulary + passage) for _ in range(60)] + (passage if k % 9 == 0 else []))) for k in trained]
    asked = [k for k in range(300, 600) if held(k)][:2]
    rows += [(asked[0], " ".join(passage)), (asked[1], " ".join(rng.sample(passage, 30)))]
    got = {r.doc_id: r for r in score_texts(docs(rows)).where("held_out").collect()}
    assert got[asked[0]].score > got[asked[1]].score + 10 and got[asked[0]].score > got[asked[0]].base_score + 10


def test_next_words_of_a_state_share_one(spark, docs):
    rows = [(k, "a b") for k in range(1, 40)] + [(k, "a c") for k in range(40, 60)]
    want, _ = plain(rows, 1, 3, 4.0, 50.0)
    n = sum(not held(k) for k, _ in rows)
    count = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    assert n == count["a"]
    same(rows_of(score_texts(docs(rows), max_context=1)), want)


def test_empty_and_untrained_tables(spark, docs):
    assert score_texts(docs([])).collect() == []
    table = docs([(1, "a b"), (2, None)]).withColumnRenamed("lang", "score").withColumnRenamed("source", "chunk")
    got = rows_of(score_texts(table, held=F.lit(True)))
    assert [(g[0], g[2], g[3], g[4], g[5], g[6]) for g in got] == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_hashes_follow_the_words(monkeypatch):
    text = "The the\tTHE ñ Ñ x\x0b\x0cy  a b \x1cz".encode()
    words = text.lower().split()
    hashes, places = word_hashes(text)
    assert [text[p:p + 1].lower() for p in places] == [w[:1] for w in words]
    assert {h: w for h, w in zip(hashes.tolist(), words)}.keys() == set(hashes.tolist()) and len(set(hashes.tolist())) == len(set(words))
    monkeypatch.setattr(S, "PIECE_BYTES", 7)
    S._piece_powers.cache_clear()
    long = text + b" averylongwordbeyondapiece " + text + b"x" * 30
    cut = word_hashes(long)[0].tolist()
    S._piece_powers.cache_clear()
    monkeypatch.undo()
    S._piece_powers.cache_clear()
    assert cut == word_hashes(long)[0].tolist()
    found, sizes = text_hashes([b"a b", b"", b" ", b"a"])
    assert sizes.tolist() == [3, 1, 1, 2] and found[2] == found[3] == found[4] == np.uint64(S.END) and found[0] == found[5]


def test_planes_and_distinct():
    rng = np.random.default_rng(2)
    for kind in ("<u8", "<u4", "u1", "<f8"):
        values = rng.integers(0, 200, 50).astype(kind)
        assert unpack(pack(values), kind).tolist() == values.tolist()
    for values in (rng.integers(0, 1 << 63, 999, dtype=np.uint64), rng.integers(0, 1 << 10, 999, dtype=np.uint64),
                   np.array([5, 4, 5, 4], dtype=np.uint64), np.empty(0, np.uint64)):
        keys, which = distinct(values)
        want = np.unique(values, return_inverse=True)
        assert keys.tolist() == want[0].tolist() and which.tolist() == want[1].tolist()


def test_exchanges_are_small_and_move_once(spark, docs, monkeypatch):
    """No exchange asks for more than half of the word pairs, and no step moves what earlier ones returned."""
    plans = []
    work, returned = S.work, S._returned
    rows = corpus(11)

    texts = [t for _, t in rows]
    hashes, sizes = text_hashes([(t or "").encode() for t in texts])
    words, ids = distinct(hashes)
    row = {"words": pack(words), "ids": pack(ids.astype("<u4")), "sizes": sizes.tolist(), "held": [held(k) for k, _ in rows]}
    model = S.Model(3, 3, 2.0, 20.0)
    model.tokens, model.words = len(ids), len(words)
    counts = np.bincount(ids[~np.repeat(row["held"], sizes)], minlength=len(words))
    back = {"c0": 2 * counts + 1, "ranks": np.empty(0, np.uint32)}
    halves = []
    for step in range(1, 3):
        (kind, found, names, amounts), = work(row, back, step, model)
        assert kind == "c1" and len(found) == len(names) == len(amounts)
        halves.append(found)
    assert (halves[0] >> np.uint64(63) == 0).all() and (halves[1] >> np.uint64(63) == 1).all()
    assert len(halves[0]) and len(halves[1]) and max(map(len, halves)) < 0.7 * sum(map(len, halves))

    def seen(answers, name, buckets):
        plans.append(answers._jdf.queryExecution().executedPlan().toString())
        return returned(answers, name, buckets)
    monkeypatch.setattr(S, "_returned", seen)
    got = score_texts(docs(rows).repartition(3), min_count=3, divergence=2.0, strength=20.0, chunk_tokens=150, bucket_tokens=100)
    want, _ = plain(rows, 3, 3, 2.0, 20.0)
    same(rows_of(got), want)
    # One exchange to the buckets of the hashes in each: neither chunks nor answers are dealt out anew.
    assert len(plans) == 8 and all(p.count("Exchange hashpartitioning") == 1 for p in plans)


def test_grams_of_one_chunk_are_counted_there():
    text = b"p q r p q s p q r p q s"
    hashes, sizes = text_hashes([text] * 2)
    words, ids = distinct(hashes)
    row = {"words": pack(words), "ids": pack(ids.astype("<u4")), "sizes": sizes.tolist(), "held": [False, False]}
    model = S.Model(3, 2, 0.1, 5.0)
    model.tokens, model.words = len(ids), len(words)
    nobody_else = {"c0": 2 * np.bincount(ids), **{f"{c}{k}": np.empty(0, np.int64) for c in "cs" for k in range(1, 4)},
                   "ranks": np.empty(0, np.uint32)}
    for step in range(1, 8):
        assert all(not len(asked) for _, asked, _, _ in S.work(row, nobody_else, step, model))
    want, _ = plain([(None, text.decode())] * 2, 3, 2, 0.1, 5.0)
    got = S.work(row, nobody_else, S.LAST, model)
    assert all(isclose(a, w[6], rel_tol=1e-9) for a, w in zip(got[3], want))


def test_only_grams_that_may_count_are_hashed_and_sorted(monkeypatch):
    """Each step has all shorter grams again, so it hashes those whose context may be a state, and sorts its half."""
    rng = random.Random(12)
    text = " ".join(rng.choice("abc") if rng.random() < 0.3 else f"w{rng.randrange(1500)}" for _ in range(6000))
    hashes, sizes = text_hashes([text.encode()] * 2)
    words, ids = distinct(hashes)
    counts = np.bincount(ids)
    row = {"words": pack(words), "ids": pack(ids.astype("<u4")), "sizes": sizes.tolist(), "held": [False, False]}
    model = S.Model(3, 12, 4.0, 50.0)
    model.tokens, model.words = len(ids), len(words)
    shared = {"c0": 2 * counts + 1, "ranks": np.empty(0, np.uint32)}
    hashed, sorted_, joined = [], [], S.joined
    monkeypatch.setattr(S, "joined", lambda a, b: hashed.append(len(a)) or joined(a, b))
    for name in ("distinct", "grouped"):
        one = getattr(S, name, None)
        monkeypatch.setattr(S, name, lambda values, one=one: sorted_.append(len(values)) or one(values), raising=False)
    parts = [S.work(row, shared, step, model)[0] for step in (1, 2)]
    frequent = int((counts[ids] >= 12).sum())  # the words that may be a context
    assert max(hashed) <= frequent < 0.7 * len(ids)
    assert sum(sorted_) <= frequent  # both halves together, each hash once
    words = tokens(text)
    pairs, count = Counter(2 * [*zip(words, words[1:])]), Counter(2 * words)
    want = sorted(c for (word, _), c in pairs.items() if count[word] >= 12)
    assert sorted(int(c) for _, _, _, amounts in parts for c in amounts) == want
