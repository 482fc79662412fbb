"""Windows found by the prefix join against plain search of every window."""
import random
import re

from llm_tables import docs  # noqa: F401

from forumlens.llm.decontaminate import contamination, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(documents, items, window=10):
    windows = {}
    for item, text in items:
        words = plain_words(text)
        if words:
            n = min(window, len(words))
            for a in range(len(words) - n + 1):
                windows.setdefault(tuple(words[a:a + n]), set()).add(item)
    out = []
    for key, text in documents:
        words, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for a in range(len(words) - n + 1):
                if tuple(words[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(words[a:a + n])]
        out.append((key, len(words), len(hit), sorted(str(f) for f in found if f is not None)))
    return out


def rows(found):
    return [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()]


def order(row):
    return (row[0] is None, row[0] or 0, row[1], row[2])


def compare(spark, documents, items, docs, **settings):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(rows(contamination(docs(documents), bench, **settings)), key=order) == sorted(
        plain(documents, items), key=order)


def test_words():
    text = "Ab-c9 ÀÉ_x'y\0z 中文。ok"
    assert [w.decode() for w in words_of(text.encode())] == plain_words(text)


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(8)]  # few words: shingles repeat in one text and in many
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((1, 2, 4, 5, 9, 10, 11, 30))))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "?!"), (3, items[3][1]), (93, items[5][1].upper())]
    documents = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.choice((0, 3, 12, 80)))
        if k % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = plain_words(rng.choice(items)[1])
        documents.append((k, "; ".join(words)))
    return [*documents, (7, documents[7][1]), (None, items[4][1]), (70, None), (71, " ".join(f"u{k}" for k in range(20_000)))], items


def test_against_every_window(spark, docs):
    compare(spark, *make(1), docs)


def test_benchmark_in_blocks(spark, docs):
    compare(spark, *make(2), docs, block_words=20)


def test_empty_tables_and_clashing_columns(spark, docs):
    compare(spark, [], make(1)[1], docs)
    bench = spark.createDataFrame([], "item_id long, text string")
    clashing = docs([(1, "a b c")]).withColumnRenamed("n_chars", "n_words").withColumnRenamed("source", "items")
    assert rows(contamination(clashing, bench)) == [(1, 3, 0, [])]
