"""Line deduplication by example, and its alignment against a plain search."""
import random
from itertools import combinations

from llm_tables import docs  # noqa: F401

from forumlens.llm.line_dedup import align, delete_common_blocks

A, B, C, D = (f"{w} line of some words here" for w in ("first", "second", "third", "fourth"))


def texts(found):
    return {r.doc_id: r.text for r in found.collect()}


def test_align_is_rising_and_equal():
    rng = random.Random(0)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 9))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 9))]
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_align_finds_unique_common_lines_in_their_longest_order():
    rng = random.Random(1)
    for _ in range(100):
        a = rng.sample(range(30), 8)
        b = rng.sample(range(30), 8)
        common = [h for h in a if h in b]
        best = max((len(c) for n in range(len(common) + 1) for c in combinations(common, n)
                    if [b.index(h) for h in c] == sorted(b.index(h) for h in c)), default=0)
        assert len(align(a, b)) >= best - 1 and len(align(a, a)) == len(a)


def test_blocks_go_from_the_later_document(spark, docs):
    rows = [(1, f"x one\n{A}\n\n{B}\ny"), (2, f"own text of two\n {A} \n{B}\nend of two"), (3, f"{C}\n{D}"),
            (4, f"{D}\n{C}\nalone"), (5, "y\nx one"), (6, None), (7, ""), (8, f"{A}\n{A}\n{A}")]
    got = texts(delete_common_blocks(docs(rows)))
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "own text of two\nend of two"
    # The order differs, so only one of both lines aligns with the earlier document.
    assert got[4] in (f"{D}\nalone", f"{C}\nalone")
    assert got[5] == "y\nx one"  # blocks of fewer than five words stay
    assert got[6] is None and got[7] == ""
    assert got[8] == f"{A}\n{A}"


def test_block_is_found_through_its_first_holder(spark, docs):
    rows = [(k, f"{A}\n{B}\nown words of document number {k}") for k in range(40)]
    got = texts(delete_common_blocks(docs(rows).repartition(5)))
    assert got[0] == rows[0][1] and all(got[k] == f"own words of document number {k}" for k in range(1, 40))


def test_copy_whose_lines_have_different_first_holders(spark, docs):
    short = [f"line {k} here" for k in range(5)]
    rows = [(k, f"own text {k}\n{x}\nend {k}") for k, x in enumerate(short)]
    copied = "\n".join(short)
    rows += [(6, copied), (7, copied), (8, f"other\n{A}\nother end"), (9, f"{A}\nx\n{B}"), (10, f"{A}\nx\n{B}"),
             (11, f"{short[0]}\n{short[1]}\n\n{A}\nx"), (12, short[3])]
    got = texts(delete_common_blocks(docs(rows).repartition(4)))
    assert all(got[k] == body for k, body in rows if k < 7)
    assert got[7] == "" and got[8] == rows[7][1]
    assert got[9] == f"x\n{B}" and got[10] == ""
    assert got[11] == "" and got[12] == short[3]


def plain_runs(lines, least=5):
    """Every stretch of lines of ``least`` words or more."""
    words = [len(x.split()) for x in lines]
    return [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sum(words[a:b]) >= least]


def test_every_block_of_a_copy_goes(spark, docs):
    rng = random.Random(5)
    pool = [" ".join([f"w{k}"] * rng.randint(1, 7)) for k in range(60)]
    rows, copies = [], {}
    for k in range(60):  # stretches of the pool in its order, so that all alignments agree
        a = rng.randrange(50)
        lines = pool[a:a + rng.randint(1, 10)]
        copies[k] = lines
        rows.append((k, "\n".join(lines)))
    got = texts(delete_common_blocks(docs(rows).repartition(3)))
    for k, lines in copies.items():
        before = {tuple(x[a:b]) for j in range(k) for x in [copies[j]] for a, b in plain_runs(x)}
        gone = {n for a, b in plain_runs(lines) if tuple(lines[a:b]) in before for n in range(a, b)}
        assert got[k] == "\n".join(x for n, x in enumerate(lines) if n not in gone)


def test_copies_ties_and_other_columns(spark, docs):
    rows = [(1, f"{A}\n{B}", "en", "s", 7), (1, f"{A}\n{B}", "en", "s", 7), (2, f"{A}\n{B}", "de", "t", 8), (None, f"{A}\nz")]
    table = docs(rows).withColumnRenamed("n_chars", "owner").withColumnRenamed("source", "lines")
    got = sorted(delete_common_blocks(table).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [(r.doc_id, r.text, r.lines_deleted) for r in got] == [
        (None, f"{A}\nz", 0), (1, B, 1), (1, B, 1), (2, "", 2)]
    assert got[3].asDict().keys() == {"doc_id", "text", "lang", "lines", "owner", "lines_deleted"} and got[3].owner == 8


def test_long_text_and_empty_table(spark, docs):
    long = "\n".join(f"line number {k} of a long text" for k in range(5000))
    got = texts(delete_common_blocks(docs([(1, long), (2, long + "\nand one line more than it")])))
    assert got == {1: long, 2: "and one line more than it"}
    assert delete_common_blocks(docs([])).collect() == []
