"""Token files against the tokenizers library itself, and what the files look like."""
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_tables import docs  # noqa: F401

from forumlens.llm.queries import vocabulary_path
from forumlens.llm.token_files import CHUNK_BYTES, TextEncoder, encoder, token_digest, tokens_of, write_token_files

TEXTS = [
    None, "", "   \n\t ", "Hello, world's best!", "ÀÉÎ straße ªº µm ² ¼ 12345", "don't we'll I'M you'Re",
    "İstanbul ΣΊΣΥΦΟΣ ŉ Ÿ ſ", "中文 text   and   wide", "é combining ́x", "<|endoftext|> a<|startoftext|>b",
    "tab\x1cfile\x1dsep\x85next", "emoji 😀 \U0001F468‍\U0001F469", "a" * 3000, "x\0y",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    enc, rng = encoder(vocabulary_path()), random.Random(5)
    pool = [c for t in TEXTS if t for c in t] + list("abcdefg .,'-_0189\n")
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == ids_of(library, text), repr(text)


def test_files_round_trip(spark, docs, library, tmp_path):
    rows = [(k, t) for k, t in zip((5, 3, None, 9, 1, 7, 2, 3, 11, 12, 13, 14, 15, 16), TEXTS)]
    files = write_token_files(docs(rows).withColumnRenamed("n_chars", "tokens"), str(tmp_path / "t"), vocabulary_path())
    got = {}
    for r in token_digest(files).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    start = 0
    for key in sorted(got, key=lambda k: (k is not None, k)):
        texts = [t for k, t in rows if k == key]
        want = sorted((zlib.crc32(np.array(ids_of(library, t) + [1], "<u4").tobytes()), len(ids_of(library, t)) + 1)
                      for t in texts)
        assert sorted((r.ids_crc32, r.n_tokens) for r in got[key]) == want
        for r in sorted(got[key], key=lambda r: r.start):
            assert r.start == start
            start += r.n_tokens
    some = {r.doc_id: list(r.tokens) for r in tokens_of(files, 9, 11).collect()}
    assert some == {k: ids_of(library, t) + [1] for k, t in rows if k in (9, 11)}


def test_file_format(spark, docs, tmp_path):
    write_token_files(docs([(k, f"some words of text {k} " * 40) for k in range(200)]), str(tmp_path / "t"), vocabulary_path())
    last = -1
    for path in sorted((tmp_path / "t").glob("part-*.parquet")):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            tokens = next(v for k, v in columns.items() if k.startswith("tokens"))
            assert any("DICTIONARY" in e for e in tokens.encodings)
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
            low, high = columns["doc_id"].statistics.min, columns["doc_id"].statistics.max
            assert last < low <= high
            last = high


def test_empty_table(spark, docs, tmp_path):
    files = write_token_files(docs([]), str(tmp_path / "t"), vocabulary_path())
    assert token_digest(files).collect() == []


def test_case_and_punctuation_make_no_new_pieces(library):
    enc = TextEncoder(vocabulary_path())
    words = ["alpha", "beta", "gamma's", "straße"]
    forms = [f(w) + end for w in words for f in (str.lower, str.upper, str.title) for end in ("", ".", ",", "!", ")", "?\"")]
    text = " \n".join(forms)
    assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == ids_of(library, text)
    assert not enc.words and len(enc.pieces) < len(forms) / 3  # the memo of a text holds pieces, not all forms of its words
    mixed = text + " 中文 <|endoftext|>"
    assert np.frombuffer(enc.encode(mixed.encode()), "<u4").tolist() == ids_of(library, mixed)


def test_many_texts_look_up_each_word_once(library):
    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

        def __missing__(self, word):
            self[word] = value = enc._word(word)
            return value

    enc = TextEncoder(vocabulary_path())
    enc.words = Counted()
    texts = [" ".join(["alpha", "Beta,", "gamma's", "STRASSE.", "2024", "(delta)"] * 50)] * 40
    ids, sizes = enc.encode_all([t.encode() for t in texts])
    assert Counted.asked < 20  # of 12,000 words
    assert ids.tolist() == ids_of(library, texts[0]) * 40 and set(sizes.tolist()) == {len(ids) // 40}


def test_many_texts_equal_library(library):
    enc, rng = TextEncoder(vocabulary_path()), random.Random(7)
    signs = ["ΑΣ.a", "!'s", "'S''re", "<|ENDOFTEXT|>", "x<|startoftext|>Y", "a≮b", "5́5", "\xa0", "\x7f", "。,a", "12a34"]
    pool = [c for t in [*TEXTS, *signs] if t for c in t] + list("abcdefg .,'-_0189\n'")
    texts = [*(t or "" for t in TEXTS), *signs, *("".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(3000))]
    for some in (texts, texts[:1], ["\xa0"], [" ", ""], []):
        ids, sizes = enc.encode_all([t.encode() for t in some])
        assert len(sizes) == len(some) and sizes.sum() == len(ids)
        for text, end, size in zip(some, sizes.cumsum(), sizes):
            assert ids[end - size:end].tolist() == ids_of(library, text), repr(text)
    for raw in (b"ab\xff cd", b"\xe4\xb8", b"x\xc3,y"):
        assert enc.encode_all([raw])[0].tobytes() == enc.encode(raw)


def test_rows_without_text_are_bounded_in_a_chunk():
    import pyarrow as pa

    from forumlens.operators.word_chunks import pieces

    batches = [pa.RecordBatch.from_arrays([pa.array([b"", b"ab", b""] * 10, pa.binary())], names=["__text"])] * 20
    sizes = [c.num_rows for c in pieces(batches, "__text", 64, 1000)]
    assert sum(sizes) == 600 and max(sizes) <= 15


def test_files_of_texts_longer_than_a_chunk(spark, docs, library, tmp_path):
    rows = [(k, "Some words, of text %d\n" % k * n) for k, n in enumerate([3, 100_000, 0, 40_000, 40_000, 60_000, 1])]
    assert len(rows[1][1]) > CHUNK_BYTES
    files = write_token_files(docs(rows).coalesce(1), str(tmp_path / "t"), vocabulary_path())
    start = 0
    for r, (key, text) in zip(token_digest(files).orderBy("doc_id").collect(), rows):
        line = ids_of(library, "Some words, of text %d\n" % key)
        ids = np.tile(np.array(line, "<u4"), text.count("\n"))
        assert (r.doc_id, r.start, r.n_tokens) == (key, start, len(ids) + 1)
        assert r.ids_crc32 == zlib.crc32(np.append(ids, 1).astype("<u4").tobytes())
        start += r.n_tokens
