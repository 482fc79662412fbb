"""Token-ID files: Parquet list columns in ascending key order.

``write_token_files`` encodes every text and writes one row per document:

    <key>, part, part_start, n_tokens, tokens array<int>

* rows are range-partitioned and sorted by key, so files and rows ascend;
* ``tokens`` is dictionary-encoded (ids repeat), the integer columns beside it are
  delta-encoded, pages are small and carry min/max indexes, so a reader that wants
  a few documents or only the metadata touches only their pages;
* ``part`` is the number of the file and ``part_start`` the number of ids before the
  document in it; ``token_offsets`` adds the sizes of the earlier files.

Cases: NULL and empty texts hold only the end id; rows with equal or NULL keys are
all kept (NULL first, equal keys ordered by text); other columns of the input are
ignored unless listed in ``keep``; an empty input writes an empty, readable table.
"""
from __future__ import annotations

import re
import sys
import zlib
from array import array
from codecs import charmap_decode
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.word_chunks import pieces
from .common import prepared, text_bytes

RESERVED = ("part", "part_start", "n_tokens", "tokens")
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
MEMO_WORDS = 300_000
CHUNK_BYTES = 2 << 20  # of texts encoded at once; the arrays over a chunk take some 25 times as much
ROW_BYTES = 64  # what a row counts in a chunk besides its text, so that rows without text are bounded too

# Fixed values of the vocabulary file's format: its pre-tokenizer pattern for lower-case
# text within U+0000..U+017F, and the byte alphabet of byte-level BPE.
LETTERS = "a-zªµºß-öø-ſ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = " \t\n\v\f\r\x85\xa0"
PIECES = re.compile(
    f"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACES}{LETTERS}{NUMBERS}]+")
SIMPLE = re.compile("[\0-įı-ſ]*")


# Kinds of bytes by bits: two neighbours without a common bit never stand in one piece, nor do two
# digits. Apostrophes (they begin contractions) and bytes beyond ASCII share a bit with every kind, so a
# word is not cut beside them.
BLANKS = b" \t\n\v\f\r"
LETTER, DIGIT, SIGN, ANY = 1, 2 | 8, 4, 1 | 2 | 4
KINDS = bytes(0 if b in BLANKS else ANY if b > 127 or b == 39 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit()
              else SIGN for b in range(256))
WORDS = bytes(0 if b in BLANKS else ANY for b in range(256))
LOWER = bytes(range(256)).lower()


def _byte_alphabet() -> str:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


class Memo(dict):
    """word -> value; two generations bound it to twice ``MEMO_WORDS`` entries."""

    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


class TextEncoder:
    """The library's ids of a text as little-endian 32-bit bytes.

    The vocabulary drops white space, and no piece spans it, so a text's ids are
    those of its lower-case pieces in a row, which come from a memo or, if new, from
    the library's BPE model. A text with characters outside U+017F or a special
    token is taken by its blank-separated words, also from a memo; those of its words
    that hold such characters go through the library's full pipeline.

    ``encode_all`` takes many texts at once: Arrow numbers the words of all of them, cut
    further where only ASCII shows the end of a piece, so that each different one is
    looked up once, and its ids are copied to wherever it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.words, self.pieces = Memo(self._word), Memo(self._piece)

    @staticmethod
    def _pack(ids) -> bytes:
        ids = array("i", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _piece(self, piece: str) -> bytes:
        # Visible ASCII characters stand for themselves in the byte alphabet.
        shown = piece if piece.isascii() and piece.isprintable() else charmap_decode(piece.encode(), "strict", self.alphabet)[0]
        return self._pack([t.id for t in self.model.tokenize(shown)])

    def _simple(self, text: str, ids_of) -> bytes | None:
        if "<|" in text or not (text.isascii() or SIMPLE.fullmatch(text)):
            return None
        return b"".join(map(ids_of, PIECES.findall(text.lower())))

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isalpha() and (text.isascii() or SIMPLE.fullmatch(text)):  # one piece
            return self._piece(text.lower())
        found = self._simple(text, self._piece)
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids) if found is None else found

    def encode(self, text: bytes) -> bytes:
        found = self._simple(text.decode("utf-8", "replace"), self.pieces.__getitem__)
        return b"".join(map(self.words.__getitem__, text.split())) if found is None else found

    def encode_all(self, texts: list[bytes]):
        """The ids of all texts in a row, and how many each text has."""
        import numpy as np
        import pyarrow as pa

        # Special tokens are told from their case and hold signs: their texts are cut at blanks only.
        whole = [b"<|" in t for t in texts]
        kind = np.frombuffer(b"".join(t.translate(WORDS if w else KINDS) for t, w in zip(texts, whole)), np.uint8)
        shown = b"".join(t.translate(None if w else LOWER, BLANKS) for t, w in zip(texts, whole))
        if not shown:
            return np.empty(0, "<i4"), np.zeros(len(texts), np.int64)
        bounds = np.cumsum([0, *map(len, texts)])
        both, inside = kind[1:] & kind[:-1], kind != 0
        cut = np.ones(len(kind) + 1, dtype=bool)
        cut[1:-1] = (both == 0) | (both == DIGIT)
        cut[bounds] = True
        starts = np.flatnonzero(cut[:-1] & inside)
        ends = np.flatnonzero(cut[1:] & inside) + 1
        offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(shown)]).dictionary_encode()
        found = list(map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        _, places, data = ids.buffers()
        places = np.frombuffer(places, np.int64, len(ids) + 1) // 4
        return (np.frombuffer(data, "<i4", places[-1]),
                np.diff(places[np.searchsorted(starts, bounds)]))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TextEncoder(path)


def _encode_rows(path: str, end_id: int, kept: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for chunk in pieces(batches, "__text", ROW_BYTES, CHUNK_BYTES):
            ids, sizes = enc.encode_all(chunk["__text"].to_pylist())
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            tokens = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(chunk[c].chunk(0) for c in kept),
                 pa.array(np.full(len(sizes), part), pa.int32()),
                 pa.array(before + ends - sizes, pa.int64()),
                 pa.array(sizes, pa.int64()), tokens], names=[*kept, *RESERVED])
            before += int(sizes.sum())
    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id",
                      text: str = "text", keep: tuple[str, ...] = (), end_id: int = 1,
                      row_group_bytes: int = ROW_GROUP_BYTES,
                      page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Encode ``text`` with the vocabulary file and write it to ``path``; returns the table read back."""
    spark = prepared(docs.sparkSession)
    kept = [key, *(c for c in keep if c not in RESERVED and c != key)]
    rows = docs.select(*kept, text_bytes(text).alias("__text"))
    order = [key, F.xxhash64("__text")]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("part", T.IntegerType()),
                           T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    encoded = (rows.repartitionByRange(*order).sortWithinPartitions(*order, "__text")
               .mapInArrow(_encode_rows(vocabulary, end_id, kept), schema))
    (encoded.write
     .option("compression", "zstd")
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#tokens.list.element", "true")
     .option("parquet.block.size", str(row_group_bytes))
     .option("parquet.page.size", str(page_bytes))
     .parquet(path))
    return read_token_files(spark, path, schema)


def read_token_files(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def token_offsets(files: DataFrame) -> DataFrame:
    """part, part_base: ids in all earlier files. One row per file; reads no tokens."""
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("part_base"))


def _checksums(kept: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("tokens")
            ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
            bounds = lists.offsets.to_pylist()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])
    return run


def token_digest(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32."""
    kept = [key, "part", "part_start", "n_tokens"]
    schema = T.StructType([*(files.schema[c] for c in kept), T.StructField("ids_crc32", T.LongType())])
    sums = files.select(*kept, "tokens").mapInArrow(_checksums(kept), schema)
    return (sums.join(token_offsets(files), "part")
            .select(key, (F.col("part_base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"))


def tokens_of(files: DataFrame, low, high, key: str = "doc_id") -> DataFrame:
    """Documents of a key range; page indexes let the scan skip the other pages."""
    return files.where(F.col(key).between(low, high)).select(key, "n_tokens", "tokens")
