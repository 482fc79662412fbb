"""The pipeline's stages on the small tables: what each keeps, and its result."""
from collections import Counter

import numpy as np
import zlib
from conftest import SMALL
from test_decontaminate import plain as plain_windows
from test_mixing import words
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline as P
from forumlens.llm.common import documents
from forumlens.llm.queries import vocabulary_path
from forumlens.sources.tables import read_table


def test_stages_one_after_the_other(spark, tmp_path):
    docs = documents(spark, SMALL)
    kept, columns = [docs.collect()], docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 < len(P.STAGES):
            assert docs.columns == columns
        kept.append(docs.collect())
    start, known, deduplicated, clean, mixed, tokens = kept

    assert {r.doc_id for r in start} - {r.doc_id for r in known} == {
        r.doc_id for r in start if not any(c.isalpha() for c in r.text or "")}
    classes = plain_components([plain_fingerprint(r.text) for r in known])
    first = {}
    for r, c in zip(known, classes):
        first[c] = min(first.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in deduplicated) == sorted(first.values())
    items = [tuple(r) for r in read_table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    hits = {row[0] for row in plain_windows([(r.doc_id, r.text) for r in deduplicated], items) if row[2]}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in deduplicated if r.doc_id not in hits)
    assert hits
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3 and copies.keys() <= {r.doc_id for r in clean}
    size = sum(words(r.text) for r in clean)
    assert abs(sum(words(r.text) for r in mixed) - size) < 0.2 * size

    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(vocabulary_path()), 0
    text = {r.doc_id: r.text for r in mixed}
    assert len(tokens) == len(mixed)
    for r in sorted(tokens, key=lambda r: r.start):
        ids = np.array(library.encode(text[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_equals_its_stages(spark):
    first = sorted(map(tuple, P.run(spark, SMALL).collect()))
    assert first == sorted(map(tuple, P.run(spark, SMALL).collect())) and first
