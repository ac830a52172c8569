"""Each stage against plain Python on what its predecessor kept."""
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from caseloom.llm import quality_knn
from test_duplicates import lines_by_hand, near_by_hand
from test_rules_packing_shards_leaks import found_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf))
        out.append(docs.collect())
        if name != "pack":
            assert docs.columns == COLUMNS
    return out


def test_quality_keeps_good_rows(spark, sf, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = quality_knn.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    scores = {r.doc_id: r.score for r in quality_knn.scores(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
    kept = {r.doc_id for r in steps[1]}
    assert kept == {i for i, s in scores.items() if s >= 0.3}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.95 * len(good)


def test_lines_near_copies_and_leaks(spark, sf, steps):
    want, _ = lines_by_hand([(r.doc_id, r.text) for r in steps[1]], words=1)     # every line with a word
    old = {r.doc_id: r.text for r in steps[1]}
    want = {i: t for i, t in want.items() if t == old[i] or any(c.isalnum() for c in t)}
    assert {r.doc_id: r.text for r in steps[2]} == want
    assert all(r.n_chars == len(r.text) for r in steps[2])
    assert {r.doc_id for r in steps[3]} == {i for i, _, _, kept in near_by_hand([(r.doc_id, r.text) for r in steps[2]], 80) if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in steps[4]} == {r.doc_id for r in steps[3] if not found_by_hand(r.text, items)[1]}


def test_pieces_hold_every_id(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for p in steps[5]:
        pieces[p.doc_id].append(p)
        places[p.sequence_id].append((p.offset, p.length))
    assert set(pieces) == {r.doc_id for r in steps[4]}
    for r in steps[4]:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at:at + p.length]))
            at += p.length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_the_stages_in_turn(spark, sf, steps):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in corpus_pipeline.run(spark, sf).collect()) == sum(r.length for r in steps[5])
    assert corpus_pipeline.ORACLE_SQL is None and len({key(r) for r in steps[5]}) == len(steps[5])


def test_stages_on_empty_and_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, None, None, "a", 0), (1, "", None, "a", 0), (2, "x y z w v u", "en", "a", 11), (2, "x y z w v u", "en", "a", 11)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = corpus_pipeline.written(stage(spark, docs, sf))
        assert docs.count() == len(rows)
        assert corpus_pipeline.quality(spark, spark.createDataFrame(rows, schema), sf).count() == len(rows)
