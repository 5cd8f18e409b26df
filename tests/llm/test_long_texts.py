"""Very long texts and very frequent hits: whole results, and work in proportion."""

import time

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_search_scan import brute_base, brute_items
from tidemark.llm import decontaminate, textscan
from tidemark.llm.decontaminate import drop_contaminated, find_items
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.quality import text_counts
from tidemark.llm.textscan import Column
from tidemark.llm.warc import FILE, audit, leaves


def test_hits_of_a_text_are_scanned_in_proportion(spark):
    took = []
    for n in (2_000, 60_000, 120_000):
        text = "the mit license " * (n // 3)
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        r = scan_licenses(df).first()
        took.append(time.time() - began)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text) and r.score == 1
    assert took[2] < 2 * took[1] + 2


def test_spans_of_many_partial_hits(spark):
    half = "licensed under the gnu general practice of medicine "
    text = half * 5_000 + "licensed under the gnu general public license version 3 " + half * 5_000
    r = scan_licenses(spark.createDataFrame([(1, text), (2, half * 10_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].labels == "gpl,gpl-2.0,gpl-3.0" and r[0].score == 1 and r[1].labels == "" and 0 < r[1].score < 0.8


def test_counts_of_a_long_text(spark):
    text = " ".join(f"w{i % 400_000}" for i in range(500_000))
    r = text_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_repeat_words) == (500_000, 200_000)


def test_several_passes_over_the_documents(spark, sf_dir, documents, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_items([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    for blocks in (2, 3, 100):
        monkeypatch.setattr(decontaminate, "PASS_BLOCKS", blocks)
        assert sorted(map(tuple, find_items(documents, items).collect()), key=str) == want
    left = {r.doc_id for r in drop_contaminated(documents, items).collect()}
    assert left == {r.doc_id for r in documents.collect()} - {w[0] for w in want}


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_word_hashes_do_not_depend_on_blocks(monkeypatch, block):
    rng = np.random.default_rng(3)
    text = " ".join("w" * int(n) + str(n) for n in rng.integers(1, 40, 3000))
    whole = Column.of(pa.array(["x y", text, None, text[7:]])).words(0, 4).hashes()
    monkeypatch.setattr(textscan, "BLOCK", block)
    assert (Column.of(pa.array(["x y", text, None, text[7:]])).words(0, 4).hashes() == whole).all()


def test_places_of_very_large_ids(spark):
    top = (1 << 60) + 4095
    ids = [top, top + 1, top + 2, -1, -(1 << 60)]
    records = spark.createDataFrame([(i, f"r{i}") for i in ids], "id long, record string")
    assert {r.id: r.file for r in leaves(records).collect()} == {i: i // FILE for i in ids}
    got = audit(records, records.where(f"id <> {top + 1}"))
    assert [(r.id, r.kind) for r in got.collect()] == [(top + 1, "missing")]


def test_ranges_of_offsets_are_in_the_nodes(spark):
    from tidemark.llm.warc import nodes

    def root(*parts):
        rows = spark.createDataFrame([(i, 0, n, "same") for i, n in parts], "id long, file long, length long, hash string")
        return [r.hash for r in nodes(rows, 1).collect()]

    assert root((1, 5), (2, 7)) == root((1, 5), (2, 7)) != root((1, 7), (2, 5))


@pytest.mark.parametrize("piece", [1, 3, 1 << 13])
def test_pieces_make_the_text(monkeypatch, piece):
    monkeypatch.setattr(textscan, "PIECE", piece)
    w = Column.of(pa.array(["a bc", "", " d  é f g ", None])).words(0, 4)
    assert b"".join(w.pieces(np.arange(2, 6))) == w.text(2, 6) == "d é f g".encode() and list(w.pieces(np.arange(0))) == []
    assert b"".join(w.pieces(np.array([0, 3, 5]))) == "a é g".encode()


def test_one_long_row_has_the_shingles_it_has_among_others():
    from tidemark.llm.neardup import shingle_sets

    text = " ".join(f"w{i % 700}" for i in range(3000))
    row, alone = shingle_sets(Column.of(pa.array([text])).words(0, 1))
    rows, both = shingle_sets(Column.of(pa.array(["x y", text])).words(0, 2))
    assert (alone == both[rows == 1]).all() and (row == 0).all() and len(alone) == 700
    for few in ("", "one two"):
        r, s = shingle_sets(Column.of(pa.array([few])).words(0, 1))
        assert len(r) == len(s) == min(1, len(few))
