import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm.packing import END_ID, encoder, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda text: np.array([*tok.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")


def verify(rows, texts, reference, window):
    """Every id in exactly one piece, windows gapless, little padding."""
    want = sorted((i if i is not None else -1, reference(t).tobytes()) for i, t in texts)
    docs, open_ = [], {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
        key = r.doc_id if r.doc_id is not None else -1
        # Repeated ids: a piece goes on with any document of its id that has come so far.
        for d in open_.get((key, r.start, r.doc_tokens), []):
            open_[key, r.start, r.doc_tokens].remove(d)
            break
        else:
            assert r.start == 0
            d = [key, b"", r.doc_tokens]
            docs.append(d)
        d[1] += bytes(r.ids)
        open_.setdefault((key, r.start + r.length, r.doc_tokens), []).append(d)
    assert all(len(d[1]) == 4 * d[2] for d in docs)
    if len({i for i, _ in texts}) == len(texts):
        assert sorted((d[0], d[1]) for d in docs) == want
    assert sum(r.length for r in rows) == sum(len(x) // 4 for _, x in want)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    short = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    assert short <= 1


@pytest.mark.parametrize("window,open_windows,parts", [(2048, 16, 3), (64, 4, 5), (7, 2, 2)])
def test_round_trip(documents, reference, window, open_windows, parts):
    df = documents.repartition(parts)
    rows = pack_documents(df, PATH, window, open_windows, keep_ids=True).collect()
    verify(rows, [(r.doc_id, r.text) for r in documents.collect()], reference, window)


def test_many_partitions_merge_in_rounds(spark, monkeypatch, reference):
    from tidemark.llm import packing

    monkeypatch.setattr(packing, "MERGE_GROUP", 8)
    texts = [(i, "word " * (i % 37)) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(24)
    verify(pack_documents(df, PATH, 32, 4, keep_ids=True).collect(), texts, reference, 32)


def test_odd_rows(odd, none, reference, clashing):
    rows = pack_documents(clashing(odd), PATH, keep_ids=True).collect()
    verify(rows, [(r.doc_id, r.text) for r in odd.collect()], reference, 2048)
    assert pack_documents(none, PATH).collect() == []


def test_ids_equal_the_tokenizers_own(documents, reference):
    encode = encoder(PATH)
    texts = [r.text for r in documents.collect()] + ["<|endoftext|>", "a<|endoftext|> b <|endoftext", "  \n\n  x\t", "it's we'll 'S 12345 \U0001f600́ é", "", " ", "\x00\x01", "  　 a"]
    for t in texts:
        assert [*encode(t), END_ID] == reference(t).tolist(), t[:80]


def test_long_runs_are_packed_beside_normal_rows(spark, reference):
    texts = [(1, " " * 2_000_000), (2, "\n" * 1_000_000), (3, "plain words"), (4, "a" * 300_000), (5, "x\n\n" + "\t" * 100_000 + "y"), (6, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    verify(pack_documents(df, PATH, keep_ids=True).collect(), texts, reference, 2048)


def test_both_ways_give_the_same_ids(reference):
    import random

    rng, encode = random.Random(8), encoder(PATH)
    parts = [" ", "\n", "\t", "\xa0", "\u2003", "\x1c", "\x85", "a", "Z", "é", "'s", "'LL", "12", "٣", "!", "_", "\U0001f600", "\u0301", "的", "<|endoftext|>", "<|end", "\x00"]
    for _ in range(400):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 2, 3, 50, 255, 256, 257, 1023, 1024]) for _ in range(rng.randint(1, 12)))
        assert [*encode(text), END_ID] == reference(text).tolist()
