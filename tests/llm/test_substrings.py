import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import words
from tidemark.llm.substrings import earliest, remove_repeats
from tidemark.llm.textscan import WHITE, Column, grams, inside_rows, sliding

import pyarrow as pa


def brute(rows, window):
    """rows of (doc_id, text) -> (n_words, n_removed, digest) of each, in order."""
    first, texts = {}, {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, set()).add(t)
    for i in sorted(texts):
        for t in texts[i]:
            w = words(t)
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < (i, p):
                    gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_equals_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(remove_repeats(documents)) == brute(rows, 20)


@pytest.mark.parametrize("hot", [1, 2_000])
def test_small_vocabulary_with_hot_and_cold_fingerprints(spark, hot):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice("abcde") for _ in range(40)) + " s h a r e d p a s s a g e o f w o r d s " + " ".join(rng.choice("abcde") for _ in range(9))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window, gram in ((6, 3), (8, 8), (5, 2)):
        assert result(remove_repeats(df, window=window, gram=gram, hot_places=hot, shard_bytes=2000)) == brute(rows, window)


def test_odd_rows(odd, none, clashing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = remove_repeats(clashing(odd))
    assert result(out) == brute(rows, 20)
    texts = {r.kept_sha256: r.kept_text for r in out.collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == k for k, t in texts.items())
    assert result(remove_repeats(none)) == []


def test_partitioning_changes_nothing(documents):
    assert result(remove_repeats(documents.repartition(7))) == result(remove_repeats(documents.coalesce(1)))


def test_earliest_in_a_shard():
    docs, starts = earliest(3, np.array([5, 2, 2]), np.array([0, 7, 0]), ["a b c d", "b c d e", "x a b c"])
    assert sorted(zip(docs.tolist(), starts.tolist(), strict=True)) == [(2, 0), (2, 1), (2, 7), (2, 8)]


def test_scanning_equals_python():
    texts = ["", "a  b", None, "été \U0001f600\tx y", " lead and trail "]
    column = Column.of(pa.array(["skip this", *texts]).slice(1))
    w = column.words(0, 5, WHITE)
    for r, t in enumerate(texts):
        assert [w.data[s:e].tobytes().decode() for s, e in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]], strict=True)] == words(t)
    same = Column.of(pa.array(["b été lead"])).words(0, 1).hashes()
    flat = dict(zip([w.data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)], w.hashes(), strict=True))
    assert [flat[b"b"], flat["été".encode()], flat[b"lead"]] == same.tolist()
    assert len(grams(same, 4)) == 0 and len(inside_rows(w, 3)) == 2
    x = np.random.default_rng(0).integers(0, 99, 50)
    for n in range(1, 20):
        assert (sliding(np.minimum, x, n) == [x[i : i + n].min() for i in range(50 - n + 1)]).all()


def _first_places(window, docs, starts, segments):
    first = {}
    for doc, start, text in zip(docs, starts, segments, strict=True):
        w = text.split(" ")
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, (doc, start + p)), (doc, start + p))
    return sorted(first.values())


def _shard(seed):
    rng = random.Random(seed)
    segments = [" ".join(rng.choice("abc") for _ in range(rng.randint(4, 12))) for _ in range(30)]
    return [rng.randint(0, 9) for _ in segments], [100 * i for i in range(30)], segments


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_hits_of_the_automaton_decide(monkeypatch, bits):
    """Whatever the hashes confirm, words decide: few bits put many windows under a phrase's hash."""
    from tidemark.llm import substrings

    exact = substrings._window_hashes
    monkeypatch.setattr(substrings, "_window_hashes", lambda ids, window: exact(ids, window) & np.uint64((1 << bits) - 1))
    for seed in range(20):
        docs, starts, segments = _shard(seed)
        a, b = earliest(4, np.array(docs), np.array(starts), segments)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == _first_places(4, docs, starts, segments)


def test_nothing_recurring_is_found_without_the_automaton(monkeypatch):
    import ahocorasick

    class Deaf:
        def __init__(self, *args):
            pass

        def add_word(self, *args):
            pass

        def make_automaton(self):
            pass

        def iter(self, text):
            return [(len(text) - 1, 0)] if text else []

    docs, starts, segments = _shard(1)
    monkeypatch.setattr(ahocorasick, "Automaton", Deaf)
    a, b = earliest(4, np.array(docs), np.array(starts), segments)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) != _first_places(4, docs, starts, segments)
