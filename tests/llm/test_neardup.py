import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm import neardup
from tidemark.llm.neardup import components, near_duplicates, signatures


def sets_of(text):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    """{doc_id: component_id} by all pairs; rows of an id are one document."""
    sets = {}
    for i, t in rows:
        if i is not None and sets_of(t):
            sets.setdefault(i, []).append(sets_of(t))
    label = {i: i for i, _ in rows if i is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in label}


def compare(df, percent=85):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, percent)
    got = near_duplicates(df, percent).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    for r in got:
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(sets_of(t)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)
    return want


def test_equals_brute_force(documents):
    want = compare(documents)
    assert len(set(want.values())) < len(want)


def test_odd_rows(odd, none, clashing):
    compare(clashing(odd))
    assert near_duplicates(none).collect() == []


@pytest.mark.parametrize("tile", [256, 8])
def test_edited_copies_of_one_text(spark, monkeypatch, tile):
    """Copies that are linked with the original, with each other only, in chains, or not at all."""
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(240)]

    def edit(text, n):
        out = list(text)
        for i in rng.sample(range(len(out)), n):
            out[i] = f"e{rng.randint(0, 10**9)}"
        return out

    texts = [edit(base, rng.choice([1, 2, 3, 4, 5, 6, 8])) for _ in range(60)] + [base]
    for _ in range(5):  # chains away from the original
        t = edit(base, 9)
        for _ in range(5):
            texts.append(t)
            t = edit(t, 3)
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for percent in (85, 80):
        assert 1 < len(set(compare(df, percent).values())) < len(texts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for shared, total in ((400, 500), (100, 500)):
        got = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, total, dtype=np.uint64)
            a, b = x[: (total + shared) // 2], x[(total - shared) // 2 :]
            s = signatures(np.repeat([0, 1], len(a)), np.concatenate([a, b]), 2)
            got.append((s[0] == s[1]).mean())
        assert abs(np.mean(got) - shared / total) < 0.02
    one = signatures(np.zeros(1, int), np.array([7], np.uint64), 1)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(neardup.PLACES))  # one element takes every place once


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    links = spark.createDataFrame([*chain, *star, (300, 301), (301, 300), (5, 5)], "a long, b long")
    got = {r.id: r.label for r in components(links).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {7} and got[301] == got[300] == 300 and got[5] == 5


def test_a_large_group_of_copies_is_one_row_each(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the very same text of many words in all").otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(8)])).alias("text"))
    got = near_duplicates(df)
    assert got.where("component_id = 0").count() == 1000 and got.where("kept").count() == 2001


@pytest.mark.parametrize("tile", [256, 8])
def test_texts_that_share_a_doc_id(spark, monkeypatch, tile):
    """Texts of one doc_id never stand for each other, and link their document's neighbours."""
    monkeypatch.setattr(neardup, "TILE", tile)
    p1, p2, x = (" ".join(f"{c}{i}" for i in range(60)) for c in "pqx")
    rows = [(1, p1), (1, p2), (2, f"{p1} {x}"), (3, f"{p2} {x}")]
    assert compare(spark.createDataFrame(rows, "doc_id long, text string")) == {1: 1, 2: 2, 3: 3}
    rows = [(4, p1), (5, p1), (5, p2), (6, p2 + " end"), (7, None), (7, p2), (8, p1), (8, p1), (None, p2)]
    assert compare(spark.createDataFrame(rows, "doc_id long, text string")) == {4: 4, 5: 4, 6: 4, 7: 4, 8: 4}
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(90):
        t = list(base)
        for i in rng.sample(range(len(t)), rng.choice([0, 1, 2, 3, 4, 30])):
            t[i] = f"e{rng.randint(0, 5)}"
        rows.append((rng.randint(0, 60), " ".join(t) if rng.random() > 0.05 else None))
    for percent in (85, 80):
        compare(spark.createDataFrame(rows, "doc_id long, text string"), percent)


def test_union_find():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    forest = neardup.unite(a, b)
    label = {int(i): int(i) for i in np.unique(np.concatenate([a, b]))}
    for _ in range(300):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            label[x] = label[y] = min(label[x], label[y])
    assert {**{i: i for i in label}, **{y: x for x, y in forest.tolist()}} == label
    assert len(neardup.unite(a[:0], b[:0])) == 0


def test_long_sets_are_signed_in_parts(monkeypatch):
    x = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64)
    row = np.sort(np.random.default_rng(3).integers(0, 4, 5000))
    whole = signatures(row, x, 4)
    monkeypatch.setattr(neardup, "SIGNED", 37)
    assert (signatures(row, x, 4) == whole).all()
