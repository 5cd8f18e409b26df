import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import LOWER
from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import drop_contaminated, find_items
from tidemark.llm.licenses import BASE, scan_licenses

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return PLAIN.findall((text or "").translate(LOWER))


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_items(docs, items, percent=80):
    out = []
    for item, text in items:
        w = plain(text)
        own = shingles(w, min(5, len(w))) if w else set()
        for doc, t in docs:
            shared = len(own & shingles(plain(t), min(5, len(w)))) if own else 0
            if own and 100 * shared >= percent * len(own):
                out.append((doc, item, shared, len(own)))
    return sorted(out, key=str)


def test_items_equal_brute_force(spark, sf_dir, documents, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_items([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and sorted(map(tuple, find_items(documents, items).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)  # several blocks
    assert sorted(map(tuple, find_items(documents, items).collect()), key=str) == want
    left = {r.doc_id for r in drop_contaminated(documents, items).collect()}
    assert left == {r.doc_id for r in documents.collect()} - {w[0] for w in want}


def test_edited_and_short_items(spark, odd, none, clashing):
    rng = random.Random(2)
    items, docs = [], []
    for i in range(40):
        w = [f"t{rng.randint(0, 500)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 20, 33, 60]))]
        items.append((i, " ".join(w)))
        edited = list(w)
        for p in rng.sample(range(len(w)), min(len(w), rng.choice([0, 0, 1, 2, 4]))):
            edited[p] = "changed"
        docs.append((i, " ".join(["pad"] * rng.randint(0, 300)) + " " + "! ".join(edited).upper() + ", tail " * 20))
    items += [(98, None), (99, "..."), (None, "one two three four five"), (5, items[5][1])]
    docs += [(r.doc_id, r.text) for r in odd.collect()]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, find_items(clashing(a), clashing(b)).collect()), key=str) == brute_items(docs, items)
    for x, y in ((none, b), (a, b.limit(0))):
        assert find_items(x, y).collect() == []
    assert drop_contaminated(a, b.limit(0)).count() == len(docs)


def brute_base(text):
    w = plain(text)
    spots = [(p, label) for phrase, label in BASE.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
    return len(w), len(spots), min((p for p, _ in spots), default=None), max((p for p, _ in spots), default=None), ",".join(sorted({x for _, x in spots}))


def test_base_equals_brute_force(spark, documents, odd, none, clashing):
    extra = ["MIT License", "the mit  licenses mit-license; CC BY cc by", "GNU General\nPublic License apache license", "gnu general gnu general public license", "cc by", "mit license " * 50]
    rows = [(r.doc_id, r.text) for df in (documents, odd) for r in df.collect()] + [(1000 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = scan_licenses(clashing(df)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *brute_base(t)) for i, t in rows), key=str)
    for r in got:
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.base_labels) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert scan_licenses(none).collect() == []
    plan = scan_licenses(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_edited_notices_are_found_by_merged_diagonals(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    edited = notice.replace("free of charge", "wholly free of any charge").replace("to deal", "then to deal")
    rows = [(1, "x " * 30 + notice), (2, edited), (3, "free of charge to any person obtaining a copy"), (4, "permission granted " * 30)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["mit", "mit", "", ""] and got[1].score == 1.0 > got[2].score > 0.8 > got[3].score > 0 == got[4].score


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "cc by"), (None, None)], "doc_id long, text string")
    got = scan_licenses(df)
    assert got.count() == 4 and got.agg(F.sum("n_base")).first()[0] == 3
