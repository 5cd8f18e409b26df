import hashlib

from pyspark.sql import functions as F

from tests.llm.conftest import DOCUMENTS, words
from tidemark.llm.lines import dedup_lines
from tidemark.llm.quality import host_verdicts, judge, keep_good, text_counts

ENDS = " \t\n\x0b\f\r"


def brute_lines(rows, size=2, least=10):
    first = {}
    cut = lambda t: [(p, x.strip(ENDS)) for p, x in enumerate((t or "").split("\n")) if x.strip(ENDS)]

    def windows(t):
        own = cut(t)
        for i in range(len(own) - size + 1):
            part = own[i : i + size]
            if sum(len(words(s)) for _, s in part) >= least:
                yield i, tuple(s for _, s in part), {p for p, _ in part}

    for i, t in rows:
        if i is not None:
            for n, key, _ in windows(t):
                first[key] = min(first.get(key, (i, n)), (i, n))
    out = []
    for i, t in rows:
        gone = set().union(*[p for n, key, p in windows(t) if i is not None and first[key] < (i, n)], set())
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone), len(cut(t)), len(gone)))
    return sorted(out, key=str)


def lines_result(df):
    return sorted(((r.doc_id, r.text, r["__n_lines"], r["__n_removed"]) for r in df.collect()), key=str)


def test_lines_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert lines_result(dedup_lines(documents)) == brute_lines(rows)
    assert lines_result(dedup_lines(documents, 3, 1)) == brute_lines(rows, 3, 1)


def test_lines_of_odd_rows(odd, none, clashing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = dedup_lines(odd)
    assert lines_result(out) == brute_lines(rows) and out.columns[:5] == odd.columns
    more = clashing(odd).withColumns({c: F.lit("x") for c in ("__marks", "__firsts", "__id", "a.b")})
    out = dedup_lines(more)
    assert lines_result(out) == brute_lines(rows) and out.where("__marks <> 'x' or __firsts <> 'x' or __id <> 'x' or `a.b` <> 'x' or marks <> 'x'").count() == 0
    assert out.columns == [*[c for c in more.columns if c != "__n_lines"], "__n_lines", "__n_removed"]
    assert dedup_lines(none).collect() == []


def test_runs_across_and_inside_documents(spark):
    a, b, c, d = (f"{x} " * 6 for x in "abcd")
    texts = [(1, f"{a}\n{b}\n{c}"), (2, f"x\n  {b}\n\n{c}\t\ny"), (3, f"{c}\n{b}"), (4, f"{d}\n{d}\n{d}\n{d}"), (5, f"{a}\n{c}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got == {1: texts[0][1], 2: "x\n\ny", 3: texts[2][1], 4: d, 5: texts[4][1]}


def counts(t):
    w = words(t)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {p + k for ps in windows.values() if len(ps) > 1 for p in ps for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_brute_force(documents, odd, none):
    for df in (documents, odd):
        want = sorted(((r.doc_id, *counts(r.text)) for r in df.collect()), key=str)
        got = text_counts(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert judge(odd.withColumn("words", F.lit("x")), "source", ["doc_id", "words"]).where("words = 'x'").count() == odd.count()
    assert text_counts(none).collect() == [] and keep_good(none).collect() == []


def test_native_plan(documents):
    plan = judge(documents, "source", ["doc_id"])._jdf.queryExecution().toString() + text_counts(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_hosts_are_judged_by_shrunk_rates(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, "en", f"h{i % 30}", 1) for i in range(3000)]
    rows += [(10_000 + i, good if i % 10 == 0 else bad, "en", "spam", 1) for i in range(300)]
    rows += [(20_000, bad, "en", "tiny", 1), (20_001, good, "en", "tiny", 1), (20_002, good, None, None, None), (20_003, None, None, None, None), (20_004, "### " * 60 + good, "en", "h1", 1)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    kept = {r.doc_id for r in keep_good(df).collect()}
    assert kept == {*range(3000), 20_001, 20_002}  # spam's good documents go with their host; tiny's rate is shrunk
    verdicts = {r.host: r for r in host_verdicts(judge(df, "source", ["doc_id", "source"]).select(F.col("source").alias("host"), F.col("base_failed").alias("failed"))).collect()}
    assert verdicts["spam"].rejected and 0 < verdicts["tiny"].rate <= 0.5 and None not in verdicts
    same = judge(df.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(0)), "source", ["doc_id", "n_words"])
    assert same.where("n_words = 60").count() > 0  # own counts replace a column of their name
    assert keep_good(df.withColumn("n_words", F.lit("mine"))).where("n_words = 'mine'").count() == len(kept)


def test_digest_of_kept_text(documents):
    for r in dedup_lines(documents).where("__n_removed = 0").limit(5).collect():
        own = documents.where(F.col("doc_id") == r.doc_id).first()
        assert hashlib.sha256(r.text.encode()).digest() == hashlib.sha256(own.text.encode()).digest()


def extended_pairs(rows, size=2, least=10):
    """Pairs of equal lines at two positions, each extended both ways while lines stay equal: a later
    run of enough lines goes where its windows have enough words."""
    own = {i: [(p, x.strip(ENDS)) for p, x in enumerate((t or "").split("\n")) if x.strip(ENDS)] for i, t in rows}
    at = {}
    for i, lines in own.items():
        for n, (_, s) in enumerate(lines):
            at.setdefault(s, []).append((i, n))
    gone = {i: set() for i in own}
    for places in at.values():
        for d, a in places:
            for e, b in places:
                if (d, a) >= (e, b):
                    continue
                lo = 0
                while a - lo > 0 and b - lo > 0 and own[d][a - lo - 1][1] == own[e][b - lo - 1][1]:
                    lo += 1
                hi = 1
                while a + hi < len(own[d]) and b + hi < len(own[e]) and own[d][a + hi][1] == own[e][b + hi][1]:
                    hi += 1
                run = own[e][b - lo : b + hi]
                for n in range(len(run) - size + 1):
                    if sum(len(words(s)) for _, s in run[n : n + size]) >= least:
                        gone[e] |= {p for p, _ in run[n : n + size]}
    return sorted(((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]), len(own[i]), len(gone[i])) for i, t in rows), key=str)


def test_windows_are_the_matches_extended_both_ways(spark):
    import random

    rng = random.Random(6)
    texts = [(i, "\n".join(rng.choice([f"{c} " * 6 for c in "abcde"] + ["short", "", "  "]) for _ in range(rng.randint(0, 14)))) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert lines_result(dedup_lines(df)) == extended_pairs(texts)
    assert lines_result(dedup_lines(df, 3, 1)) == extended_pairs(texts, 3, 1)
