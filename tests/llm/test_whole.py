"""The operators that do the whole job beside the queries whose SQL is fixed."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCUMENTS, words
from tests.llm.test_lines_quality import ENDS, lines_result
from tidemark.llm.html import main_text
from tidemark.llm.lines import dedup_lines
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.quality import host_verdicts, judge, keep_good


def equal_sql(spark, sf_dir, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(db.sql(ORACLES[name]).fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect())
    assert got == want and ORACLES[name] != ORACLES[name.removesuffix("_whole")]
    return got


def test_published_rules_equal_sql(spark, sf_dir):
    whole = equal_sql(spark, sf_dir, "op10_quality_rules_whole")
    base = {r.doc_id for r in QUERIES["op10_quality_rules"](spark, sf_dir).where("kept").collect()}
    assert {r[0] for r in whole if r[-1]} < base


def test_junk_between_separators_goes_and_counts_against_its_host(spark):
    good = " ".join(f"word{i}" for i in range(60))
    junk = " | ".join(f"cell{i}" for i in range(60))
    lines = "\n".join([good, *["the same line once more"] * 5, "another line"])
    texts = {1: good, 2: junk, 3: lines, 4: " ".join(f"{i % 10}" for i in range(60)) + " " + " ".join("ab" for _ in range(3)), 5: " ".join(f"averylongword{i}" for i in range(60))}
    rows = [(i, t, "en", f"h{i}", 1) for i, t in texts.items()]
    rows += [(100 + i, good, "en", f"g{i % 20}", 1) for i in range(400)]
    rows += [(1000 + i, junk if i % 10 else good, "en", "spam", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    kept = {r.doc_id for r in keep_good(df, published=True).collect()}
    assert kept == {1, *range(100, 500)}
    assert {2, 3, 1001} <= {r.doc_id for r in keep_good(df).collect()}
    judged = judge(df, "source", ["doc_id", "source"], published=True)
    assert host_verdicts(judged.select(F.col("source").alias("host"), (~F.col("kept")).alias("failed"))).where("host = 'spam' and rejected").count() == 1


def brute_runs(rows, size, least):
    """Every run of `size` lines or more with enough words, of any length up to 30 lines."""
    first, found = {}, []
    for i, t in rows:
        own = [(p, x.strip(ENDS)) for p, x in enumerate((t or "").split("\n")) if x.strip(ENDS)]
        n, runs = [len(words(x)) for _, x in own], []
        for a in range(len(own)):
            for b in range(a + size, min(len(own), a + 30) + 1):
                if sum(n[a:b]) >= least:
                    key = tuple(x for _, x in own[a:b])
                    runs.append((a, key, {p for p, _ in own[a:b]}))
                    if i is not None:
                        first[key] = min(first.get(key, (i, a)), (i, a))
        found.append((i, t, len(own), runs))
    out = []
    for i, t, n, runs in found:
        gone = set().union(*[p for a, key, p in runs if i is not None and first[key] < (i, a)])
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone), n, len(gone)))
    return sorted(out, key=str)


def test_runs_equal_brute_force(documents, odd, none):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert lines_result(dedup_lines(df, runs=True)) == brute_runs(rows, 2, 10)
        assert lines_result(dedup_lines(df, min_lines=1, runs=True)) == brute_runs(rows, 1, 10)
    assert dedup_lines(none, runs=True).collect() == []


def test_whole_runs_equal_sql(spark, sf_dir):
    equal_sql(spark, sf_dir, "op6_line_dedup_whole")


def test_short_lines_of_a_run_go(spark):
    verse = "roses are red\nviolets\nare blue\nso they say\nand you"
    long = "a line of more than ten words that is long enough alone here"
    mixed = f"{long}\nx\ny\nz\n{long} too"
    texts = [(1, f"top\n{verse}\nend"), (2, f"other\n{verse}\nlast"), (3, mixed), (4, f"new\n{mixed}\nold"), (5, "roses are red\nviolets"), (6, f"x\ny\nz\n{long}?")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df, runs=True).collect()}
    assert got == {**dict(texts), 2: "other\nlast", 4: "new\nold"}


def test_a_line_among_other_neighbours_goes(spark):
    line, short = " ".join(f"w{i}" for i in range(10)), " ".join(f"w{i}" for i in range(9))
    texts = [(1, f"a\n{line}\nb\n{short}"), (2, f"c\n  {line}\nd"), (3, f"e\n{short}\nf"), (4, line)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df, min_lines=1, runs=True).collect()}
    assert got == {**dict(texts), 2: "c\nd", 4: ""}


@pytest.mark.parametrize("page,text", [
    ("<html><head><meta charset=utf-8><title>T</title><body><article><p>kept</p></article></body></html>", "kept"),
    ("<head><title>T</title><script>'<p></head>'</script><style>p{}</style><article>kept</article>", "kept"),
    ("<head><title>T</title><link rel=x><div>kept</div>", "kept"),
    ("<head><title>T</title>words alone", "words alone"),
    ("<head>stray<title>T</title><noscript>n</noscript></head><body><p>kept</p>", "kept"),
    ("<HEAD><TITLE>T</TITLE></HEAD><BODY><P>kept", "kept"),
    ("<header>H</header><article>kept</article>", "kept"),
    ("<article>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</article>", "let x=1 be"),
    ("<article>see <object data=a.pdf><param name=n>the paper</object> here</article>", "see the paper here"),
    ("<article>a <svg><title/><style/><text>label</text></svg> b</article>", "a label b"),
    ("<article>a <svg><title>no</title><style>no</style><path d='M0'/></svg> b</article>", "a b"),
    ("<article>open <math><mi>y</mi> and more", "open y and more"),
])
def test_head_left_open_and_embedded_text(page, text):
    assert main_text(page) == text
