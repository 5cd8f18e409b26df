import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import words
from tests.llm.test_lines_quality import brute_lines, counts
from tests.llm.test_neardup import brute
from tests.llm.test_search_scan import brute_items


def brute_pipeline(rows, items):
    """(doc_id, text) that reach the packing; no host of the small table is bad enough to be rejected."""
    kept = []
    for i, t in rows:
        n, _, symbols, _, repeated = counts(t)
        if n >= 50 and 100 * repeated <= 50 * n and symbols <= n:
            kept.append((i, t))
    kept = [(i, t) for i, t, n, gone in brute_lines(kept) if not gone or gone < n]
    label = brute(kept, 80)
    kept = [(i, t) for i, t in kept if label[i] == i]
    bad = {d for d, *_ in brute_items(kept, items)}
    return [(i, t) for i, t in kept if i not in bad]


def test_stages_equal_brute_force(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute_pipeline([(r.doc_id, r.text) for r in documents.collect()], items)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in want}
    got = {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(int.from_bytes(r.ids[p : p + 4], "little") for p in range(0, len(r.ids), 4))
    assert got == ids and 0 < len(got) < documents.count()


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir, odd, none, clashing):
    more = clashing(odd).drop("__n_lines").withColumn("a.b", odd["lang"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd, none, more):
            out = stage(spark, df, sf_dir)
            assert out.dtypes == df.dtypes, name
            assert out.count() <= df.count()
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf_dir).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "decontamination", "packing"]


def test_n_chars_follow_the_text(spark, sf_dir, documents):
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, documents, sf_dir)
    assert all(r.n_chars == len(r.text) for r in out.collect()) and words("a b") == ["a", "b"]
