"""The corpus pipeline: from documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame. The driver writes it as Parquet and
reads it as the next stage's docs; run() does the same, in the shared folder. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, quoted, small_side, table
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.lines import dedup_lines
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule, or whose host is rejected, go.

    As quality.judge(): null texts fail (too few words), null hosts have no verdict; repeated
    rows are judged alike; an empty table stays empty.
    """
    return keep_good(docs)


def published_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As quality_rules(), by the published rules of quality.outside_published()."""
    return keep_good(docs, published=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that also occur earlier are deleted; n_chars follows the text.

    A document that loses every line it had is a copy of what is kept elsewhere, and goes; one
    that had none stays. As lines.dedup_lines() otherwise.
    """
    return _without_repeats(docs, dedup_lines(docs))


def whole_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As line_dedup(), by whole runs, those of one line included."""
    return _without_repeats(docs, dedup_lines(docs, min_lines=1, runs=True))


def _without_repeats(docs: DataFrame, out: DataFrame) -> DataFrame:
    out = out.where("__n_removed = 0 or __n_removed < __n_lines")
    out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*quoted(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8 or more) the smallest doc_id stays.

    As neardup.near_duplicates(); documents without words and with a null doc_id stay.
    """
    gone = materialize(near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(small_side(gone), "doc_id", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. As decontaminate.drop_contaminated()."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, in windows of 2048. As packing.pack_documents()."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages of run_whole().
WHOLE_STAGES = [("quality rules", published_rules), ("line dedup", whole_runs), *STAGES[2:]]

#: SQL can't tokenise; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, earlier = table(spark, sf_dir, "documents"), None
    for name, stage in stages[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if earlier is not None:
            discard(earlier)
        earlier = docs
    out = stages[-1][1](spark, docs, sf_dir)
    # Packing has written its pieces, and reads the documents no more.
    discard(docs)
    return out


def run_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As run(), by WHOLE_STAGES."""
    return run(spark, sf_dir, WHOLE_STAGES)
