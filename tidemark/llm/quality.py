"""Quality rules for documents and, from their failures, verdicts on hosts (native).

Document rules are counts over the whole text. Host rules take the share of a host's documents
that fail any rule, shrunk towards the shares of all hosts: a Beta prior is fitted to the
hosts' shares by moments, and a host is rejected if its posterior mean exceeds `max_rate`.

Main path: DataFrame functions only. Every count is taken inside a row, so no word is shuffled;
per-host counts are pre-aggregated by each task before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted

MIN_WORDS = 50
#: In hundredths: words in repeated three-word windows.
MAX_REPEATED = 50
#: A text with more symbols than this many per word is markup or noise.
MAX_SYMBOLS_PER_WORD = 1
#: The published bounds (Gopher's): symbols per word and duplicate lines per line in hundredths,
#: characters per word.
PUBLISHED_SYMBOLS = 10
PUBLISHED_DUP_LINES = 30
PUBLISHED_WORD_CHARS = (3, 10)
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR = (1.0, 1e6)
#: Host verdicts up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000

_WORD = r"[^\x20\x09-\x0D]+"
#: A window's place takes the low 31 bits beside the high bits of its hash: no text has 2^31 bytes.
_PLACE_BITS = 31
_PLACE = (1 << _PLACE_BITS) - 1


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to a frame with `__words`: sort windows by hash, keep equal neighbours,
    confirm them on whole hashes, and measure the union of their words."""
    n = F.size("__words")
    hashed = F.transform(F.slice("__words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))
    df = df.withColumn("__windows", hashed)
    df = df.withColumn("__ordered", F.sort_array(F.transform("__windows", lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")))))

    def near(x: Column, i: Column) -> Column:
        same = lambda j: F.shiftright(F.get("__ordered", j), _PLACE_BITS) == F.shiftright(x, _PLACE_BITS)
        return F.coalesce(same(i + 1), F.lit(False)) | (i > 0) & F.coalesce(same(F.greatest(i - 1, F.lit(0))), F.lit(False))

    df = df.withColumn("__places", F.transform(F.filter("__ordered", near), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")))
    # Equal high bits are not yet equal windows: order the few that are left by the whole hash.
    df = df.withColumn("__exact", F.array_sort(F.transform("__places", lambda p: F.struct(F.get("__windows", p).alias("h"), p.alias("p")))))
    pair = lambda x, j: F.coalesce(F.get("__exact", j)["h"] == x["h"], F.lit(False))
    df = df.withColumn("__starts", F.array_sort(F.transform(F.filter("__exact", lambda x, i: pair(x, i + 1) | (i > 0) & pair(x, F.greatest(i - 1, F.lit(0)))), lambda x: x["p"])))
    reach = F.transform("__starts", lambda p, i: F.least(F.coalesce(F.get("__starts", i + 1) - p, F.lit(3)), F.lit(3)).cast("long"))
    return df.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)).drop("__windows", "__ordered", "__places", "__exact", "__starts")


def text_counts(docs: DataFrame) -> DataFrame:
    """docs (a column text, any others) with the columns n_words, word_chars, n_symbols, n_lines
    (with a word), n_dup_lines and n_repeat_words (long) added.

    A null text counts as empty: all zero. Texts of any length are counted whole. Repeated rows get
    equal counts. An empty table gives an empty one. Columns of docs with the names of these
    counts are replaced.
    """
    df = docs.withColumn("__words", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(0)))
    df = df.withColumn("__lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    return _repeated(df).drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def noisy() -> Column:
    return F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")


def outside_published() -> Column:
    """More symbols per word or duplicate lines than the published bounds, or words too short or
    too long on average; whatever is noisy() is outside too."""
    low, high = PUBLISHED_WORD_CHARS
    length = (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words"))
    return (100 * F.col("n_symbols") > PUBLISHED_SYMBOLS * F.col("n_words")) | (100 * F.col("n_dup_lines") > PUBLISHED_DUP_LINES * F.col("n_lines")) | length


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host of a frame with columns host and failed: host, n, n_failed, rate (shrunk), rejected."""
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "hosts")
    # One row of three numbers.
    prior = hosts.agg(F.avg(F.col("n_failed") / F.col("n")).alias("m"), F.var_samp(F.col("n_failed") / F.col("n")).alias("v")).first()
    m, v = prior["m"] or 0.0, prior["v"] or 0.0
    strength = min(max(m * (1 - m) / v - 1, PRIOR[0]), PRIOR[1]) if v > 0 else PRIOR[1]
    rate = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def judge(docs: DataFrame, host: str, keep: list[str], max_rate: float = MAX_HOST_RATE, published: bool = False) -> DataFrame:
    """The columns `keep` of docs, the counts of text_counts(), base_failed, and kept.

    kept: the document fails neither a base rule (too few words, too repetitive) nor the symbol
    rule (with `published` the rules of outside_published()), and its host isn't rejected by the
    share of its documents that fail any of these. A null host has no verdict: its documents stand on their
    own. The judged rows are written once to the shared folder, so the counts are made once.
    """
    judged = text_counts(docs.select(*keep, *({"text", host} - set(keep))).withColumn("__host", F.col(host)))
    judged = judged.withColumn("base_failed", base_failed()).withColumn("__noisy", outside_published() if published else noisy())
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = materialize(judged.select(*[c for c in keep if c not in counts], *counts, "__host", "__noisy"), "judged")
    hosts = host_verdicts(judged.select(F.col("__host").alias("host"), (F.col("base_failed") | F.col("__noisy")).alias("failed")), max_rate)
    bad = hosts.where("rejected").select(F.col("host").alias("__bad"))
    if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    out = judged.join(bad, judged["__host"] == bad["__bad"], "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("__noisy") & F.col("__bad").isNull()).drop("__host", "__bad", "__noisy")


def keep_good(docs: DataFrame, host: str = "source", published: bool = False) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs.

    As judge(); columns of docs with the names of its counts are carried through untouched.
    """
    marked = docs.select(F.struct(*quoted(docs)).alias("__row"), F.col("text"), F.col(host).alias("__source"))
    kept = judge(marked, "__source", ["__row"], published=published).where("kept")
    return kept.select("__row.*")
