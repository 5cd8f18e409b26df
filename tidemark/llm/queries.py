"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(table(spark, sf_dir, "documents"), "source", ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, t FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS s
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
c AS (SELECT d.r, doc_id, source, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
             length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols > n_words AS noisy FROM c),
h AS (SELECT source, count(*) AS n, sum((base_failed OR noisy)::INT)::BIGINT AS f FROM j WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(f / n) AS m, coalesce(var_samp(f / n), 0) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS st FROM m),
b AS (SELECT source FROM h, s WHERE (f + m * st) / (n + st) > 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT noisy AND (source IS NULL OR source NOT IN (SELECT source FROM b)) AS kept
FROM j
"""


@query
def op10_quality_rules_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10_quality_rules, by the published rules."""
    from .quality import judge

    out = judge(table(spark, sf_dir, "documents"), "source", ["doc_id"], published=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_OUTSIDE_SQL = "(100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words) AS noisy"
ORACLES["op10_quality_rules_whole"] = ORACLES["op10_quality_rules"].replace("n_symbols > n_words AS noisy", _OUTSIDE_SQL).replace("AS n_dup_lines, coalesce", "AS n_dup_lines, len(ls) AS n_lines, coalesce")


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op4_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM g),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM f, (SELECT unnest(range(0, 20)) AS k) WHERE rn > 1),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM x ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLES["op7_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m.b, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op6_line_dedup"] = r"""
WITH l AS (SELECT doc_id, p, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                        unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents)),
n AS (SELECT doc_id, p, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS w,
             row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE s <> ''),
g AS (SELECT doc_id, i, p, s || chr(10) || lead(s) OVER o AS win, w + lead(w) OVER o AS words, lead(p) OVER o AS q
      FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, p, q, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS rn FROM g WHERE words >= 10),
gone AS (SELECT doc_id, unnest([p, q]) AS p FROM f WHERE rn > 1),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM gone GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)
"""


@query
def op6_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op6_line_dedup, by whole runs, those of one line included."""
    from .lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=1, runs=True)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: All runs of 1 to 10 lines with ten words: a longer one is their union.
ORACLES["op6_line_dedup_whole"] = ORACLES["op6_line_dedup"][: ORACLES["op6_line_dedup"].index("g AS")] + r"""
a AS (SELECT doc_id, list(s ORDER BY i) AS ss, list(w ORDER BY i) AS ws, list(p ORDER BY i) AS ps, count(*) AS n FROM n GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(ss[i:i + k - 1], chr(10)) AS win, ps[i:i + k - 1] AS qs
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM a), (SELECT unnest(range(1, 11)) AS k) WHERE i + k - 1 <= n AND list_sum(ws[i:i + k - 1]) >= 10),
f AS (SELECT doc_id, qs, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS rn FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(qs) AS p FROM f WHERE rn > 1),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words as of op2 and op3: A-Z lower-cased, runs of letters, digits and non-ASCII.
_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op2_decontamination"] = f"""
WITH b AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + least(len(ws), 5) - 1], ' ') AS s
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS p FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
w AS (SELECT DISTINCT len(string_split(s, ' ')) AS k FROM i),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + k - 1], ' ') AS s
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, w)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_item
FROM g JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)
"""


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from .licenses import BASE_GRAM, COVER, NEAR, NOTICE_GRAM, template_rows

    values = ", ".join(f"('{g}', {t}, '{label}', {b}, {n}, {i})" for g, t, label, b, n, i in template_rows())
    return f"""
WITH t(gram, template, label, is_base, n_template, spot) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS ws FROM documents),
g AS (SELECT r, i - 1 AS place, k, array_to_string(ws[i:i + k - 1], ' ') AS gram
      FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT unnest([{BASE_GRAM}, {NOTICE_GRAM}]) AS k))),
v AS (SELECT r, template, label, is_base, n_template, spot, place, k, place - spot AS diagonal
      FROM g JOIN t USING (gram) WHERE k = CASE WHEN is_base THEN {BASE_GRAM} ELSE {NOTICE_GRAM} END),
b AS (SELECT r, label, diagonal FROM v WHERE is_base GROUP BY r, template, label, n_template, diagonal HAVING count(DISTINCT spot) = n_template - {BASE_GRAM - 1}),
x AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS new FROM v WHERE NOT is_base),
s AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal, place ROWS UNBOUNDED PRECEDING) AS span FROM x),
c AS (SELECT r, label, count(DISTINCT spot + j) / any_value(n_template) AS share FROM s, (SELECT unnest(range(0, {NOTICE_GRAM})) AS j) GROUP BY r, template, label, span),
l AS (SELECT r, label FROM b UNION SELECT r, label FROM c WHERE share >= {COVER}),
p AS (SELECT r, count(*) AS n, min(diagonal) AS lo, max(diagonal) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM b GROUP BY r),
q AS (SELECT r, string_agg(label, ',' ORDER BY label) AS ls FROM l GROUP BY r),
m AS (SELECT r, max(share) AS share FROM c GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(p.ls, '') AS base_labels, coalesce(q.ls, '') AS labels,
       round(CASE WHEN p.n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE, 6) AS score
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r) LEFT JOIN m USING (r)
"""


ORACLES["op3_license_scan"] = _license_sql()


def _spans(c: str):
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversations_of, format_preferences, with_truncated_answer

    pairs = with_truncated_answer(conversations_of(table(spark, sf_dir, "conversations")))
    return format_preferences(pairs).select("conv_id", "n_shared", "prompt", "chosen_text", "rejected_text", _spans("chosen_mask"), _spans("rejected_mask"))


ORACLES["op5_chat_formatting"] = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations),
a AS (SELECT *, max(CASE WHEN role = 'assistant' THEN i END) OVER (PARTITION BY conv_id) AS la FROM t),
b AS (SELECT *, CASE WHEN i = la THEN substr(text, 1, length(text) // 2) ELSE text END AS rtext FROM a),
c AS (SELECT *, coalesce(min(CASE WHEN text <> rtext THEN i END) OVER (PARTITION BY conv_id) - 1, count(*) OVER (PARTITION BY conv_id)) AS shared FROM b),
r AS (SELECT *, head || text || '<|end|>' || chr(10) AS x, head || rtext || '<|end|>' || chr(10) AS y FROM c),
o AS (SELECT *, sum(CASE WHEN i > shared THEN length(x) ELSE 0 END) OVER w - length(x) + length(head) AS xs,
             sum(CASE WHEN i > shared THEN length(y) ELSE 0 END) OVER w - length(y) + length(head) AS ys
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, any_value(shared)::BIGINT AS n_shared,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (i <= shared), '') AS prompt,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (i > shared), '') AS chosen_text,
       coalesce(string_agg(y, '' ORDER BY i) FILTER (i > shared), '') AS rejected_text,
       coalesce(string_agg(xs::BIGINT || ':' || (xs + length(text) + 7)::BIGINT, ',' ORDER BY i) FILTER (i > shared AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(ys::BIGINT || ':' || (ys + length(rtext) + 7)::BIGINT, ',' ORDER BY i) FILTER (i > shared AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id
"""


@query
def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as archive, against a replica as a faulty copier would leave it: it drops the
    fragments of addresses, and refuses pages that are cut off before their closing tag."""
    from .warc import audit, warc_record

    pages = table(spark, sf_dir, "pages")
    record = lambda url: warc_record(F.col("page_id"), url, F.col("html")).alias("record")
    primary = pages.select(F.col("page_id").alias("id"), record(F.col("url")))
    replica = pages.where(F.col("html").endswith("</html>")).select(F.col("page_id").alias("id"), record(F.regexp_replace("url", "#.*$", "")))
    return audit(primary, replica).withColumnRenamed("id", "page_id")


ORACLES["op8_merkle_audit"] = r"""
WITH r AS (SELECT page_id, url, html, strlen('WARC/1.0' || 'WARC-Type: resource' || 'WARC-Record-ID: <urn:id:' || page_id || '>' || 'WARC-Target-URI: ' || url
                  || 'Content-Type: text/html' || 'Content-Length: ' || strlen(html)) + 18 + strlen(html) AS n FROM pages),
o AS (SELECT page_id, page_id // 4096 AS file, n, (sum(n) OVER (PARTITION BY page_id // 4096 ORDER BY page_id) - n)::BIGINT AS off,
             NOT ends_with(html, '</html>') AS gone, contains(url, '#') AS rot FROM r)
SELECT page_id, file, off AS "offset", n AS length, CASE WHEN gone THEN 'missing' ELSE 'changed' END AS kind
FROM o WHERE gone OR rot
"""
