"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, union-find grouping.

1. One pass over the texts gives each document its set's size, a digest of its word sequence and
   its signature's bands. A signature takes, for each shingle, a pseudo-random permutation of
   the signature's places; round j gives the shingle's j-th place a value in [j, j + 1), and each
   place keeps the least. A document leaves as soon as no later round can lower any place.
2. Exact copies (equal digests) are one node, numbered when the nodes are written; everything
   up to the components is about nodes. Nodes that share a doc_id are linked.
3. Nodes that share a band meet in a bucket. A bucket tests its members against one
   pivot, the member that shares most (a group of edited copies meets at the original), never
   all pairs. Links are confirmed on full sets, and each test keeps the symmetric difference.
4. Members that aren't linked with their pivot may still be linked with each other or with those
   that are. The differences decide that exactly: two members differ where exactly one of them
   differs from the pivot. This is done inside tasks over tiles of bounded size, which return a
   spanning forest of the links they find and never a list of pairs. No link of a bucket is
   lost; members that are linked with the pivot aren't compared with each other.
5. Components: every task unites its links by union-find into a forest; the forests are united by
   hooking and pointer jumping, which is union-find over a table.

With BANDS x ROWS places, a pair at similarity 0.8 meets in no bucket with probability
(1 - 0.8^5)^38 < 3e-7, at 0.85 < 3e-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, files_for, materialize, small_batches, small_side
from .textscan import Column, U, Words, chunks, grams, inside_rows, mix

SHINGLE = 5
BANDS, ROWS = 38, 5
PLACES = BANDS * ROWS
#: Members of a pivot in a tile; tiles meet in pairs.
TILE = 256
#: Links that a task unites at once.
FOREST = 1_000_000
#: Elements that more members share than this are counted as matrix columns.
DENSE = 16
#: Bytes of text handled at once, and shingles signed at once (each takes PLACES bytes).
CHUNK = 1 << 18
SIGNED = 1 << 17


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all rows' sets of k-word shingles, sorted and distinct; the whole
    sequence is the one shingle of a row with fewer words."""
    hashes = words.hashes()
    if len(words.first) == 2 and len(hashes) >= k:  # one long row
        shingle = np.unique(grams(hashes, k))
        return np.zeros(len(shingle), np.int64), shingle
    starts = inside_rows(words, k)
    rows = [np.searchsorted(words.first, starts, "right") - 1]
    found = [grams(hashes, k)[starts]]
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            rows.append(short)
            found.append(mix(grams(hashes, n)[words.first[short]] + U(n)))
    row, shingle = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return row[new], shingle[new]


def signatures(row: np.ndarray, shingle: np.ndarray, n_rows: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures, n_rows x places of uint64: the round in the high half, a fraction in the low."""
    out = np.full((n_rows, places), np.iinfo(np.uint64).max, U)
    for a in range(0, len(row), SIGNED):
        _sign(row[a : a + SIGNED], shingle[a : a + SIGNED], out)
    return out


def _sign(row: np.ndarray, shingle: np.ndarray, out: np.ndarray) -> None:
    """Lower the signatures of `out` by the shingles."""
    places = out.shape[1]
    flat = out.reshape(-1)
    order = np.broadcast_to(np.arange(places, dtype=np.uint8), (len(row), places)).copy()
    base, x, at = row.astype(np.int64) * places, shingle, np.arange(len(row))
    for j in range(places):
        z = mix(x + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        swap = j + (((z & U(0xFFFFFFFF)) * U(places - j)) >> U(32)).astype(np.int64)
        place = order[at, swap]
        order[at, swap] = order[:, j]
        np.minimum.at(flat, base + place, (U(j) << U(32)) | (z >> U(32)))
        # Rows with every place below j + 1 are done.
        todo = np.unique(base)
        open_rows = todo[out[todo // places].max(axis=1) >= U(j + 1) << U(32)]
        if len(open_rows) < len(todo):
            stay = np.isin(base, open_rows)
            base, x, order = base[stay], x[stay], order[stay]
            at = np.arange(len(base))
            if not len(base):
                break


_SCAN = "doc_id long, n_shingles long, digest binary, bands array<long>"
_SCANNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = Column.of(batch.column(1))
        for a, b in chunks(column, CHUNK):
            words = column.words(a, b, lower=True)
            row, shingle = shingle_sets(words)
            n = np.bincount(row, minlength=b - a)
            values = signatures(row, shingle, b - a)
            bands = np.zeros((b - a, BANDS), U)
            for i in range(ROWS):
                bands = mix(bands * U(0xD6E8FEB86659FD93) + values[:, i::ROWS] + np.arange(BANDS, dtype=U))
            bands = bands.view(np.int64)
            full = _digests(words)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(full, pa.binary()), pa.array([x if y else None for x, y in zip(bands, full, strict=True)], pa.list_(pa.int64()))], schema=_SCANNED)


def _digests(words: Words) -> list[bytes | None]:
    """Of each row's word sequence; None without words."""
    out: list[bytes | None] = []
    for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        digest = hashlib.sha256()
        for piece in words.pieces(np.arange(x, y)):
            digest.update(piece)
        out.append(digest.digest() if y > x else None)
    return out


_SETS = "doc_id long, digest binary, shingles binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = Column.of(batch.column(1))
        for a, b in chunks(column):
            words = column.words(a, b, lower=True)
            row, shingle = shingle_sets(words)
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(_digests(words), pa.binary()), pa.array([shingle[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "digest", "shingles"])


_TESTED = "pivot long, id long, n long, linked boolean, difference binary"


def _confirm(percent: int):
    """pivot, id, their sets -> linked or not, and the symmetric difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sizes, apart = [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                d = np.setxor1d(a, b, assume_unique=True)
                total = len(a) + len(b)
                linked.append(100 * (total - len(d)) >= percent * (total + len(d)))
                sizes.append(len(b))
                apart.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_()), pa.array(apart, pa.binary())], names=["pivot", "id", "n", "linked", "difference"])

    return run


def _common(differences: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    c = len(differences)
    out = np.zeros((c, c), np.float32)
    member = np.repeat(np.arange(c), [len(d) for d in differences])
    _, element, n = np.unique(np.concatenate(differences), return_inverse=True, return_counts=True)
    shared = n[element] > 1
    member, element = member[shared], element[shared]
    order = np.argsort(element, kind="stable")
    member, element = member[order], element[order]
    cuts = np.flatnonzero(np.append(True, element[1:] != element[:-1])) if len(element) else np.zeros(0, int)
    groups = np.split(member, cuts[1:])
    dense = [g for g in groups if len(g) > DENSE]
    for g in groups:
        if 1 < len(g) <= DENSE:
            out[np.ix_(g, g)] += 1
    for at in range(0, len(dense), 512):
        part = dense[at : at + 512]
        columns = np.zeros((c, len(part)), np.float32)
        for i, g in enumerate(part):
            columns[g, i] = 1
        out += columns @ columns.T
    return out


def _tile(percent: int):
    """Members of one pivot, of one part or of two -> edges (a, b) that join what is linked: within the
    part if there is one, else across the two (other tasks have the pairs within either)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, n, part = (pdf[c].to_numpy() for c in ("id", "n", "part"))
        differences = [np.frombuffer(x, U) for x in pdf["difference"]]
        e = np.array([len(d) for d in differences])
        apart = e[:, None] + e[None, :] - 2 * _common(differences).astype(np.int64)
        total = n[:, None] + n[None, :]
        near = 100 * (total - apart) >= percent * (total + apart)
        if part.min() != part.max():
            near &= part[:, None] != part[None, :]
        a, b = np.nonzero(np.triu(near, 1))
        return pd.DataFrame(unite(ids[a], ids[b]), columns=["a", "b"])

    return run


def unite(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A forest of the links (a[i], b[i]): rows (smallest id of the tree, id), by union-find."""
    ids, at = np.unique(np.concatenate([a, b]).astype(np.int64), return_inverse=True)
    parent = list(range(len(ids)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        else:
            parent[x] = y
    root = np.arange(len(ids))
    for x in range(len(ids)):  # parents are smaller, so theirs are known
        root[x] = root[parent[x]]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[root[moved]], ids[moved]], axis=1)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task, FOREST at a time -> forests of them."""
    held, n = [], 0

    def out(held: list) -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        links = np.concatenate([unite(a, b), np.stack([a, b], axis=1)[a == b]])
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        n += batch.num_rows
        if n >= FOREST:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(id, label) for each end of the links (a, b): label is the smallest id that it reaches.
    The links are written to `most` files at most."""
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forest, "a long, b long")
    ends = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = materialize(links.select(ends).select("e.a", "e.b"), "links", most)
    files = 1 + both.count() // 500_000  # rows of two numbers
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels", files)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("next"))
        stepped = materialize(lower.join(jump, "via").select("id", "old", F.least("via", "next").alias("label")), "labels", files)
        changed = stepped.where("label < old").limit(1).count()
        discard(labels)
        labels = stepped.select("id", "label")
        labels._tidemark_path = stepped._tidemark_path
        if not changed:
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (columns doc_id, text).

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a document's set
    are its distinct five-word shingles (the whole sequence if it has fewer words). Documents
    are linked if 100 * intersection >= percent * union; component_id is the smallest doc_id that
    is reached by links; kept is doc_id = component_id.

    A null or empty text has an empty set, n_shingles 0, and is linked with nothing. A row with
    a null doc_id is linked with nothing, has a null component_id, and is kept. Rows that share
    a doc_id are one document, linked by any of their texts. Texts are read whole; an empty
    table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialize(docs.mapInArrow(_scan, _SCAN), "scanned")
    n_docs = scanned.count()
    full = scanned.where("digest is not null and doc_id is not null")
    # A table of its own: nodes keep their numbers, and a frequent digest can be split where
    # documents look their node up. The bands are the digest's, whichever copy they come from.
    nodes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes", files_for(spark, n_docs))
    banded = nodes.select(F.col("node").alias("id"), F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(sizes, "bucket"), "members", files_for(spark, BANDS * n_docs))
    weights = members.groupBy("id").agg(F.sum("size").alias("weight"))
    weighted = members.join(weights, "id")

    # Few documents meet others: where their ids are few enough to travel, no text is shuffled.
    wanted = materialize(nodes.join(members.select("id").distinct(), F.col("node") == F.col("id")).select("id", F.col("rep").alias("doc_id"), "digest"), "wanted", files_for(spark, n_docs))
    travels = small_side(wanted, 500_000)
    texts = docs.join(travels.select("doc_id").distinct() if travels is wanted else F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, _SETS).join(travels, ["doc_id", "digest"]).select("id", "shingles")
    sets = materialize(sets, "sets", files_for(spark, n_docs, 20_000))
    if sets.count() > wanted.count():  # repeated rows
        once = materialize(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "sets", files_for(spark, n_docs, 20_000))
        discard(sets)
        sets = once

    pivots = weighted.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("p")).select("bucket", (-F.col("p.minus")).alias("pivot"))
    pairs = members.join(pivots, "bucket").where("id <> pivot").select("pivot", "id").distinct()
    # The member's set first: ids are spread evenly, and rows of a frequent pivot can be split.
    pairs = pairs.join(sets.withColumnRenamed("shingles", "y"), "id").join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("x")), "pivot")
    tested = materialize(pairs.select("pivot", "id", "x", "y").mapInArrow(_confirm(percent), _TESTED), "tested", files_for(spark, n_docs, 20_000))
    groups = tested.groupBy("pivot").agg(F.count("*").alias("size"), F.count(F.when(~F.col("linked"), 1)).alias("far")).where("size > 1 and far > 0")
    # Few pivots have such members: where they can travel, nothing is dealt by pivot.
    tiles = lambda n: F.ceil(n / F.lit(TILE)).cast("long")
    groups = groups.select("pivot", tiles(F.col("far")).alias("far"), tiles(F.col("size") - F.col("far")).alias("close"))
    # Parts: 0, 1.. of members that aren't linked with the pivot; -1, -2.. of those that are. Each
    # of the first meets itself and every other part; those of the second never meet each other.
    dealt = tested.join(small_side(groups), "pivot")
    spread = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1)))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    dealt = dealt.withColumn("part", F.when(F.col("linked"), -1 - spread(F.col("close"))).otherwise(spread(F.col("far"))))
    others = F.when(F.col("linked"), upto(F.col("far"))).otherwise(F.concat(upto(F.col("far")), F.transform(upto(F.col("close")), lambda x: -1 - x)))
    dealt = dealt.withColumn("other", F.explode(others)).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    # A table of its own: the next step is Python too, and would run beside this one in every task.
    inner = materialize(dealt.groupBy("pivot", "low", "high").applyInPandas(_tile(percent), "a long, b long"), "inner-links", files_for(spark, n_docs))
    # A doc_id with several texts links their nodes.
    homes = materialize(full.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").groupBy("doc_id", "node").count().select("doc_id", "node"), "homes", files_for(spark, n_docs))
    ends = homes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last"))
    own = homes.join(ends.where("a < last"), "doc_id").where("a < node").select("a", F.col("node").alias("b"))
    links = tested.where("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b")).union(inner).union(own)
    labels = components(links, files_for(spark, tested.count()))
    named = nodes.select("node", "rep").join(labels, F.col("node") == F.col("id"), "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "label").select(F.col("node").alias("a"), "component_id")
    named = materialize(ends.select("doc_id", "a").join(named, "a").select("doc_id", "component_id"), "components", files_for(spark, n_docs))
    discard(members, wanted, sets, tested, inner, labels, nodes, homes)
    out = scanned.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
