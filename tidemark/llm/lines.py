"""Line dedup by winnowing: runs of lines that also occur earlier are deleted.

Lines are hashed without white space at their ends; lines without a word stand outside. Every
window of `min_lines` lines selects its smallest line hash as fingerprint, so a run that occurs
twice and is long enough is sure to share one. Positions are joined on fingerprints that recur,
and each match is extended both ways, to all windows around it, which meet by content: tasks
merge equal windows into the earliest place before they move, so that a line or a run that a
third of all documents share is no hot key. A document then deletes the union of its windows
that occur earlier.

With whole runs, a window is no fixed number of lines: from each line on, and up to each line, it is
the shortest run with `min_lines` lines and `min_words` words. A longer run that occurs twice is
the union of such windows (of a line inside, the words after it are too few only if the window up to
the run's end holds it), so whole maximal runs go, short lines within them included.

Texts are read once to be cut into lines, of which a digest and a count of words go on, and once
more, with the numbers of their lines that go, to be rewritten: no other step sees a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, files_for, free_name, materialize, small_batches
from .textscan import sliding

MIN_LINES = 2
#: Windows (or with whole runs, runs) with fewer words than this are too common to tell copies from chance.
MIN_WORDS = 10

_DIGEST = 16


class Lines:
    """The windows of one text, by the digests and the numbers of words of its lines with a word: ends
    (first line, line after the last), fingerprints, places in the order of the ends, contents."""

    def __init__(self, digests: bytes, words: np.ndarray, min_lines: int, min_words: int, runs: bool = False) -> None:
        self.digests = digests
        hashes = np.frombuffer(digests, "<i8")[::2]
        total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        if runs:
            self.first, self.end = self._shortest(total, min_lines, min_words)
            self.marks = np.array([hashes[x:y].min() for x, y in zip(self.first.tolist(), self.end.tolist(), strict=True)], np.int64)
        else:
            first = np.arange(max(0, len(words) - min_lines + 1))
            self.first = first[total[first + min_lines] - total[first] >= min_words]
            self.end = self.first + min_lines
            self.marks = sliding(np.minimum, hashes, min_lines)[self.first]
        # Every line has a word, so no window has more lines than this.
        self.places = self.first * (max(min_lines, min_words) + 1) + self.end - self.first

    @staticmethod
    def _shortest(total: np.ndarray, min_lines: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """The shortest windows from each line on and up to each line, in order, without repeats."""
        n = len(total) - 1
        at = np.arange(n)
        end = np.maximum(np.searchsorted(total, total[:-1] + min_words), at + min_lines)
        start = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, at + 1 - min_lines)
        ends = np.stack([np.concatenate([at[end <= n], start[start >= 0]]), np.concatenate([end[end <= n], at[start >= 0] + 1])], axis=1)
        ends = np.unique(ends, axis=0)
        return ends[:, 0], ends[:, 1]

    def content(self, window: int) -> bytes:
        a, b = _DIGEST * int(self.first[window]), _DIGEST * int(self.end[window])
        return hashlib.blake2b(self.digests[a:b], digest_size=16).digest()


_LINES = "doc_id long, version string, at binary, words binary, digests binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: the numbers of its lines with a word, their words, and their digests."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            data = data.as_py() or b""
            # Without an argument, bytes are stripped and split at ASCII white space.
            own = [(i, s) for i, x in enumerate(data.split(b"\n")) if (s := x.strip())]
            if not own:
                continue
            row = doc_id, hashlib.md5(data).hexdigest(), np.array([i for i, _ in own], "<i4").tobytes(), np.array([len(s.split()) for _, s in own], "<i4").tobytes(), b"".join([hashlib.blake2b(s, digest_size=_DIGEST).digest() for _, s in own])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "version", "at", "words", "digests"])


def _of(words: bytes, digests: bytes, rule: tuple) -> Lines:
    return Lines(digests, np.frombuffer(words, "<i4"), *rule)


def _marks(rule: tuple):
    """doc_id, words, digests -> (mark, doc_id, n): the fingerprints of each document and how many windows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, docs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc_id, words, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, n = np.unique(_of(words, digests, rule).marks, return_counts=True)
                marks.append(values)
                counts.append(n)
                docs.append(np.full(len(n), doc_id))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (marks, docs, counts)], names=["mark", "doc_id", "n"])

    return run


def _windows(rule: tuple):
    """doc_id, words, digests, marks -> (window, doc_id, place) of the windows with a recurring fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, places = [], [], []
            for doc_id, words, digests, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _of(words, digests, rule)
                at = np.flatnonzero(np.isin(own.marks, marks)).tolist()
                keys += [own.content(i) for i in at]
                docs += [doc_id] * len(at)
                places += own.places[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(places, pa.int64())], names=["window", "doc_id", "place"])

    return run


def _gone(rule: tuple):
    """doc_id, version, at, words, digests, marks, firsts -> (doc_id, version, gone): the numbers of the
    lines that go, of texts that lose any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, version, at, words, digests, marks, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _of(words, digests, rule)
                late = np.isin(own.marks, marks) & ~np.isin(own.places, firsts or [])
                edges = np.zeros(len(words) // 4 + 1, np.int64)
                np.add.at(edges, own.first[late], 1)
                np.add.at(edges, own.end[late], -1)
                lost = np.frombuffer(at, "<i4")[np.cumsum(edges)[:-1] > 0]
                if len(lost):
                    out.append((doc_id, version, lost.tobytes()))
            ids, versions, lines = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.string()), pa.array(lines, pa.binary())], names=["doc_id", "version", "gone"])

    return run


def _delete(text_at: int):
    """Rows whose last column is gone (null if nothing is), with their text rewritten, and n_lines and
    n_removed (lines with a word) in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            texts, totals, removed = [], [], []
            for data, gone in zip(columns[text_at].cast(pa.binary()), columns[-1], strict=True):
                data, gone = data.as_py(), gone.as_py()
                lines = (data or b"").split(b"\n")
                totals.append(sum(1 for x in lines if x.strip()))
                lost = set(np.frombuffer(gone, "<i4").tolist()) if gone else ()
                removed.append(len(lost))
                texts.append(b"\n".join([x for i, x in enumerate(lines) if i not in lost]) if lost else data)
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=[*batch.schema.names[:-1], "__n_lines", "__n_removed"])

    return run


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """The rows and columns of docs (with doc_id, text), text rewritten, and the columns
    __n_lines and __n_removed: lines with a word before, and how many of them are deleted
    (columns of these two names are replaced).

    A window is `min_lines` consecutive lines with a word, not counting lines without one, that
    have at least `min_words` words together. Lines of a window whose lines also start earlier
    (smaller doc_id, or the same document and an earlier line) are deleted, judged on the input;
    other lines stay as they are, joined by newlines.

    With `runs`, whole runs go: every run of at least `min_lines` lines that has at least `min_words`
    words in all and also starts earlier, however short the lines in it.

    Null texts stay null and have no lines. Rows with a null doc_id stay as they are and repeat
    nothing. Rows that share a doc_id are one document's versions: a place in one is a place in
    the others. Texts are read whole; an empty table gives an empty one; other columns of any
    name are carried through.
    """
    small_batches(docs.sparkSession, 500)
    docs = docs.drop("__n_lines", "__n_removed")
    files = files_for(docs.sparkSession, 10 * docs.count())
    rule = (min_lines, min_words, runs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    lines = materialize(texts.mapInArrow(_cut, _LINES), "lines")
    marks = materialize(lines.select("doc_id", "words", "digests").mapInArrow(_marks(rule), "mark long, doc_id long, n long"), "line-marks")
    recurring = materialize(marks.groupBy("mark").agg(F.sum("n").alias("n")).where("n > 1").select("mark"), "recurring", files)
    own = marks.select("mark", "doc_id").join(recurring, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks"))
    own = materialize(lines.join(own, "doc_id"), "marked-lines", passes=2)
    discard(lines, marks, recurring)
    windows = own.select("doc_id", "words", "digests", "marks").mapInArrow(_windows(rule), "window binary, doc_id long, place long")
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc_id", "place")).alias("at"))
    firsts = materialize(firsts.groupBy("at.doc_id").agg(F.collect_list("at.place").alias("firsts")), "firsts", files, 2)
    late = own.join(firsts, "doc_id", "left").select("doc_id", "version", "at", "words", "digests", "marks", "firsts")
    gone = late.mapInArrow(_gone(rule), "doc_id long, version string, gone binary").dropDuplicates(["doc_id", "version"])
    gone = materialize(gone, "gone", files, 2)
    discard(own, firsts)
    of_id, of_version, of_gone = (free_name(docs, n) for n in ("__id", "__version", "__gone"))
    notes = gone.select(F.col("doc_id").alias(of_id), F.col("version").alias(of_version), F.col("gone").alias(of_gone))
    same = (docs["doc_id"].cast("long") == notes[of_id]) & (F.md5(docs["text"]) == notes[of_version])
    # Always by shuffle: a broadcast that only small tables get would make the cost of large ones a surprise.
    out = docs.join(notes.hint("merge"), same, "left").drop(of_id, of_version)
    # Plain names on the way through Python, whatever the columns are called.
    plain = [f"c{i}" for i in range(len(docs.columns))]
    kinds = [f.dataType for f in docs.schema.fields]
    schema = T.StructType([T.StructField(n, k) for n, k in [*zip(plain, kinds, strict=True), ("__n_lines", T.LongType()), ("__n_removed", T.LongType())]])
    return out.toDF(*plain, "gone").mapInArrow(_delete(docs.columns.index("text")), schema).toDF(*docs.columns, "__n_lines", "__n_removed")
