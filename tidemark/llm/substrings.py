"""Repeated-phrase removal: every window of words that also starts earlier loses its words.

1. Fingerprints. Each window of `window` words is stood for by its smallest k-gram hash
   (a minimizer: equal windows have equal ones). Tasks count the places they select; a
   fingerprint selected at one place only stands for no repeated window.
2. Marks. Documents are joined with the recurring fingerprints, and get those they contain.
3. Segments. Runs of marked windows with one fingerprint are cut out as texts. Equal segments
   are merged, before the shuffle and after, into the earliest place. A fingerprint selected
   at very many places is split: each of its windows is a segment of its own, dealt by its
   content, so copies meet before the shuffle and contexts spread over all shards.
4. Automata. Each shard holds the segments of a bounded number of fingerprints. It confirms which
   windows recur in it by hashes, compiles an Aho-Corasick automaton of these phrases over word
   ids, and streams all its segments through, which locates every occurrence word by word, and so
   the earliest. A document's other words can hold no window of the shard, so they don't pass.
5. Removal. A document keeps those of its marked windows that are earliest places, and loses
   the words that any other marked window covers.

Only places of earliest occurrences travel back, one for each different window, so a passage
that a third of all documents share is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, files_for, materialize, small_batches
from .textscan import Column, U, Words, chunks, grams, inside_rows, mix, sliding

WINDOW = 20
GRAM = 8
#: A fingerprint selected at more places than this is dealt by window.
HOT_PLACES = 2_000
#: Bytes of segments in a shard, on average.
SHARD_BYTES = 2 << 20


class Minimizers:
    """The windows of a run of rows and their fingerprints."""

    def __init__(self, words: Words, window: int, gram: int) -> None:
        hashes = words.hashes()
        self.words, self.window, self.span = words, window, window - gram + 1
        self.grams = grams(hashes, gram)
        self.starts = inside_rows(words, window)  # word indexes at which windows start
        self.marks = sliding(np.minimum, self.grams, self.span)[self.starts]
        self.content = grams(hashes, window)[self.starts]
        self.rows = np.searchsorted(words.first, self.starts, "right") - 1

    def selected(self) -> np.ndarray:
        """Indexes of the grams that are some window's smallest (all of them at ties)."""
        if not len(self.starts):
            return self.starts
        floor = np.zeros(len(self.grams) + self.span - 1, U)
        floor[self.starts + self.span - 1] = self.marks
        return np.flatnonzero((sliding(np.maximum, floor, self.span) == self.grams) & (self.grams > 0))


def _fingerprints(window: int, gram: int, by_document: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = Column.of(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(column):
                m = Minimizers(column.words(a, b), window, gram)
                if not by_document:
                    marks, n = np.unique(m.grams[m.selected()], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(n)], names=["mark", "n"])
                    continue
                # Neighbouring windows mostly share a fingerprint: one row for such a run.
                run = np.flatnonzero(np.append(True, (m.marks[1:] != m.marks[:-1]) | (m.rows[1:] != m.rows[:-1]))[: len(m.rows)])
                pairs = pd.DataFrame({"doc_id": ids[a:b][m.rows[run]], "mark": m.marks[run].view(np.int64)}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(pairs, schema=pa.schema([("doc_id", pa.int64()), ("mark", pa.int64())]), preserve_index=False)

    return run


def _marked(m: Minimizers, marks: list[np.ndarray]) -> np.ndarray:
    """For each window, whether its fingerprint is among the marks of its row."""
    found = np.zeros(len(m.starts), bool)
    cuts = np.searchsorted(m.rows, np.arange(len(marks) + 1))
    for r, own in enumerate(marks):
        if len(own) and cuts[r] < cuts[r + 1]:
            found[cuts[r] : cuts[r + 1]] = np.isin(m.marks[cuts[r] : cuts[r + 1]], own)
    return found


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of longs; a null is an empty list."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False).view(U) if len(column.values) else np.zeros(0, U), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


_SEGMENTS = "shard long, doc_id long, start long, segment string"


def _segments(window: int, gram: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = Column.of(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            marks, hot = _lists(batch.column(2)), _lists(batch.column(3))
            for a, b in chunks(column):
                m = Minimizers(column.words(a, b), window, gram)
                of = np.flatnonzero(_marked(m, marks[a:b]))
                if not len(of):
                    continue
                single = _marked(m, hot[a:b])[of]
                # A new segment where the fingerprint or the row changes, or a window is left out.
                new = np.ones(len(of), bool)
                new[1:] = (np.diff(of) != 1) | (m.marks[of][1:] != m.marks[of][:-1]) | (m.rows[of][1:] != m.rows[of][:-1]) | single[1:] | single[:-1]
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(of)) - 1
                key = np.where(single[begin], m.content[of[begin]], m.marks[of[begin]])
                first, last, rows = m.starts[of[begin]], m.starts[of[end]] + window, m.rows[of[begin]]
                texts = [m.words.text(x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array((key % U(shards)).astype(np.int64)), pa.array(ids[a:b][rows].astype(np.int64)), pa.array(first - m.words.first[rows]), pa.array(texts, pa.binary()).cast(pa.string())], names=["shard", "doc_id", "start", "segment"])

    return run


def earliest(window: int, doc_ids: np.ndarray, starts: np.ndarray, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, start) of the earliest occurrence of each different window of the segments."""
    import ahocorasick

    order = np.lexsort((starts, doc_ids))
    ids: dict[str, int] = {}
    texts = [tuple([ids.setdefault(w, len(ids)) for w in segments[i].split(" ")]) for i in order]
    doc_ids, starts = doc_ids[order], starts[order]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter((x for t in texts for x in t), np.uint32, int(lengths.sum()))
    ends = np.cumsum(lengths)
    segment = np.repeat(np.arange(len(texts)), lengths)
    at = np.flatnonzero(np.arange(len(flat)) + window <= ends[segment])  # windows that lie in one segment
    place = starts[segment] + np.arange(len(flat)) - (ends - lengths)[segment]
    hashes = _window_hashes(flat, window)[at]
    _, where, kind, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    # A hash that is alone is no recurring window.
    once = at[where[n == 1]]
    docs, firsts = [doc_ids[segment[once]]], [place[once]]
    phrases = at[where[n > 1]]
    if len(phrases):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, phrase in enumerate(np.lib.stride_tricks.sliding_window_view(flat, window)[phrases].tolist()):
            automaton.add_word(tuple(phrase), i)
        automaton.make_automaton()
        # In the order of places; of a phrase's occurrences the first counts.
        best: dict[object, tuple[int, int]] = {}
        hits = 0
        for text, doc, start in zip(texts, doc_ids.tolist(), starts.tolist(), strict=True):
            for end, phrase in automaton.iter(text):
                spot = (doc, start + end - window + 1)
                hits += 1
                if phrase not in best or spot < best[phrase]:
                    best[phrase] = spot
        often = at[n[kind] > 1]
        if hits < len(often):  # other words under a phrase's hash
            known = {tuple(flat[p : p + window].tolist()) for p in phrases}
            for p in often.tolist():
                if (words := tuple(flat[p : p + window].tolist())) not in known:
                    spot = (int(doc_ids[segment[p]]), int(place[p]))
                    best[words] = min(best.get(words, spot), spot)
        docs.append(np.fromiter((x[0] for x in best.values()), np.int64, len(best)))
        firsts.append(np.fromiter((x[1] for x in best.values()), np.int64, len(best)))
    return np.concatenate(docs), np.concatenate(firsts)


def _window_hashes(ids: np.ndarray, window: int) -> np.ndarray:
    """Of the windows from each word id on; the last window - 1 of them are of no window."""
    out = np.zeros(len(ids), U)
    found = grams(mix(ids.astype(U)), window)
    out[: len(found)] = found
    return out


def _locate(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs, firsts = earliest(window, pdf["doc_id"].to_numpy(np.int64), pdf["start"].to_numpy(np.int64), pdf["segment"].tolist())
        order = np.lexsort((firsts, docs))
        docs, firsts = docs[order], firsts[order]
        cut = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, int)
        return pd.DataFrame({"doc_id": docs[cut], "firsts": [x.astype("<i8").tobytes() for x in np.split(firsts, cut[1:])] if len(cut) else []})

    return run


_REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _remove(window: int, gram: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, marks, firsts = Column.of(batch.column(1)), _lists(batch.column(2)), batch.column(3).to_pylist()
            removed, digests, texts, counts = [], [], [], []
            for a, b in chunks(column):
                words = column.words(a, b)
                m = Minimizers(words, window, gram)
                repeated = _marked(m, marks[a:b])
                for r in range(b - a):
                    lo, hi = words.first[r], words.first[r + 1]
                    x, y = np.searchsorted(m.rows, (r, r + 1))
                    gone = m.starts[x:y][repeated[x:y]]
                    if len(gone) and firsts[a + r]:
                        kept = np.concatenate([np.frombuffer(p, "<i8") for p in firsts[a + r]])
                        gone = gone[~np.isin(gone - lo, kept)]
                    edges = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(edges, gone - lo, 1)
                    np.add.at(edges, gone - lo + window, -1)
                    keep = np.flatnonzero(np.cumsum(edges)[:-1] == 0) + lo
                    digest, parts = hashlib.sha256(), []
                    for piece in words.pieces(keep):
                        digest.update(piece)
                        if with_text:
                            parts.append(piece)
                    counts.append(hi - lo)
                    removed.append(hi - lo - len(keep))
                    digests.append(digest.hexdigest())
                    texts.append(b"".join(parts) if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True, hot_places: int = HOT_PLACES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null without with_text) of each row of docs.

    Words are runs of anything but ASCII white space, taken unchanged from doc_id, text. A
    window is `window` consecutive words of one document; words that are covered by a window
    whose words also start earlier (smaller doc_id, or the same document and an earlier start)
    are removed, judged on the input. Kept words are joined by one space.

    A null text has no words. A row whose doc_id is null is returned unchanged and repeats
    nothing. Rows that share a doc_id and a text are one document, each returned; neither is
    earlier than the other. Texts of any length are read whole; an empty table gives an empty
    one; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    recurring = known.mapInArrow(_fingerprints(window, gram, False), "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")).where("n > 1")
    files = files_for(spark, 20 * docs.count())
    recurring = materialize(recurring, "recurring", files, 2)
    pairs = known.mapInArrow(_fingerprints(window, gram, True), "doc_id long, mark long")
    pairs = pairs.join(recurring, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks"), F.collect_set(F.when(F.col("n") > hot_places, F.col("mark"))).alias("hot"))
    marks = materialize(pairs, "marks", files, 2)
    marked = known.join(marks, "doc_id").select("doc_id", "text", "marks", "hot")
    # Segments merge into the earliest place before they move.
    size = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    shards = max(1, size * 160 // shard_bytes)  # a segment has about 26 words
    segments = marked.mapInArrow(_segments(window, gram, shards), _SEGMENTS)
    segments = segments.groupBy("shard", "segment").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("shard", "at.doc_id", "at.start", "segment")
    firsts = segments.groupBy("shard").applyInPandas(_locate(window), "doc_id long, firsts binary")
    firsts = materialize(firsts.groupBy("doc_id").agg(F.collect_list("firsts").alias("firsts")), "firsts", files, 2)
    discard(recurring)
    notes = marks.join(firsts, "doc_id", "left").select("doc_id", "marks", "firsts")
    out = docs.join(notes, "doc_id", "left").select("doc_id", "text", "marks", "firsts")
    return out.mapInArrow(_remove(window, gram, with_text), _REMOVED)
