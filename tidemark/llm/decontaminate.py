"""Benchmark decontamination: short test items inside long documents.

Size-partitioned MinHash containment search. A whole document's MinHash says little about a
passage a hundred times shorter, so the signature is the item's: its k smallest shingle hashes,
k set by the partition of its size. Of an item with n shingles a containment of `percent` leaves
at most floor((100 - percent) * n / 100) out, so one more than that in the sketch, with the
largest n of the partition, makes sure that a contained item shows at least one sketch hash
among the document's shingles. That finds candidates (no false negatives); exact containment on
the shingles' own words then confirms them.

Items are taken in blocks of bounded size, each of which travels to all tasks. A pass over the
documents takes PASS_BLOCKS of them, over words that are hashed once; more items take more
passes, so that what a task holds is bounded. Documents are never shuffled, and each is looked
at whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textscan import PUNCT, U, Column, Words, chunks, grams, inside_rows

SHINGLE = 5
PERCENT = 80
#: Items in a block: at most this many, of at most this much text.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20
#: Blocks that a task holds in one pass over the documents.
PASS_BLOCKS = 8

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of all that isn't ASCII."""
    return _WORD.findall((text or "").translate(_LOWER))


def _shingles(words: list[str], k: int) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(words[i : i + k]) for i in range(len(words) - k + 1)))


class Index:
    """Sketches of a block of items, by shingle width and size partition."""

    def __init__(self, items: list[tuple[int, str]], percent: int, k: int) -> None:
        self.percent = percent
        #: By width: (item_id, text, sorted hashes of all its shingles, number of shingles).
        self.items: dict[int, list[tuple[int, str, np.ndarray, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                width = min(k, len(words))  # an item of fewer words is one shingle
                shingles = _shingles(words, width)
                self.items.setdefault(width, []).append((item_id, text, np.sort(_hash(shingles, width)), len(shingles)))
        self.sketches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, group in self.items.items():
            keep = [min(n, (100 - percent) * (1 << (n - 1).bit_length()) // 100 + 1) for *_, n in group]  # sizes up to the next power of two
            flat = np.concatenate([own[:m] for (_, _, own, _), m in zip(group, keep, strict=True)])
            order = np.argsort(flat, kind="stable")
            self.sketches[width] = flat[order], np.repeat(np.arange(len(group)), keep)[order]

    def search(self, words: Words, shingles_of) -> Iterator[tuple[int, int, int, int]]:
        """(row, item_id, shared shingles, item's shingles) of what the rows of words contain.
        shingles_of gives the starts and hashes of their shingles of a width."""
        for width, (sketch, owner) in self.sketches.items():
            starts, shingles = shingles_of(width)
            low = np.searchsorted(sketch, shingles, "left")
            hit = np.flatnonzero(sketch[np.minimum(low, len(sketch) - 1)] == shingles)
            if not len(hit):
                continue
            low, high = low[hit], np.searchsorted(sketch, shingles[hit], "right")
            row = np.searchsorted(words.first, starts[hit], "right") - 1
            found = {(r, int(i)) for r, x, y in zip(row.tolist(), low.tolist(), high.tolist(), strict=True) for i in owner[x:y]}
            for r, i in sorted(found):
                item_id, text, hashes, n = self.items[width][i]
                # Only places whose hashes are the item's are read, once for each hash and word sequence.
                x, y = np.searchsorted(starts, (words.first[r], words.first[r + 1]))
                at = np.searchsorted(hashes, shingles[x:y])
                alike = starts[x:y][hashes[np.minimum(at, len(hashes) - 1)] == shingles[x:y]]
                own = {words.text(p, p + width) for p in alike.tolist()}
                shared = sum(" ".join(s).encode() in own for s in _shingles(words_of(text), width))
                if 100 * shared >= self.percent * n:
                    yield r, item_id, shared, n


class Search:
    """The items of a pass, block by block."""

    def __init__(self, blocks: list, percent: int, k: int) -> None:
        self.indexes = [Index(b, percent, k) for b in blocks]

    def __call__(self, column: Column, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
        """As Index.search(), of rows [a, b) of a column."""
        words = column.words(a, b, PUNCT, lower=True)
        hashes, known = words.hashes(), {}

        def shingles_of(width: int) -> tuple[np.ndarray, np.ndarray]:
            if width not in known:
                starts = inside_rows(words, width)
                known[width] = starts, grams(hashes, width)[starts]
            return known[width]

        for index in self.indexes:
            for row, *found in index.search(words, shingles_of):
                yield a + row, *found


def _hash(shingles: list[tuple[str, ...]], width: int) -> np.ndarray:
    words = Column.of(pa.array([" ".join(s) for s in shingles], pa.string())).words(0, len(shingles))
    return grams(words.hashes(), width)[words.first[:-1]] if shingles else np.zeros(0, U)


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of bounded size, read one partition after the other."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        text = row[1] or ""
        if block and (len(block) >= BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def passes(items: DataFrame) -> Iterator[list]:
    """Broadcasts of blocks(), as many at a time as one pass takes."""
    context, held = items.sparkSession.sparkContext, []
    for block in blocks(items):
        held.append(context.broadcast(block))
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


_FOUND = "doc_id long, item_id long, n_shared long, n_item long"


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_shared, n_item for each document that contains `percent` per cent or
    more of an item's distinct k-word shingles (an item of fewer words is one shingle).

    docs has doc_id, text; items has item_id, text. Words are runs of ASCII letters, digits and
    of all characters beyond ASCII, with A-Z lower-cased, so punctuation and case don't hide a
    copy. Null texts have no words; items without words are contained in nothing. Null ids are
    carried through. Repeated rows give repeated results, on either side. Texts of any length
    are searched whole; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], _FOUND)
    for n, held in enumerate(passes(items)):

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            of = Search([x.value for x in held], percent, k)
            for batch in batches:
                column, found = Column.of(batch.column(1)), []
                for a, b in chunks(column):
                    found += of(column, a, b)
                rows, item, n_shared, n_item = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (item, n_shared, n_item)]], names=["doc_id", "item_id", "n_shared", "n_item"])

        part = texts.mapInArrow(search, _FOUND)
        out = part if not n else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The rows of docs that contain no item, with all their columns; as find_items().

    Rows are judged one by one where they are read: nothing is shuffled or joined.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    # Plain names on the way through Python, whatever the columns are called.
    names, at = docs.columns, docs.columns.index("text")
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for held in passes(items):

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            of = Search([x.value for x in held], percent, k)
            for batch in batches:
                column, clean = Column.of(batch.column(at)), np.ones(batch.num_rows, bool)
                for a, b in chunks(column):
                    clean[[r for r, *_ in of(column, a, b)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.toDF(*names)
