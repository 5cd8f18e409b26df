"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition tokenises its documents and keeps `open_windows` windows open. A document's ids
are one piece, or full windows plus a remainder if it is longer than a window. A remainder goes
to the open window that it fits best. When it fits none, the fullest window is topped up with
the head of the remainder and emitted, which leaves no padding, and the rest opens a new window
(pieces may be cut freely). At the end of a partition its open windows are leftovers. They are
merged in rounds over ever fewer groups, each of bounded size, until a group holds all that is
left. That group fills one window after the other: only the very last can carry padding.

No shuffle moves tokens but those of leftovers (at most open_windows windows a partition).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

WINDOW = 2048
OPEN_WINDOWS = 16
END_ID = 1
#: Leftover windows that one merging task takes at most.
MERGE_GROUP = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("leftover", pa.bool_()), ("ids", pa.binary())])


class Packer:
    """The open windows of one task. A piece is (doc_id, start, ids, doc_tokens), ids an uint32 array."""

    def __init__(self, window: int, open_windows: int, first_sequence: int, keep_ids: bool) -> None:
        self.window, self.limit, self.next, self.keep_ids = window, open_windows, first_sequence, keep_ids
        self.open: list[tuple[int, list]] = []  # (room, pieces)
        self.rows: list[tuple] = []

    def emit(self, pieces: list, leftover: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.astype("<u4", copy=False).tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, self.next, at, leftover, raw if leftover or self.keep_ids else None))
            at += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc_id, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        if not len(ids):
            return
        fitting = [i for i, (room, _) in enumerate(self.open) if room >= len(ids)]
        if fitting:
            best = min(fitting, key=lambda i: self.open[i][0])
            room, pieces = self.open[best]
            pieces.append((doc_id, start, ids, total))
            if room == len(ids):
                self.emit(pieces)
                self.open.pop(best)
            else:
                self.open[best] = (room - len(ids), pieces)
            return
        if len(self.open) < self.limit:
            self.open.append((self.window - len(ids), [(doc_id, start, ids, total)]))
            return
        fullest = min(range(len(self.open)), key=lambda i: self.open[i][0])
        room, pieces = self.open.pop(fullest)
        self.emit([*pieces, (doc_id, start, ids[:room], total)])
        self.open.append((self.window - len(ids) + room, [(doc_id, start + room, ids[room:], total)]))

    def close(self, leftover: bool) -> None:
        for _, pieces in sorted(self.open, key=lambda x: x[0]):
            self.emit(pieces, leftover)
        self.open = []

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


_encoders: dict[str, object] = {}


#: What the fast way can't take: its pattern matcher gives up on long white space, and long words
#: cost it the square of their length.
_LONG_RUN = re.compile(r"\s{256}|\S{1024}")


def encoder(path: str):
    """text -> ids of the byte-level BPE in the tokenizer file at `path`, as tokenizers gives them.

    Texts of plain words go through a second library, which runs the file's own merges several
    times faster (tests compare the ids). Texts with long runs, and texts in which a special
    token's string occurs, which keeps its id, go through tokenizers itself.
    """
    if path not in _encoders:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        # The printable stand-ins that byte-level vocabularies use for the 256 bytes.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(stand_in[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            if _LONG_RUN.search(text) or any(s in text for s in special):
                return own.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[path] = encode
    return _encoders[path]


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents (columns doc_id, text), laid gapless into windows of `window` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    keep_ids, the piece's ids as little-endian unsigned 32-bit binary.

    Null and empty texts give one piece, the end id alone. A null doc_id is carried through.
    Repeated rows are packed once each. A text of any length is tokenised whole. An empty table
    gives no piece. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 32, keep_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encode(text.as_py() or "")
                found.append(END_ID)
                packer.add(doc_id, 0, np.array(found, "<u4"), len(found))
                if len(packer.rows) >= 4096:
                    yield packer.take()
        packer.close(leftover=True)
        yield packer.take()

    packed = materialize(docs.select("doc_id", "text").mapInArrow(pack, PIECES), "packed")
    whole, left = packed.where("not leftover"), packed.where("leftover")
    # Rounds: as many groups as hold MERGE_GROUP windows each, until one group is left. A group
    # leaves open_windows at most (half of MERGE_GROUP if that is less), so their number shrinks.
    done, tables, level = [whole], [], 1
    while True:
        windows = left.select("sequence_id").distinct().count()
        groups = max(1, -(-windows // MERGE_GROUP))
        last = groups == 1

        def merge(batches: Iterator[pa.RecordBatch], base: int = level << 56, last: bool = last) -> Iterator[pa.RecordBatch]:
            packer = Packer(window, 1 if last else min(open_windows, max(1, MERGE_GROUP // 2)), base + (TaskContext.get().partitionId() << 32), keep_ids)
            for batch in batches:
                for row in batch.to_pylist():
                    packer.add(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
                if len(packer.rows) >= 4096:
                    yield packer.take()
            packer.close(leftover=not last)
            yield packer.take()

        # Sorted within a group, so that a task that runs again packs alike.
        dealt = left.repartition(groups, F.expr(f"(shiftright(sequence_id, 32) & 16777215) div {max(1, MERGE_GROUP // open_windows)}")) if groups > 1 else left.coalesce(1)
        merged = materialize(dealt.sortWithinPartitions("sequence_id", "offset").mapInArrow(merge, PIECES), "merged")
        tables.append(merged)
        done.append(merged.where("not leftover"))
        if last:
            break
        left, level = merged.where("leftover"), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
