"""Bounded-space best-fit packing of token sequences."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footscape.llm.bpe import batches
from footscape.llm.common import kept, stored

CAPACITY, OPEN_BINS, END_ID = 4096, 256, 1
#: Words of one generation of the cache, of which there are two; characters of texts that are encoded at once, and rows read at once.
CACHE_WORDS, ENCODED_CHARS, ROWS = 1 << 18, 1 << 20, 1024
_MARKED = re.compile(r"[^\W\d_]+[.,;:!?%$&#*|]+")
#: Pieces that are packed together in the second pass: one task takes the open bins of so many tasks.
BINS_A_TASK = 1 << 14


class BestFit:
    """A fixed number of open bins, found by free space: bit f of `free` says that some bin has f tokens left.

    An item goes to the fullest bin that has room (the lowest set bit at or above its length). If none has,
    a new bin is opened, and when all are open, the fullest one is closed for it. `close` is called with
    each closed bin's items.
    """

    def __init__(self, capacity: int, bins: int, close):
        self.capacity, self.bins, self.close = capacity, bins, close
        self.free, self.at, self.open = 0, {}, 0

    def _take(self, room: int) -> list:
        stack = self.at[room]
        items = stack.pop()
        if not stack:
            del self.at[room]
            self.free &= ~(1 << room)
        self.open -= 1
        return items

    def add(self, item, length: int) -> None:
        above = self.free >> length
        if above:
            room = length + ((above & -above).bit_length() - 1)
            items = self._take(room)
        else:
            room, items = self.capacity, []
            if self.open == self.bins:
                self.close(self._take((self.free & -self.free).bit_length() - 1))
        items.append(item)
        room -= length
        if not room:
            self.close(items)
            return
        self.at.setdefault(room, []).append(items)
        self.free |= 1 << room
        self.open += 1

    def finish(self) -> list[list]:
        """The bins that are still open."""
        left = [items for stack in self.at.values() for items in stack]
        self.free, self.at, self.open = 0, {}, 0
        return left


class Words:
    """Ids of words. No token reaches over a space, and a line's end counts as one, so each word is looked up once; what is known serves later batches.

    Known words are of two generations: once the young one is full it becomes the old one, and only words that come
    up again are taken over from there. So rare words go, frequent ones stay, and memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _together(self, words: list[str], parts: int) -> None:
        """Encode words of so many parts each, as one text; each part has one token that ends it. Where the number differs
        nothing is learned."""
        for k in range(0, len(words), 2048):
            some = words[k:k + 2048]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == parts * len(some) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for w, to in zip(some, (4 * cut[parts - 1::parts]).tolist()):
                    self.known[w] = raw[at:to]
                    at = to

    def _learn(self, words: list[str]) -> None:
        """Words of letters, and those with marks behind them, are encoded many at a time, the others one by one."""
        self._together([w for w in words if w.isalpha()], 1)
        self._together([w for w in words if _MARKED.fullmatch(w)], 2)
        rest = [w for w in words if w not in self.known]
        for k in range(0, len(rest), 4096):
            for w, e in zip(rest[k:k + 4096], self.tokenizer.encode_batch(rest[k:k + 4096], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str], end: bytes) -> list[bytes]:
        """The ids of each text and the end id."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*cut)
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.older, self.known, new = self.known, {}, words
        self.known |= {w: self.older[w] for w in new if w in self.older}
        self._learn(list(new.difference(self.known)))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) + end for ws in cut]


def shared_words(path: str) -> Words:
    """The words that tasks of one packing share in a worker; other operators' tasks end them."""
    return kept(("packing", path), lambda: Words(path))


_PIECE = [("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())]
_SCHEMA = "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_PIECE)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _PIECE)], names=[n for n, _ in _PIECE])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of a document.

    A document is its ids and `end_id`; a null text is empty and so a piece of length 1. Only documents
    longer than `capacity` are cut. Each task packs what it reads (bounded-space best fit); bins that are
    still open when it ends are, as whole bins, packed again with those of other tasks, which costs a shuffle of
    at most `open_bins` bins a task. Other columns are ignored, repeated rows are packed again, and an
    empty table gives no rows.
    """
    size = 4 * capacity

    def first(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        words, end, rows = shared_words(tokenizer_path), end_id.to_bytes(4, "little"), []
        serial = iter(range(TaskContext.get().partitionId() << 40, 1 << 62))

        def emit(items: list[tuple], still: bool = False) -> None:
            seq, offset = next(serial), 0
            for doc, piece, start, length, crc in items:
                rows.append((doc, piece, start, length, crc, seq, offset, still))
                offset += length

        fit = BestFit(capacity, open_bins, emit)
        for frame in (f.slice(at, ROWS) for f in frames for at in range(0, f.num_rows, ROWS)):
            ids_of, texts = frame.column("doc_id").to_pylist(), [t or "" for t in frame.column("text").to_pylist()]
            done = 0
            for group in batches(texts, ENCODED_CHARS):
                for doc, ids in zip(ids_of[done:done + len(group)], words.ids(group, end)):
                    for piece, at in enumerate(range(0, len(ids), size)):
                        part = ids[at:at + size]
                        fit.add((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), len(part) // 4)
                done += len(group)
                if rows:
                    yield _frame(rows)
                    rows.clear()
        for items in fit.finish():
            emit(items, True)
        if rows:
            yield _frame(rows)

    def second(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows: list[tuple] = []
        serial = iter(range((TaskContext.get().partitionId() << 40) + (1 << 61), 1 << 62))

        def emit(bins: list[tuple]) -> None:
            seq, offset = next(serial), 0
            for bin_, _ in bins:
                for doc, piece, start, length, crc in bin_:
                    rows.append((doc, piece, start, length, crc, seq, offset, False))
                    offset += length

        fit = BestFit(capacity, BINS_A_TASK, emit)
        held: dict[int, list[tuple]] = {}
        for frame in frames:
            for r in zip(*(frame.column(n).to_pylist() for n, _ in _PIECE)):
                held.setdefault(r[5], []).append(r)
        for bin_ in sorted(held.values(), key=lambda rs: -sum(r[3] for r in rs)):
            n = sum(r[3] for r in bin_)
            fit.add(([r[:5] for r in bin_], n), n)
        for bins in fit.finish():
            emit(bins)
        if rows:
            yield _frame(rows)

    packed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, _SCHEMA))
    left = packed.filter("open")
    tasks = max(1, -(-left.select("sequence_id").distinct().count() // BINS_A_TASK))
    again = left.repartition(tasks, F.pmod(F.xxhash64("sequence_id"), F.lit(tasks))).mapInArrow(second, _SCHEMA)
    return packed.filter("not open").unionByName(again).drop("open")
