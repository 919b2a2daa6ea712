"""Byte-level BPE by corpus-level merge replay, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A cut between two words is safe at a single space with other characters on both sides.
_UNSAFE = re.compile(r"\s\s|\A\s|\s\Z")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words kept between batches, and their characters; the memory is emptied beyond that.
CACHE_WORDS, CACHE_CHARS = 1 << 20, 1 << 24


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of each pair of tokens whose bytes together are a token; a pair (a, b) has the key a << 32 | b."""
    return {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}


def replay_merges(words: list[bytes], ranks: dict[bytes, int], pairs: dict[int, int]) -> list[list[int]]:
    """Token ids of each word: all words are merged together, rank by rank.

    `found` maps the rank of a token pair to the places where that pair stands, over all words. The lowest
    rank is applied at all its places, from left to right, and only the pairs with the two neighbours are
    looked up anew. A word in which that brings up a lower rank waits until that one has been applied, as
    it would if it were merged alone.
    """
    single = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
    size = np.fromiter(map(len, words), np.int64, len(words))
    head = np.cumsum(size) - size
    first = single[np.frombuffer(b"".join(words), np.uint8)]
    sym, owner = first.tolist(), np.repeat(np.arange(len(words)), size)
    here = np.arange(len(first))
    nxt = np.where(here + 1 < np.repeat(head + size, size), here + 1, -1).tolist()
    prv = np.where(here > np.repeat(head, size), here - 1, -1).tolist()
    owner = owner.tolist()
    rank = pairs.get
    found: dict[int, list[int]] = {}
    for i, r in enumerate(map(rank, (first[:-1] << 32 | first[1:]).tolist())):
        if r is not None and nxt[i] >= 0:
            if r in found:
                found[r].append(i)
            else:
                found[r] = [i]
    heap = list(found)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        places = found.pop(r, None)
        if places is None:
            continue
        places.sort()
        waiting: set[int] = set()
        later: list[int] = []
        for i in places:
            j = nxt[i]
            if j < 0 or sym[i] < 0 or rank(sym[i] << 32 | sym[j]) != r:
                continue
            if owner[i] in waiting:
                later.append(i)
                continue
            after, before = nxt[j], prv[i]
            sym[i], sym[j], nxt[i] = r, -1, after
            if after >= 0:
                prv[after] = i
            for at, to in ((before, i), (i, after)):
                if at >= 0 and to >= 0 and (x := rank(sym[at] << 32 | sym[to])) is not None:
                    if x in found:
                        found[x].append(at)
                    else:
                        found[x] = [at]
                        heapq.heappush(heap, x)
                    if x < r:
                        waiting.add(owner[i])
        if later:
            found[r] = later
            heapq.heappush(heap, r)
    out = []
    for i, w in zip(head.tolist(), words):
        ids, i = [], i if w else -1
        while i >= 0:
            ids.append(sym[i])
            i = nxt[i]
        out.append(ids)
    return out


class Codec:
    """Encodes batches of texts as the public library does, without special tokens, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs, self.split = ranks, pair_ranks(ranks), regex.compile(pattern)
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.vocab[r] = token
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.chars = 0

    def _learn(self, parts: Iterable[str], lead: str, into: dict[str, bytes]) -> None:
        pieces = self.pieces
        new = {p: self.split.findall(lead + p) for p in parts}
        fresh = list({w for ws in new.values() for w in ws if w not in pieces})
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        whole = [self.ranks.get(b) for b in raw]
        open_ = [k for k, r in enumerate(whole) if r is None]
        for k, ids in zip(open_, replay_merges([raw[k] for k in open_], self.ranks, self.pairs)):
            pieces[fresh[k]] = np.array(ids, "<u4").tobytes()
        for k, r in enumerate(whole):
            if r is not None:
                pieces[fresh[k]] = r.to_bytes(4, "little")
        for p, ws in new.items():
            into[p] = b"".join([pieces[w] for w in ws])
            self.chars += len(p)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) + len(self.first) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.known, self.first, self.pieces, self.chars = {}, {}, {}, 0
        cut = [(_SAFE_CUT.split(t) if _UNSAFE.search(t) else t.split(" ")) if t else [] for t in texts]
        self._learn({p[0] for p in cut if p}.difference(self.first), "", self.first)
        self._learn(set().union(*(p[1:] for p in cut)).difference(self.known), " ", self.known)
        known = self.known.__getitem__
        return [self.first[p[0]] + b"".join(map(known, p[1:])) if p else b"" for p in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(1)
def shared_codec(ranks_path: str, pattern: str) -> Codec:
    """A worker's codec: what it has learned of words serves the tasks that it gets later."""
    return Codec(load_ranks(ranks_path), pattern)


def batches(texts: list[str], chars: int = 1 << 22) -> Iterator[list[str]]:
    """Runs of texts of about so many characters together; a longer text is a run of its own."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > chars:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of `docs` (doc_id, text, ...).

    A null or empty text has no tokens. Rows are encoded where they are read: each batch of texts is the
    corpus of one merge replay, and ids of words are kept, in bounded memory, for the batches that follow.
    With `keep_ids` the ids themselves follow as an array. Other columns are ignored, repeated rows repeat.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(ranks_path, pattern)
        for frame in frames:
            texts, out = [t or "" for t in frame.column("text").to_pylist()], []
            for group in batches(texts):
                for ids in codec.encode(group):
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(),
                                np.frombuffer(ids, "<u4").astype("int64") if keep_ids else None))
            cols = [frame.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())]
            if keep_ids:
                cols.append(pa.array([o[3] for o in out], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
