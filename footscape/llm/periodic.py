"""Periodic runs of words: multi-scale minimizers as seeds, extension by comparison, direct scans of short lags."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footscape.llm.common import CRC_SQL

#: Periods up to this are found by comparing the words at that lag; longer ones from minimizers, a scale for (Q, 2Q] each.
SHORT = 16
#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
CACHE_WORDS, BATCH_CHARS = 1 << 20, 1 << 23
_MASKED = np.uint64((1 << 64) - 1)
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A digest of two neighbours; never the mark of a masked one."""
    h = a * _MIX[0] + b * _MIX[1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(1)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each `width` neighbours, a power of two."""
    step = 1
    while step < width:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of digests that are the least of some window of `width`; masked ones are none. Equal least ones all are."""
    if len(h) < width:
        return np.empty(0, np.int64)
    low = _slide(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero((_slide(np.concatenate([pad, low, pad]), width, np.maximum) == h) & (h != _MASKED))


def _equal_from(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and from b on (step 1), or back (step -1), are equal. Signs between texts equal nothing."""
    n, size = 0, 64
    while True:
        x, y = (ids[p + n:p + n + size] if step > 0 else ids[max(p - n - size + 1, 0):p - n + 1][::-1] for p in (a, b))
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        if len(differ):
            return n + int(differ[0])
        n += m
        if m < size:
            return n
        size *= 2


def _lag_stretches(ids: np.ndarray, q: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) of words that equal those q before, with the q words before them, as long as a run has to be."""
    same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
    turn = np.flatnonzero(same[1:] != same[:-1])
    start, end = turn[::2], turn[1::2] + q
    for k in np.flatnonzero(end - start >= max(LEAST, TIMES * q)):
        yield int(start[k]), int(end[k])


def _seeds(pos: np.ndarray, value: np.ndarray, h: np.ndarray, shortest: int, longest: int) -> list[tuple[int, int]]:
    """(lag, position) of equal minimizers whose distance may be a period of this scale, where a third equal one follows.

    A digest that isn't masked comes again after an eighth of the longest period at the earliest, so the loop
    over the next, the next but one, ... ends after a few rounds.
    """
    order = np.argsort(value, kind="stable")
    p, v, out = pos[order], value[order], []
    for j in range(1, len(p)):
        near = (v[j:] == v[:-j]) & (p[j:] - p[:-j] <= longest)
        if not near.any():
            break
        first, lag = p[:-j][near], (p[j:] - p[:-j])[near]
        ok = (lag >= shortest) & (first + 2 * lag < len(h))
        first, lag = first[ok], lag[ok]
        third = h[first + 2 * lag] == h[first]
        out += list(zip(lag[third].tolist(), first[third].tolist()))
    return sorted(set(out))


def runs_of(words: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period. `words`: each text's word numbers, from 0.

    For periods in (Q, 2Q] digests of Q/2 words are taken, and the least ones of Q/2 neighbours. A run of four periods
    holds three equal least ones a period apart. Digests with a period of at most a fourth of their own words are masked:
    they lie in a run found before, and would come too often. A run's period is its smallest one: where the same words
    were found with a smaller period, the larger one is passed over.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    base = np.cumsum(size + 1) - size  # of each text's first word; a sign of its own stands before each text, and one at the end
    ids = np.full(int(size.sum()) + len(words) + 1, -1, np.int32)
    ids[base - 1] = -2 - np.arange(len(words))
    for b, w in zip(base, words):
        ids[b:b + len(w)] = w
    found: dict[tuple[int, int], int] = {}
    top = int(size.max(initial=0)) // TIMES
    for q in range(1, min(SHORT, top) + 1):
        for s, e in _lag_stretches(ids, q):
            found.setdefault((s, e), q)
    # the texts long enough for the scale, as places of `ids`, and the digests from there on
    live, place = np.ones(len(words), bool), np.arange(len(ids))
    h, grams, scale = ids.astype(np.int64).view(np.uint64), 1, SHORT
    while top > scale:
        more = size >= TIMES * (scale + 1)
        if not (more == live).all():
            keep = np.concatenate([np.repeat(more[live], size[live] + 1), [True]])
            place, h, live = place[keep], h[keep], more
        while grams < scale // 2:
            h = _pair(h, np.concatenate([h[grams:], np.zeros(min(grams, len(h)), np.uint64)]))
            grams *= 2
        masked = h
        if known := [(s, e - grams) for (s, e), q in found.items() if 4 * q <= grams and e - s >= grams]:
            masked = h.copy()
            starts = np.searchsorted(place, [s for s, _ in known])
            for (s, last), at in zip(known, starts):
                if at < len(place) and place[at] == s:
                    masked[at:at + last - s + 1] = _MASKED
        pos = minimizers(masked, scale // 2)
        done: tuple[int, int] = (0, 0)  # the lag, and the end of what was compared at it
        for lag, p in _seeds(pos, h[pos], h, scale + 1, 2 * scale):
            at = int(place[p])
            if done[0] == lag and at < done[1] or at + lag >= len(ids):
                continue
            s = at - _equal_from(ids, at - 1, at - 1 + lag, -1)
            e = at + _equal_from(ids, at, at + lag, 1) + lag
            done = (lag, e - lag)
            if e - s >= max(LEAST, TIMES * lag):
                found.setdefault((s, e), lag)
        scale *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for (s, e), q in found.items():
        k = int(np.searchsorted(base, s, side="right")) - 1
        out[k].append((s - int(base[k]), e - s, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(n: int, runs: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return keep


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a planted run, in the texts of about every tenth id: from one word on, so many words over and over."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def find_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed), one row per row of `docs` (doc_id, text, ...): all runs as (start, length, period), and the
    text with each run cut down to its first period, words joined by one space.

    A run is a stretch of consecutive words with smallest period q and at least max(6, 4q) words that no neighbouring
    word extends. With `planted`, runs are first put into the texts of about every tenth id (none, where the id is null).
    Null and empty texts have no runs. Repeated rows repeat, other columns are ignored, and an empty table gives
    no rows. Texts are read whole, in batches of about BATCH_CHARS.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in set().union(*texts):
                known.setdefault(w, len(known))
            numbers = [np.fromiter(map(known.__getitem__, t), np.int32, len(t)) for t in texts]
            runs = runs_of(numbers)
            out = []
            for t, r in zip(texts, runs):
                out.append(b" ".join([w for w, k in zip(t, kept_words(len(t), r).tolist()) if k] if r else t))
            off = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(off), parts), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

        for f in frames:
            ids: list = []
            texts: list[list[bytes]] = []
            chars = 0
            for i, t in zip(f.column("doc_id").to_pylist(), f.column("text")):
                raw = t.as_py() or b""
                words = raw.split()  # of bytes: white space is 20 and 09-0D
                ids.append(i)
                texts.append(plant(i, words) if planted else words)
                chars += len(raw)
                if chars > BATCH_CHARS:
                    yield batch(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield batch(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(docs: DataFrame, planted: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) from `find_runs`: the number of
    runs, the longest one (ties: smallest start, then period; nulls where there is none), and digests of all."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = find_runs(docs, planted).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("b.minus")
    return rows.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"),
                       F.floor(length * 1000 / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE = f"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
n AS (SELECT rid, d.doc_id, ws, len(ws) AS n, coalesce(crc % 10 = 0 AND len(ws) > 0, false) AS hit, (crc // 10)::BIGINT AS g FROM d LEFT JOIN crcs USING (doc_id)),
ap AS (SELECT *, CASE WHEN hit THEN g % n ELSE n END AS a FROM n),
app AS (SELECT *, CASE WHEN hit THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM ap),
w AS (SELECT rid, n, i, ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS w FROM app, unnest(range(n)) x(i)),
eq AS (SELECT x.rid, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM eq),
st AS (SELECT rid, q, min(i) AS s, max(i) + 1 + q AS e FROM isl GROUP BY rid, q, k HAVING count(*) >= greatest(6, 4 * q) - q),
r AS (SELECT rid, s, e - s AS l, min(q) AS q FROM st GROUP BY rid, s, e),
best AS (SELECT rid, count(*) AS n_runs, arg_min(struct_pack(s := s, l := l, q := q), (-l, s, q)) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, i FROM r, unnest(range(s + q, s + l)) x(i)),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM n LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
