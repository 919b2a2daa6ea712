"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, with size-derived bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape.llm.common import free, stored
from footscape.operators.components import connected_components, heavy_keys, lookup

N, NUMER, DENOM = 4, 85, 100
#: A column of the incidence with more documents than this is wide: it is multiplied in another way (see `links`).
WIDE = 24
#: Bits of the map of frequent n-grams: a fixed size, so that every task can have it.
MAP_BITS = 1 << 23
#: Blocks of n-gram columns: per document and block, the number of its n-grams bounds an overlap.
BLOCKS = 64
#: Pivots that each wide column is multiplied with before its remaining pairs are listed: those with the fewest rarer
#: n-grams, which in a group of copies are the least edited. Columns that share documents choose the same ones.
PIVOTS = 12
#: Of all documents' n-grams, the lowest 1/SHARE by digest are counted; of documents that then meet in wide columns, all.
SHARE = 3
CACHE_WORDS = 1 << 18
_MASK = (1 << 64) - 1
_STEP = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 5) & _MASK | 1) for k in range(64)]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Digests of words; new ones are made when asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 64-bit digests of a text's word n-grams: a mixed linear form of the words' digests."""

    def __init__(self, n: int = N):
        self.n, self.known = n, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and white space of 20 and 09-0D
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        m = len(h) - n + 1
        total = h[:m] * _STEP[0] + np.uint64(n)
        for k in range(1, n):
            total += h[k:m + k] * _STEP[k]
        total = _scramble(total)
        total.sort()
        return total[np.r_[True, total[1:] != total[:-1]]]


def least_overlap(a, b, numer: int = NUMER, denom: int = DENOM):
    """The smallest overlap of sets of these sizes that links them: denom * o >= numer * (a + b - o)."""
    return -(-numer * (a + b) // (numer + denom))


def prefix_length(size: int, numer: int = NUMER, denom: int = DENOM) -> int:
    """Linked sets share one of the first so many n-grams, in any one order of all n-grams."""
    return size - -(-numer * size // denom) + 1


def _arrow(docs: DataFrame, fn, schema: str, **more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fn, schema, **more)


def shingle_digests(docs: DataFrame, n: int = N, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, n_shingles, set_id, counts): the size of each text's set, a digest of the set (null if empty), and how many
    n-grams fall into each block of columns, a byte each; 255 stands for that many or more."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for f in frames:
            size, digest, counts = [], [], []
            for t in f.column("text"):
                s = shingle(t.as_py())
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                counts.append(np.bincount((s % np.uint64(blocks)).astype(np.int64), minlength=blocks).clip(0, 255).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["doc_id", "n_shingles", "set_id", "counts"])

    return _arrow(docs, run, "doc_id long, n_shingles long, set_id binary, counts binary")


def frequent_map(docs: DataFrame, n: int, wide: int, bits: int, share: int = 1) -> np.ndarray:
    """A bitmap of hashes of n-grams that are frequent among the lowest 1/share of each document's n-grams by digest.

    It only orders n-grams (frequent ones last), so it decides the work and never the result. If more
    n-grams than an eighth of the bits are frequent, the bar is raised.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for f in frames:
            parts = [s[:-(-len(s) // share)] for s in (shingle(t.as_py()) for t in f.column("text"))]
            g, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c)], names=["gram", "c"])

    counts = stored(_arrow(docs, run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).filter(F.col("c") > wide))
    by = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bar, left = 0, sum(by.values())
    for k in sorted(by):
        if left <= bits // 8:
            break
        left -= by[k]
        bar = 2 ** (k + 1)
    at = F.shiftrightunsigned("gram", 64 - bits.bit_length() + 1)
    words = counts.filter(F.col("c") >= bar).select(at.alias("b")).select(F.shiftright("b", 5).alias("w"), F.expr("shiftleft(1L, cast(b & 31 as int))").alias("v"))
    out = np.zeros(bits // 32, np.uint32)
    for r in words.groupBy("w").agg(F.bit_or("v").alias("v")).collect():
        out[r["w"]] = r["v"]
    return out


def prefixes(docs: DataFrame, frequent: np.ndarray, n: int, numer: int, denom: int) -> DataFrame:
    """The part of the incidence that matters, a row per document: (doc_id, size, few, grams), its first n-grams in the order
    of (frequent, digest), of which the first `few` are not frequent."""
    shift = np.uint64(64 - (len(frequent) * 32).bit_length() + 1)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for f in frames:
            d, z, few, g = [], [], [], []
            for doc, t in zip(f.column("doc_id").to_pylist(), f.column("text")):
                s = shingle(t.as_py())
                if not len(s):
                    continue
                b = s >> shift
                often = (frequent[b >> np.uint64(5)] >> (b & np.uint64(31)).astype(np.uint32)) & 1 > 0
                k = prefix_length(len(s), numer, denom)
                first = np.concatenate([np.flatnonzero(~often)[:k], np.flatnonzero(often)[:k]])[:k]
                d.append(doc)
                z.append(len(s))
                few.append(int((~often[first]).sum()))
                g.append(s[first])
            off = np.concatenate([[0], np.cumsum([len(x) for x in g])]).astype(np.int32)
            flat = pa.array(np.concatenate([*g, np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(z, pa.int32()), pa.array(few, pa.int32()), pa.ListArray.from_arrays(pa.array(off), flat)],
                                             names=["doc_id", "size", "few", "grams"])

    return _arrow(docs, run, "doc_id long, size int, few int, grams array<long>")


def _entries(rows: DataFrame) -> DataFrame:
    """(gram, doc_id, size, room, frequent), one row per n-gram; `room` is how many of its document's n-grams come after it."""
    each = rows.select("doc_id", "size", "few", F.posexplode("grams").alias("at", "gram"))
    return each.select("gram", "doc_id", "size", (F.col("size") - 1 - F.col("at")).alias("room"), (F.col("at") >= F.col("few")).alias("frequent"))


def _possible(a: str, b: str, numer: int, denom: int) -> Column:
    """Size bounds of a pair that meets in a column: the smaller set is large enough, and from their first common n-gram
    on both have as many left as the overlap needs."""
    sa, sb = F.col(f"{a}.size"), F.col(f"{b}.size")
    need = F.ceil((sa + sb) * numer / (numer + denom) - 1e-9)
    return (F.least(sa, sb) * denom >= F.greatest(sa, sb) * numer) & (F.least(f"{a}.room", f"{b}.room") + 1 >= need)


def _column_products(entries: DataFrame, wide: int, numer: int, denom: int) -> DataFrame:
    """(a, b, gram, size, room): pairs (a, b) that meet in a column of at most `wide` documents, with a null gram, and
    the entries of wider columns as they came, their document in `a`.

    A task has its columns sorted, multiplies each narrow one with itself, and passes on the rows of wide
    ones, so one shuffle serves both. Of a column that doesn't fit into its batch, at most `wide` rows are held.
    """

    def batch(pairs: tuple[np.ndarray, np.ndarray], over: list[np.ndarray]) -> pa.RecordBatch:
        (a, b), (g, d, z, room) = pairs, over
        none = pa.nulls(len(a))
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([a, d])), pa.concat_arrays([pa.array(b), pa.nulls(len(d), pa.int64())]),
            pa.concat_arrays([none.cast(pa.int64()), pa.array(g)]), pa.concat_arrays([none.cast(pa.int32()), pa.array(z)]),
            pa.concat_arrays([none.cast(pa.int32()), pa.array(room)])], names=["a", "b", "gram", "size", "room"])

    def product(cols: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]:
        """A batch for the columns that are complete, the rows of the one that may go on, and the wide columns' grams."""
        g, d, z, room = cols
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
        keep = 0
        if not last and len(start) and len(g) - start[-1] <= wide:
            keep = len(g) - start[-1]
            start = start[:-1]
        end = len(g) - keep
        count = np.diff(np.r_[start, end]) if len(start) else np.empty(0, np.int64)
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in np.unique(count[(count > 1) & (count <= wide)]):
            at = start[count == size]
            i, j = np.triu_indices(size, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            zx, zy = z[x].astype(np.int64), z[y].astype(np.int64)
            ok = (np.minimum(zx, zy) * denom >= np.maximum(zx, zy) * numer) & (np.minimum(room[x], room[y]) + 1 >= least_overlap(zx, zy, numer, denom)) & (d[x] != d[y])
            out_a.append(np.minimum(d[x[ok]], d[y[ok]]))
            out_b.append(np.maximum(d[x[ok]], d[y[ok]]))
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if len(a):
            o = np.lexsort((b, a))
            a, b = a[o], b[o]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            a, b = a[new], b[new]
        over = np.repeat(count > wide, count)
        return batch((a, b), [c[:end][over] for c in cols]), [c[end:] for c in cols], g[start[count > wide]]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held: list[np.ndarray] | None = None
        going: int | None = None  # a wide column whose first rows were passed on and that may go on
        for f in frames:
            cols = [f.column(n).to_numpy(zero_copy_only=False) for n in ("gram", "doc_id", "size", "room")]
            if going is not None:
                more = cols[0] == going
                if more.any():
                    yield batch((none, none), [c[more] for c in cols])
                    cols = [c[~more] for c in cols]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            out, held, over = product(cols, False)
            if len(over):
                going = over[-1]
            yield out
        if held is not None:
            yield product(held, True)[0]

    return entries.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "a long, b long, gram long, size int, room int")


def _split_columns(found: DataFrame, wide: int, numer: int, denom: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that meet in narrow columns, and the entries of wide ones: those marked, and those that turned out wide."""
    entries, cols = _entries(stored(found)), ["gram", "doc_id", "size", "room"]
    met = stored(_column_products(entries.filter(~F.col("frequent")).select(cols), wide, numer, denom))
    turned = met.filter(F.col("gram").isNotNull()).select("gram", F.col("a").alias("doc_id"), "size", "room")
    return met.filter(F.col("gram").isNull()).select("a", "b"), stored(entries.filter("frequent").select(cols).unionByName(turned))


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams): the sets themselves."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for f in frames:
            ids = f.column("doc_id")
            for k in range(0, len(ids), 500):
                sets = [shingle(t.as_py()) for t in f.column("text")[k:k + 500]]
                off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids[k:k + 500], pa.ListArray.from_arrays(pa.array(off), flat)], names=["doc_id", "grams"])

    return _arrow(docs, run, "doc_id long, grams array<long>")


def _bounded(pairs: DataFrame, counts: DataFrame, blocks: int, numer: int, denom: int) -> DataFrame:
    """The pairs whose overlap, at most the sum over blocks of the smaller count, can reach what their sizes need."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            def col(name: str) -> np.ndarray:
                c = np.frombuffer(b"".join(f.column(name).to_pylist()), np.uint8).reshape(-1, blocks).astype(np.int32)
                return np.where(c == 255, 1 << 24, c)

            za, zb = (f.column(n).to_numpy().astype(np.int64) for n in ("za", "zb"))
            ok = np.minimum(col("ca"), col("cb")).sum(1) >= least_overlap(za, zb, numer, denom) if len(za) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(f.column(n).to_numpy()[ok]) for n in ("a", "b")], names=["a", "b"])

    first = pairs.join(counts.select(F.col("doc_id").alias("a"), F.col("size").alias("za"), F.col("counts").alias("ca")), "a")
    return first.join(counts.select(F.col("doc_id").alias("b"), F.col("size").alias("zb"), F.col("counts").alias("cb")), "b").select("a", "b", "za", "zb", "ca", "cb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, own: DataFrame, n: int, blocks: int, numer: int, denom: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    touched = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    counts = own.filter(F.col("set_id").isNotNull()).join(touched, "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("size"), "counts")
    left = stored(_bounded(pairs, counts, blocks, numer, denom))
    ends = stored(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = stored(shingle_sets(docs.join(ends, "doc_id", "left_semi"), n))
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
    overlap = F.size(F.array_intersect("ga", "gb"))
    return both.filter(overlap * (numer + denom) >= (F.size("ga") + F.size("gb")) * numer).select("a", "b")


def links(docs: DataFrame, own: DataFrame, reps: DataFrame, n: int = N, numer: int = NUMER, denom: int = DENOM, wide: int = WIDE, bits: int = MAP_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between documents of different sets that give the same components as all links: of `docs`, whose
    digests are `own`, those with the ids `reps`.

    Texts stay where they are read: what is made of them is joined with the ids, not the texts themselves. Only the
    few documents that need a second look are picked first, by ids stored on their own, so that Spark can tell their size.

    The product of the incidence with its transpose is taken over the first n-grams of each document only
    (linked ones share one of them), rare n-grams first. A column of few documents is multiplied in full.
    Documents of wide columns are ordered once more, by counts of all their n-grams: edits bring rare n-grams, which
    then come first, so that much-edited copies leave no room for the overlap that a link needs.
    A wide column is first multiplied with a few pivots; where that links its documents, they need no further
    pairs; only pairs of documents that are still in different components are listed and bounded.
    Candidates are bounded by the sizes of the sets and of their parts in each block of columns; what is left
    is counted exactly.
    """
    first = prefixes(docs, frequent_map(docs, n, wide, bits, SHARE), n, numer, denom).join(reps, "doc_id", "left_semi")
    narrow, broad = _split_columns(first, wide, numer, denom)
    # pairs that meet in no narrow column lie among the documents of wide ones; there all n-grams are counted
    inner = docs.join(stored(broad.select("doc_id").distinct()), "doc_id", "left_semi")
    narrower, broad = _split_columns(prefixes(inner, frequent_map(inner, n, wide, bits), n, numer, denom), wide, numer, denom)
    pivots = broad.groupBy("gram", F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS)).alias("s")).agg(
        F.min(F.struct((F.col("size") - F.col("room")).alias("rare"), F.hash("doc_id").alias("h"), "doc_id", "size", "room")).alias("p"))
    pivots = stored(pivots.select("gram", "p.doc_id", "p.size", "p.room"))
    star = broad.alias("x").join(pivots.alias("p"), (F.col("x.gram") == F.col("p.gram")) & (F.col("x.doc_id") != F.col("p.doc_id")) & _possible("x", "p", numer, denom)).select(
        F.least("x.doc_id", "p.doc_id").alias("a"), F.greatest("x.doc_id", "p.doc_id").alias("b"))
    pairs = stored(narrow.unionByName(narrower).unionByName(star).distinct())
    found = stored(_verified(pairs, docs, own, n, blocks, numer, denom))
    comp = stored(connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    # entries of wide columns with the component reached so far; columns of one component are done
    tagged = broad.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    tagged = stored(tagged)
    per = tagged.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("c"))
    main = stored(per.groupBy("gram").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1).select("gram", F.col("m.component").alias("main")))
    off = stored(tagged.join(main, "gram").filter(F.col("component") != F.col("main")).select("gram", "doc_id", "size", "room", "component"))
    more = off.alias("x").join(tagged.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & _possible("x", "y", numer, denom)).select(
        F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    more = stored(more.join(pairs, ["a", "b"], "left_anti"))
    return found.unionByName(_verified(more, docs, own, n, blocks, numer, denom))


def components(docs: DataFrame, n: int = N, numer: int = NUMER, denom: int = DENOM, wide: int = WIDE) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs` (doc_id, text, ...).

    Two documents link when the Jaccard similarity of their sets of word n-grams is at least numer/denom; a shorter
    text has its whole sequence as its one n-gram, and an empty or null one links with nothing. Sets are
    held as 64-bit digests. Documents of one set are one node. Rows that repeat a doc_id with other texts are
    linked through that id. Other columns are ignored; an empty table gives an empty result.
    """
    own = stored(shingle_digests(docs, n))
    sets = stored(own.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    edges = links(texts, own, stored(sets.select(F.col("rep").alias("doc_id")).distinct()), n, numer, denom, wide)
    comp = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "rep")
    named = stored(sets.join(comp, "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id")))
    return own.join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, numer: int = NUMER, denom: int = DENOM) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row with the smallest id stays, with all columns.

    Rows are told apart by id and text, so an id that stands on several texts is decided for each of them. Of rows that
    repeat both, one stays. A null id comes after all others; rows of null ids are linked like any other. Null and
    empty texts are linked with nothing, not even each other, and all different rows of them stay. An empty table stays one.
    """
    (key,) = free(docs, "row")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.col("text").isNull())
    own = stored(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id")).groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c")))
    comp = components(docs.select(row.alias("doc_id"), "text"), n, numer, denom).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    both = stored(comp.join(own, "row"))
    first = stored(both.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("keep"), F.count(F.lit(1)).alias("c")))
    gone = stored(lookup(both.select("row", "component"), "component", first.select("component", "keep"), heavy_keys(first, "component", "c")).filter("row <> keep").select(F.col("row").alias(key)))
    left = docs.withColumn(key, row).join(gone, key, "left_anti")
    twice = stored(own.filter("c > 1").select(F.col("row").alias(key)))
    if twice.isEmpty():
        return left.select(*docs.columns)
    once = left.join(twice, key, "left_semi").dropDuplicates([key])
    return left.join(twice, key, "left_anti").unionByName(once).select(*docs.columns)
