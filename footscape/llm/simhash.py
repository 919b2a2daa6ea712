"""SimHash near-duplicates by multi-index hashing: small Hamming balls within each segment of a fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape.llm.common import stored
from footscape.operators.components import connected_components, heavy_keys, lookup

N, SEED, DISTANCE = 3, 42, 2
#: Segments of a fingerprint; within DISTANCE, one of them differs in at most RADIUS bits.
SEGMENTS = 2
RADIUS = DISTANCE // SEGMENTS
WIDTH = 64 // SEGMENTS
#: A bucket of a segment's value with more fingerprints than this is crowded: its pairs are linked in another way.
CROWDED = 64
#: Words hashed at once; a longer text is taken in parts.
PART_WORDS = 1 << 18


def fingerprint(raw: bytes, n: int = N) -> int:
    """The signed 64-bit fingerprint of a text in UTF-8: a bit is set if it is in over half of the shingles' XXH64."""
    words = raw.lower().split()  # of bytes: A-Z only, and white space of 20 and 09-0D
    if not words:
        return 0
    k = min(n, len(words))
    ones, total = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, total, PART_WORDS):
        part = words[at:at + PART_WORDS + k - 1]
        text = b" ".join(part)
        end = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        start = (end - np.fromiter(map(len, part), np.int64, len(part)) - 1)[:len(part) - k + 1].tolist()
        h = [xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(start, (end[k - 1:] - 1).tolist())]
        ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text; a null one counts as empty."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), pa.array([fingerprint(t.as_py() or b"", n) for t in f.column("text")], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments() -> Column:
    """The values of a fingerprint's segments, by place."""
    return F.array(*[F.shiftrightunsigned("fp", k * WIDTH).bitwiseAND((1 << WIDTH) - 1) for k in range(SEGMENTS)])


def _ball(value: Column) -> Column:
    """The values at most RADIUS (1) bits away that are not smaller: of two values one bit apart, one looks the other up."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
    return F.concat(F.array(value), F.filter(F.transform(bits, lambda b: value.bitwiseOR(b)), lambda v: v != value))


def links(known: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints `known` (fp) that connect all within `distance` (2) bits of each other, and
    no others.

    Each segment's values are a table of buckets. A fingerprint looks up every value of a small ball around its own
    segment; what it meets is verified by the whole distance. Fingerprints that meet a crowded bucket don't list its
    pairs: they are connected through the values one bit away. Two are within two bits exactly if they have such
    a value (or one of themselves) in common, and no value has more than 65 fingerprints.
    """
    own = known.select("fp", F.posexplode(_segments()).alias("seg", "value"))
    full = stored(own.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > crowded).select("seg", "value"))
    probes = known.select("fp", F.posexplode(_segments()).alias("seg", "own")).select("fp", "seg", F.explode(_ball(F.col("own"))).alias("value"))
    table = own.select("seg", "value", F.col("fp").alias("other"))
    if not full.isEmpty():
        table = table.join(full, ["seg", "value"], "left_anti")
    met = probes.join(table, ["seg", "value"]).filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    edges = met.select(F.least("fp", "other").alias("src"), F.greatest("fp", "other").alias("dst")).distinct()
    if full.isEmpty():
        return edges
    many = stored(probes.join(full, ["seg", "value"], "left_semi").select("fp").distinct())
    near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    middle = many.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("middle")).groupBy("middle").agg(F.min("fp").alias("src"), F.collect_set("fp").alias("all"))
    star = middle.select("src", F.explode("all").alias("dst")).filter("src <> dst").distinct()
    return edges.unionByName(star)


def near_duplicates(docs: DataFrame, n: int = N, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of `docs` (doc_id, text, ...).

    Rows whose fingerprints are within `distance` bits are linked; component_id is the smallest doc_id that links reach.
    Null and empty texts have the fingerprint zero and are linked like any other. Rows of one fingerprint are one node,
    so repeated rows and copies make no pairs. A null id is nobody's smallest one; a component of null ids has a
    null component_id. Other columns are ignored; an empty table gives an empty result.
    """
    own = stored(fingerprints(docs, n))
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("c")))
    comp = stored(connected_components(links(nodes.select("fp"), distance, crowded)))
    least = stored(comp.join(nodes, comp["node"] == nodes["fp"]).groupBy("component").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("c")))
    linked = lookup(comp, "component", least.select("component", "least"), heavy_keys(least, "component", "c")).select(F.col("node").alias("fp"), "least")
    named = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id")))
    return lookup(own, "fp", named, heavy_keys(nodes, "fp", "c")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
