"""Exact dedup by digest, with heavy digests split off (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footscape.llm.common import free, lower_az, stored

#: Digests that the frequent-items sketch follows, and the most winners that are broadcast (about 50 bytes each).
TRACKED, WINNERS = 4096, 512
#: A candidate is a winner when its exact count is at least this share of all rows.
HEAVY_SHARE = 1 / 1000


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(lower_az(F.coalesce(text, F.lit(""))), 256))


def _grouped(docs: DataFrame, tracked: int, winners: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored digests of all rows (doc_id, d, rid); the heavy ones (d, group_size, keep); and the rows of the others with
    their group (doc_id, d, rid, group_size, keep)."""
    digests = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("d"), F.monotonically_increasing_id().alias("rid")))
    row = F.struct("doc_id", "rid")
    items = digests.select(F.hex("d").alias("d")).agg(F.expr(f"approx_top_k(d, {winners}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n"))
    candidates = items.select(F.explode("top").alias("t"), "n").select(F.unhex(F.col("t.item")).alias("d"), "n")
    heavy = (digests.join(F.broadcast(candidates), "d").groupBy("d", "n").agg(F.count(F.lit(1)).alias("group_size"), F.max(row).alias("keep"))
             .filter((F.col("group_size") > 1) & (F.col("group_size") >= F.col("n") * share)).select("d", "group_size", "keep"))
    heavy = stored(heavy)
    w = Window.partitionBy("d")
    rest = digests.join(F.broadcast(heavy.select("d")), "d", "left_anti").select(
        "*", F.count(F.lit(1)).over(w).alias("group_size"), F.max(row).over(w).alias("keep"))
    return digests, heavy, rest


def exact_groups(docs: DataFrame, tracked: int = TRACKED, winners: int = WINNERS, share: float = HEAVY_SHARE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs` (doc_id, text, ...).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the
    row with the largest doc_id stays (a null id is the smallest; of rows that repeat an id, one stays).
    A Misra-Gries sketch (Spark's frequent-items aggregate) names candidates, an exact count verifies them,
    and the at most `winners` verified ones are broadcast, so that their rows are settled where they are
    read. No key of the shuffle that is left holds more than max(1/winners, share) of the rows or so.
    Further columns of `docs` are ignored; an empty table gives an empty result.
    """
    digests, heavy, rest = _grouped(docs, tracked, winners, share)
    settled = digests.join(F.broadcast(heavy), "d")
    both = settled.select("doc_id", "d", "rid", "group_size", "keep").unionByName(rest)
    return both.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.rid") == F.col("rid")).alias("kept"),
                       F.lower(F.hex("d")).alias("text_sha256"))


def drop_copies(docs: DataFrame, tracked: int = TRACKED, winners: int = WINNERS, share: float = HEAVY_SHARE) -> DataFrame:
    """One row of each text: that with the largest doc_id (a null id is the smallest; of rows that repeat an id, one); all
    columns stay.

    Rows are told apart by id and digest: those whose id isn't their group's largest go, and of a largest id that stands
    on several rows of a text, one is taken by an aggregate, which reduces them where they are read.
    """
    _, heavy, rest = _grouped(docs, tracked, winners, share)
    own_id, own, big, keep, lost_id, lost_d, again = free(docs, "id", "d", "heavy", "keep", "lost_id", "lost_d", "again")
    lost = stored(rest.filter(F.col("keep.rid") != F.col("rid")).groupBy(F.col("doc_id").alias(lost_id), F.col("d").alias(lost_d))
                  .agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))).alias(again)))
    marked = docs.select("*", F.col("doc_id").cast("long").alias(own_id), _digest(F.col("text")).alias(own))
    marked = marked.join(F.broadcast(heavy.select(F.col("d").alias(big), F.col("keep.doc_id").alias(keep))), F.col(own) == F.col(big), "left")
    light = marked.filter(F.col(big).isNull())
    same = F.col(own_id).eqNullSafe(F.col(lost_id)) & F.col(own).eqNullSafe(F.col(lost_d))
    once = marked.filter(F.col(big).isNotNull() & F.col(own_id).eqNullSafe(F.col(keep)))
    repeats = lost.filter(again)
    if not repeats.isEmpty():
        once = once.unionByName(light.join(repeats, same, "left_semi"))
    return light.join(lost, same, "left_anti").unionByName(once.dropDuplicates([own])).select(*docs.columns)


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS d
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY d) AS keep_id, count(*) OVER (PARTITION BY d) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY d) AS kept, d AS text_sha256
FROM t
"""
