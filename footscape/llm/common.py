"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footscape.session import stored  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What this Python worker keeps between its tasks: one value at most.
_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """A value that a worker keeps from task to task, until another one is kept there or `forget` is called."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go of what the worker keeps. Workers serve one operator after the other; a task that builds tables of its own
    calls this first, so that they don't come on top of what another operator has left."""
    _KEPT.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names for further columns that `docs` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    more = "_"
    while any((more + n).lower() in taken for n in names):
        more += "_"
    return [more + n for n in names]


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; texts of single-byte characters take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; 0 is held out. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


#: DuckDB: a view-like table crcs (doc_id, crc) with the crc32 of each id as text, to stand first in a WITH.
CRC_SQL = """
crc_bits AS (SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i::UBIGINT) AS v
             FROM range(256) x(i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits),
crcs AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT),
                                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS crc
         FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)"""
