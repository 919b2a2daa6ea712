"""Merkle manifest of a dataset by nested-interval labels (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape.llm.common import CRC_SQL, lower_az, stored
from footscape.operators.ranking import ranked

FAN, HEX = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose crc32 of the id this divides are read again with their text lower-cased.
TAMPER = 5


def _cell(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digests(docs: DataFrame, tamper: int = TAMPER) -> DataFrame:
    """(doc_id, grp, leaf, other): the digest of each row, and that of the row as it is read again, null where nothing is
    tampered with. `grp` sorts like the source, null first."""
    digest = lambda text: F.unhex(F.sha2(F.concat(*[_cell(F.col(c)) for c in FIELDS[:-1]], _cell(text)), 256))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % tamper == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"),
                       digest(F.col("text")).alias("leaf"), F.when(hit, digest(lower_az(F.col("text")))).alias("other"))


def _joined(kids: Column, field: str) -> Column:
    return F.array_join(F.transform(kids, lambda k: F.lower(F.hex(k[field]))), "")


def tree(leaves: DataFrame, payload: list[str]) -> list[DataFrame]:
    """The nodes of each group's tree, level by level: (grp, n, lo, hi, text, digest), where a node covers the leaves of
    ranks lo to hi, `text` has its children's digests as hex, one after another, and `digest` is their hash. Level 1 also has
    `kids`, its leaves' payload by rank. A group of one leaf has one node, that leaf.

    A level has a sixteenth of the rows of the one below, and no task gets more than 16 of them for a node.
    """
    span = lambda k: FAN ** k
    kids = F.array_sort(F.collect_list(F.struct("rank", "leaf", *payload)))
    runs = leaves.groupBy("grp", "n", F.floor(F.col("rank") / span(1)).alias("b")).agg(kids.alias("kids"))
    runs = runs.withColumn("text", _joined(F.col("kids"), "leaf"))
    lo, hi = F.col("b") * span(1), F.least(F.col("b") * span(1) + (span(1) - 1), F.col("n") - 1)
    runs = stored(runs.select("grp", "n", lo.alias("lo"), hi.alias("hi"), "text", F.when(F.col("n") == 1, F.col("kids")[0]["leaf"]).otherwise(F.unhex(F.sha2("text", 256))).alias("digest"), "kids"))
    largest = runs.agg(F.max("n")).first()[0] or 0
    levels = [runs]
    while span(len(levels)) < largest:
        k = len(levels)
        wide = levels[-1].filter(F.col("n") > span(k)).select("grp", "n", "lo", "digest", F.floor(F.col("lo") / span(k + 1)).alias("b"))
        up = wide.groupBy("grp", "n", "b").agg(_joined(F.array_sort(F.collect_list(F.struct("lo", "digest"))), "digest").alias("text"))
        lo, hi = F.col("b") * span(k + 1), F.least(F.col("b") * span(k + 1) + (span(k + 1) - 1), F.col("n") - 1)
        levels.append(stored(up.select("grp", "n", lo.alias("lo"), hi.alias("hi"), "text", F.unhex(F.sha2("text", 256)).alias("digest"))))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(grp, leaf): each group's root."""
    out = None
    for k, nodes in enumerate(levels, 1):
        top = nodes.filter(F.col("n") <= FAN ** k) if k == 1 else nodes.filter((F.col("n") <= FAN ** k) & (F.col("n") > FAN ** (k - 1)))
        top = top.select("grp", F.col("digest").alias("leaf"))
        out = top if out is None else out.unionByName(top)
    return out


def _siblings(text: Column, lo: Column, parent_lo: Column, width: int) -> Column:
    """The parent's interval without the child's leaves one interval before it and one behind it: their nodes' digests."""
    at = F.floor((lo - parent_lo) / width)
    return F.struct(F.substring(text, F.lit(1), at * HEX).alias("left"), F.substring(text, (at + 1) * HEX + 1, F.lit(FAN * HEX)).alias("right"))


def descend(levels: list[DataFrame], start: DataFrame, carried: list[str]) -> DataFrame:
    """The nodes of level 1 with `path`, the siblings at each level above them up to the top, then those of `start`
    (grp, path, `carried`), which has each group's own path.

    From the top down, a node meets its parent in the bucket of the parent's level, and is contained in it.
    """
    above = None
    for k in range(len(levels), 0, -1):
        own = levels[k - 1]
        # at the highest level all nodes are tops
        got = own.filter(F.col("n") <= FAN ** k).join(start, "grp")
        if above is not None:
            p = above.select(F.col("grp").alias("p_grp"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("text").alias("p_text"), F.col("path").alias("p_path"), *carried)
            inner = own.filter(F.col("n") > FAN ** k).join(p, (F.col("grp") == F.col("p_grp")) & (F.floor(F.col("lo") / FAN ** (k + 1)) == F.floor(F.col("p_lo") / FAN ** (k + 1)))
                                                         & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
            path = F.concat(F.array(_siblings(F.col("p_text"), F.col("lo"), F.col("p_lo"), FAN ** k)), "p_path")
            got = got.select(*own.columns, "path", *carried).unionByName(inner.select(*own.columns, path.alias("path"), *carried))
        above = got
    return above


def _leaf_paths(levels: list[DataFrame], start: DataFrame, carried: list[str]) -> DataFrame:
    """One row a leaf: (kid, path, `carried`)."""
    runs = descend(levels, start, carried).select("n", "text", "path", *carried, F.posexplode("kids").alias("at", "kid"))
    own = F.struct(F.substring("text", F.lit(1), F.col("at") * HEX).alias("left"), F.substring("text", (F.col("at") + 1) * HEX + 1, F.lit(FAN * HEX)).alias("right"))
    return runs.select("kid", F.when(F.col("n") > 1, F.concat(F.array(own), "path")).otherwise(F.col("path")).alias("path"), *carried)


def manifest(docs: DataFrame, tamper: int = TAMPER) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of `docs` (FIELDS, ...).

    Leaves are digests of the fields; per source, every 16 consecutive ones become a node, and so on up to its subroot;
    the subroots, null source first, likewise up to the root. The proof of a row is the digests of its siblings at every
    level; folding the row as it is read again with them gives the root, unless the row has been tampered with.
    Nulls in any field have a mark of their own. A null id comes first in its source and isn't tampered with. Rows that
    repeat an id come by their leaf; equal rows are leaves of their own, in any order, which changes no digest
    but theirs among each other. Other columns are ignored; an empty table gives an empty result.
    """
    leaves = ranked(stored(leaf_digests(docs, tamper)), ["grp"], ["doc_id", "leaf"])
    levels = tree(leaves, ["doc_id", "other"])
    roots = tops(levels).withColumn("source", F.col("grp")).withColumn("grp", F.lit(""))
    upper = tree(ranked(stored(roots), ["grp"], ["source"]), ["source"])
    start = tops(upper).select("grp", F.col("leaf").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    sources = stored(_leaf_paths(upper, start, ["root"]).select(F.col("kid.source").alias("grp"), F.col("kid.leaf").alias("subroot"), "root", "path"))
    rows = _leaf_paths(levels, sources, ["subroot", "root"])
    hexed = lambda c: F.lower(F.hex(c))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("path", hexed(F.coalesce("kid.other", "kid.leaf")), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    out = rows.select(F.col("kid.doc_id").alias("doc_id"), hexed("kid.leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
                      proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _level_sql(src: str, docs: str, out: str) -> str:
    """From nodes `src` (s, r, d) and rows `docs` (…, s, r, f, proof) to the nodes `out`_n and rows `out`_p one level up."""
    return f"""
{out}_g AS (SELECT s, r // 16 AS q, list(d ORDER BY r) AS ds, max(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM {src}) GROUP BY s, r // 16),
{out}_n AS (SELECT s, q AS r, CASE WHEN c = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {out}_g),
{out}_p AS (SELECT p.* REPLACE (p.r // 16 AS r,
              CASE WHEN g.c = 1 THEN f ELSE sha256(array_to_string(ds[1:r % 16], '') || f || array_to_string(ds[r % 16 + 2:], '')) END AS f,
              CASE WHEN g.c = 1 THEN proof ELSE proof || array_to_string(ds[1:r % 16], '') || array_to_string(ds[r % 16 + 2:], '') END AS proof)
            FROM {docs} p JOIN {out}_g g ON p.s = g.s AND p.r // 16 = g.q)"""


def _oracle(levels: int = 6, upper: int = 4) -> str:
    cell = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(cell(c) for c in FIELDS[:-1])} || {cell(text)})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""{CRC_SQL},
a AS (SELECT doc_id, coalesce('=' || source, '') AS s, {leaf('text')} AS leaf, {leaf(low)} AS other, coalesce(crc(doc_id) % {TAMPER} = 0, false) AS hit FROM documents),
n0_p AS (SELECT doc_id, leaf, s, s AS src, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, CASE WHEN hit THEN other ELSE leaf END AS f, '' AS proof FROM a),
n0_n AS (SELECT s, r, leaf AS d FROM n0_p)""".replace("crc(doc_id)", "c.crc").replace("FROM documents)", "FROM documents LEFT JOIN crcs c USING (doc_id))")]
    for k in range(levels):
        parts.append(_level_sql(f"n{k}_n", f"n{k}_p", f"n{k + 1}"))
    top = f"n{levels}"
    parts.append(f"""
subs AS (SELECT s AS src, d AS subroot, row_number() OVER (ORDER BY s) - 1 AS place FROM {top}_n),
u0_p AS (SELECT p.doc_id, p.leaf, p.src, x.subroot, '' AS s, x.place AS r, p.f, p.proof FROM {top}_p p JOIN subs x USING (src)),
u0_n AS (SELECT '' AS s, place AS r, subroot AS d FROM subs)""")
    for k in range(upper):
        parts.append(_level_sql(f"u{k}_n", f"u{k}_p", f"u{k + 1}"))
    return "WITH " + ",".join(parts) + f"""
SELECT p.doc_id, p.leaf, p.subroot, n.d AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = n.d AS verified
FROM u{upper}_p p, u{upper}_n n"""


#: Right for up to 16 ** 6 rows a source and 16 ** 4 sources.
ORACLE = _oracle()
