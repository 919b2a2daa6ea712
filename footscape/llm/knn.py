"""Exact top-k by inner product: a Voronoi join with bounds from group summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footscape.llm.common import stored

K, SCALE, EVERY = 5, 256, 50
#: Pivots: a bounded sample of the vectors, those whose ids hash lowest.
PIVOTS = 32
#: Vectors of a group that one task holds; larger groups are split. Queries are dealt out in chunks of that size.
BLOCK_ROWS, QUERY_ROWS = 20_000, 20_000


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): v = floor(scale * x) as longs; vectors that are null or hold null or non-finite components
    are left out, as are rows without an id."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fine = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _exact(m: int, dim: int) -> bool:
    return m * m * max(dim, 1) < 2**53


def scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers: through doubles where they hold every sum, else in integers (modulo 2**64)."""
    m = max(int(np.abs(q).max(initial=0)), int(np.abs(d).max(initial=0)))
    if _exact(m, q.shape[1]):
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    return q @ d.T


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id `every` divides, the `k` others of highest inner product of
    floor(256 x), ties to the smaller id (`vectors` has vec_id, embedding, ...).

    Vectors are grouped by their nearest pivot. A group's summary is its size, its radius, and the smallest distances
    to the pivot of k + 1 different ids: q.p - |q| d bounds the score of such a member from below, q.p + |q| r
    that of any member from above. A query goes to a group only if the upper bound reaches the k-th best of
    its lower bounds, those of its own id aside, so what it leaves out can't be in the answer. Groups are split into blocks of about
    `block_rows` by a hash of the id, so one vector that is a third of all rows is spread. Vectors of another
    length than a query's are no candidates for it. Repeated ids are rows of their own, but never answers to their
    own id. Extra columns are ignored; without vectors there are no rows.
    """
    data = stored(quantised(vectors))
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not sample:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres: dict[int, np.ndarray] = {}
    for r in sample:
        centres.setdefault(r["dim"], []).append(r["v"])
    centres = {dim: np.unique(np.array(v, np.float64).reshape(len(v), dim), axis=0) for dim, v in centres.items()}

    def grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f.assign(cell=0, dist=np.inf)
            for dim, part in f.groupby("dim"):
                c = centres.get(dim)
                if c is None or not dim:
                    continue
                x = np.array(part["v"].tolist(), np.float64)
                d = np.sqrt(np.maximum(((x[:, None, :] - c[None]) ** 2).sum(2) if len(c) * x.size < 1 << 22 else np.stack([((x - p) ** 2).sum(1) for p in c], 1), 0))
                out.loc[part.index, "cell"] = d.argmin(1)
                out.loc[part.index, "dist"] = d.min(1)
            yield out[["vec_id", "dim", "v", "cell", "dist"]]

    cells = stored(data.mapInPandas(grouped, "vec_id long, dim int, v array<long>, cell int, dist double"))
    nearest = cells.groupBy("dim", "cell", "vec_id").agg(F.min("dist").alias("dist"))
    near = nearest.select("dim", "cell", "vec_id", "dist", F.row_number().over(Window.partitionBy("dim", "cell").orderBy("dist", "vec_id")).alias("r")).filter(F.col("r") <= k + 1)
    near = near.groupBy("dim", "cell").agg(F.collect_list(F.struct("dist", "vec_id")).alias("near"))
    summary = cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).join(near, ["dim", "cell"]).collect()
    groups: dict[int, list] = {}
    for r in summary:
        groups.setdefault(r["dim"], []).append((r["cell"], -(-r["n"] // block_rows), r["radius"], sorted((x["dist"], x["vec_id"]) for x in r["near"])))
    n_queries = cells.filter(F.col("vec_id") % every == 0).count()
    chunks = max(1, -(-n_queries // query_rows))

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query to every block of the groups that may hold one of its answers."""
        for f in frames:
            parts = []
            for dim, part in f.groupby("dim"):
                c, gs = centres.get(dim), groups.get(dim, [])
                q = np.array(part["v"].tolist(), np.float64).reshape(len(part), dim)
                if c is None or not dim:
                    need = np.ones((len(part), len(gs)), bool)
                else:
                    dot, size = q @ c[[g[0] for g in gs]].T, np.linalg.norm(q, axis=1)
                    low = np.concatenate([dot[:, [j]] - size[:, None] * np.array([d for d, _ in g[3]])[None] for j, g in enumerate(gs)], axis=1)
                    low[part["vec_id"].to_numpy()[:, None] == np.array([i for g in gs for _, i in g[3]])[None]] = -np.inf
                    bar = np.sort(low, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(part), -np.inf)
                    slack = 1e-6 * (1 + np.abs(dot) + size[:, None] * np.array([g[2] for g in gs])[None])
                    need = dot + size[:, None] * np.array([g[2] for g in gs])[None] + slack >= bar[:, None]
                for j, (cell, blocks, _, _) in enumerate(gs):
                    rows = part[need[:, j]]
                    for b in range(blocks if len(rows) else 0):
                        parts.append(rows.assign(cell=cell, block=b)[["vec_id", "dim", "v", "cell", "block"]])
            if parts:
                yield pd.concat(parts)

    blocks_of = F.create_map(*[x for dim, gs in groups.items() for g in gs for x in (F.lit(f"{dim}/{g[0]}"), F.lit(g[1]))])
    members = cells.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks_of[F.concat_ws("/", "dim", "cell")]).cast("int"))
    members = members.select("vec_id", "dim", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asked = cells.filter(F.col("vec_id") % every == 0).select("vec_id", "dim", "v").mapInPandas(sent, "vec_id long, dim int, v array<long>, cell int, block int")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))

    def solved(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(d["dim"].iloc[0])
        d = d.sort_values("vec_id")
        ids, x = d["vec_id"].to_numpy(), np.array(d["v"].tolist(), np.int64).reshape(len(d), dim)
        out = []
        for at in range(0, len(q), 256):
            part = q.iloc[at:at + 256]
            own = part["vec_id"].to_numpy()
            s = scores(np.array(part["v"].tolist(), np.int64).reshape(len(part), dim), x)
            for row, me in zip(s, own):
                ok = np.flatnonzero(ids != me)
                if len(ok) > k:
                    bar = np.partition(row[ok], len(ok) - k)[len(ok) - k]
                    above, ties = ok[row[ok] > bar], ok[row[ok] == bar]  # ids are sorted: the first ties are the smallest
                    ok = np.concatenate([above, ties[:k - len(above)]])
                out.append(pd.DataFrame({"query_id": me, "vec_id": ids[ok], "score": row[ok]}))
        return pd.concat(out)

    keys = ["dim", "cell", "block", "chunk"]
    local = asked.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(solved, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
