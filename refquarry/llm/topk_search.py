"""Exact top-k inner-product search by columnar branch and bound.

Vectors become whole numbers floor(64 x) in dimension-major blocks.  A block of queries meets a block
of candidates: the dimensions are read a few at a time, each query keeps a running score for every
surviving candidate, and a candidate leaves when its score plus the most that the remaining
dimensions can add (product of the remaining lengths) stays below the query's k-th best.  Survivors
are compacted after each step.

Blocks are packed rows.  Groups of query blocks meet groups of candidate blocks, each pair of groups in
one task of bounded size, so no row of one table is paired with a row of the other; the answer of a
task is k rows a query.  The first group of candidates is searched before the others: the k-th best that
each query has from it is where their search begins to prune.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refquarry.llm.common import Workspace, table

SCALE = 64
QUERY_EVERY = 20
K = 20
#: vectors in a packed block of queries and of candidates; candidate blocks in a group
QUERY_BLOCK, CANDIDATE_BLOCK, GROUP_BLOCKS = 1024, 4096, 4
DIMENSION_BLOCK = 16


def _blocks(size: int):
    """Packs rows (id, whole-number vector, least score that counts or null) into blocks: ids, vectors dimension-major, the length of the longest, and the least scores."""

    def pack(ids, vectors, floors):
        n = max(map(len, vectors))
        m = np.zeros((n, len(ids)), np.int64)
        for c, v in enumerate(vectors):
            m[: len(v), c] = v
        small = np.abs(m).max(initial=0) < 32768
        return np.array(ids, np.int64).tobytes(), (m.astype(np.int16) if small else m).tobytes(), n, bool(small), np.array([-np.inf if f is None else f for f in floors]).tobytes()

    def batch_of(rows):
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["ids", "vectors", "dims", "small", "floors"])

    def run(batches):
        ids, vectors, floors = [], [], []
        for b in batches:
            ids += b.column("id").to_pylist()
            vectors += [np.asarray(v, np.int64) for v in b.column("v").to_pylist()]
            floors += b.column("floor").to_pylist()
            while len(ids) >= size:
                yield batch_of([pack(ids[:size], vectors[:size], floors[:size])])
                ids, vectors, floors = ids[size:], vectors[size:], floors[size:]
        if ids:
            yield batch_of([pack(ids, vectors, floors)])

    return run


def _unpack(row, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    m = np.frombuffer(row["vectors"], np.int16 if row["small"] else np.int64).reshape(row["dims"], len(ids)).astype(np.int64)
    return ids, np.vstack([m, np.zeros((dims - len(m), len(ids)), np.int64)]) if len(m) < dims else m


class Best:
    """k best different (score, id) of each query so far; more score first, then smaller id."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None):
        self.k, self.floors = k, np.full(n, -np.inf) if floors is None else floors
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def limit(self, q: int) -> float:
        return max(self.floors[q], float(self.scores[q][-1])) if len(self.scores[q]) >= self.k else self.floors[q]

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        most = self.k
        while True:
            some_ids, some = ids, scores
            if len(ids) > 4 * most:  # ties at the edge all stay for the exact order below
                edge = np.partition(scores, len(scores) - most)[len(scores) - most]
                some_ids, some = ids[scores >= edge], scores[scores >= edge]
            at = np.lexsort((some_ids, -some))
            some_ids, some = some_ids[at], some[at]
            fresh = np.ones(len(some), bool)
            fresh[1:] = (some_ids[1:] != some_ids[:-1]) | (some[1:] != some[:-1])
            some_ids, some = some_ids[fresh][: self.k], some[fresh][: self.k]
            if len(some) == self.k or len(ids) <= 4 * most:
                break
            most *= 4  # repeated rows stand above the edge; look further down
        self.ids[q], self.scores[q] = some_ids, some


def search_block(best: Best, query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, step: int = DIMENSION_BLOCK) -> None:
    """Adds to `best` what a candidate block (v: dimensions x candidates) offers to each query (q: dimensions x queries)."""
    dims = len(v)
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dims, 1) >= 2**62:
        raise OverflowError("components are too large for scores of 64 bits")
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dims, 1) < 2**52
    qf, vf = (q.astype(float), v.astype(float)) if exact else (q, v)
    cuts = list(range(0, dims, step)) + [dims]
    rest_q, rest_v = (np.array([np.sqrt((m[c:].astype(float) ** 2).sum(axis=0)) for c in cuts[1:]]) for m in (q, v))
    first = qf[: cuts[1]].T @ vf[: cuts[1]] if dims else np.zeros((q.shape[1], v.shape[1]))
    for i in range(q.shape[1]):
        alive, score = None, first[i]
        for b in range(len(cuts) - 1):
            if b:
                part = vf[cuts[b] : cuts[b + 1]]
                score = score + qf[cuts[b] : cuts[b + 1], i] @ (part if alive is None else part[:, alive])
            low = best.limit(i)
            if low > -np.inf:
                bound = score + rest_q[b, i] * (rest_v[b] if alive is None else rest_v[b][alive]) * (1 + 1e-9) + 1e-6
                keep = np.flatnonzero(bound >= low)
                alive, score = keep if alive is None else alive[keep], score[keep]
                if not len(alive):
                    break
        else:
            at = np.arange(v.shape[1]) if alive is None else alive
            other = ids[at] != query_ids[i]
            best.add(i, ids[at][other], np.asarray(score)[other].astype(np.int64))


def _search(k: int):
    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and candidates.num_rows:
            dims = max(*queries.column("dims").to_pylist(), *candidates.column("dims").to_pylist())
            blocks = [_unpack(c, dims) for c in candidates.to_pylist()]
            for row in queries.to_pylist():
                query_ids, q = _unpack(row, dims)
                best = Best(len(query_ids), k, np.frombuffer(row["floors"], float))
                for ids, v in blocks:
                    search_block(best, query_ids, q, ids, v)
                out += [(np.full(len(best.ids[i]), query_ids[i]), best.ids[i], best.scores[i]) for i in range(len(query_ids))]
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query over all rows but its own.

    Components are floor(64 x).  Rows whose id or vector is null, or whose vector holds a null or
    non-finite component, take no part; shorter vectors count as filled up with zeros.  Ties go to the
    smaller id; a vector that stands in several rows is found once; empty tables give no rows.
    Vectors of any length count whole; components so large that a score may pass 62 bits are an error.
    Further columns take no part, whatever their names.
    """

    def whole(df):
        v = F.col(vector_col)
        sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        return df.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"), F.lit(None).cast("double").alias("floor"))

    ws = Workspace(vectors.sparkSession, "topk")
    kind = "ids binary, vectors binary, dims int, small boolean, floors binary"
    candidate = whole(vectors).mapInArrow(_blocks(CANDIDATE_BLOCK), kind)
    n = vectors.count()
    groups = max(1, n // (CANDIDATE_BLOCK * GROUP_BLOCKS))
    parts = max(1, n // (QUERY_EVERY * QUERY_BLOCK * GROUP_BLOCKS))  # groups of query blocks, so that a task holds a bounded number of either
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    if groups > 1:
        candidate = ws.cut(candidate, "candidates")  # read twice, and a block must fall to the same group each time
    candidate = candidate.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn("h", every(parts))

    def meet(asked: DataFrame, where) -> DataFrame:
        blocks = asked.mapInArrow(_blocks(QUERY_BLOCK), kind).withColumn("h", F.pmod(F.xxhash64("ids"), F.lit(parts))).withColumn("g", every(groups))
        return blocks.where(where).groupBy("g", "h").cogroup(candidate.where(where).groupBy("g", "h")).applyInArrow(_search(k), "query_id long, vec_id long, score long").distinct()

    once = meet(whole(queries), F.col("g") == 0)
    if groups > 1:
        once = ws.cut(once, "first")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        floors = once.withColumn("nth", nth).where(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        once = once.union(meet(whole(queries).drop("floor").join(floors, "id", "left").select("id", "v", "floor"), F.col("g") > 0)).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER o)::INT AS rank, vec_id, score FROM s WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 20
"""
