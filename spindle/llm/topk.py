"""Operator 1, exact top-k search by inner product with pivot-table elimination.

Vectors become integers first (``floor(scale * x)``), so scores are exact.
With d(a, b) the Euclidean distance, score(q, x) = (|q|^2 + |x|^2 - d(q, x)^2) / 2,
and for every pivot p: d(q, x) >= |d(q, p) - d(x, p)|.  The largest of these
lower bounds over all pivots gives an upper bound on the score.  Each query
evaluates candidates in the order of that bound and stops as soon as the next
bound is below its k-th best score; nothing else is ever skipped, so the
result is exact whatever the pivots are.

Spark's part: vectors are packed into blocks (candidates with their pivot
distances).  Blocks of queries meet blocks of candidates by an equi-join on
(query block, stripe), sorted so that a task goes through the candidate
blocks of one query block one after another and keeps only k best per query.
Shuffled bytes: candidates x number of query blocks + queries x stripes.
Pivots are chosen farthest-first from a bounded sample (``PIVOT_SAMPLE``
rows); they only affect speed.

Defined results
* null vectors, vectors with null or non-finite components and rows with a
  null id take no part
* repeated ids: the smallest vector (array order) of the id counts
* vectors of unequal length: missing components count as 0
* ties: smaller id first; fewer than k candidates: all of them
* empty table: no rows; other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_schema, read_table, written

N_PIVOTS = 24
PIVOT_SAMPLE = 2000
#: Rows of a candidate block and of a query block; stripes of candidate blocks that one query block meets in separate tasks.
CAND_BLOCK, QUERY_BLOCK, STRIPES = 4096, 1024, 8

BLOCKS = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("vectors", T.BinaryType()),
        T.StructField("dists", T.BinaryType()),
    ]
)
HITS = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) per component; only whole, finite vectors; one per id."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return (
        df.where(F.col(id_col).isNotNull() & x.isNotNull())
        .where(~F.coalesce(bad, F.lit(True)))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _matrix(lists: list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample row farthest from those chosen so far."""
    x = sample.astype(np.float64)
    near = np.full(len(x), np.inf)
    chosen = []
    at = int(np.argmax((x * x).sum(1))) if len(x) else 0
    for _ in range(min(n, len(x))):
        chosen.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(1))
        at = int(np.argmax(near))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    f = x.astype(np.float64)
    out = np.empty((len(pivots), len(f)))
    for i, p in enumerate(pivots):
        out[i] = np.sqrt(((f - p) ** 2).sum(1))
    return out


def _packed(vectors: DataFrame, dim: int, pivots: np.ndarray, rows: int) -> DataFrame:
    """(block, n, ids, vectors, dists) of up to ``rows`` consecutive vectors that share the column ``block``."""
    schema = arrow_schema(BLOCKS)

    def packed(key: int, ids: list, lists: list) -> pa.RecordBatch:
        m = _matrix(lists, dim)
        narrow = np.int16 if np.abs(m).max(initial=0) < 1 << 15 else np.int64
        row = [[key], [len(ids)], [np.asarray(ids, np.int64).tobytes()], [m.astype(narrow).tobytes()], [_distances(m, pivots).astype(np.float32).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, lists = None, [], []
        for b in batches:
            for k, i, v in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if ids and (k != key or len(ids) == rows):
                    yield packed(key, ids, lists)
                    ids, lists = [], []
                key = k
                ids.append(i)
                lists.append(v)
        if ids:
            yield packed(key, ids, lists)

    return vectors.select(F.col("block").cast("int").alias("block"), "vec_id", "v").mapInArrow(run, BLOCKS)


class _Search:
    """The k best of one block of queries over the candidate blocks seen so far."""

    def __init__(self, n: int, ids: bytes, vectors: bytes, dists: bytes, dim: int, k: int) -> None:
        self.ids, self.k, self.n, self.dim = np.frombuffer(ids, np.int64), k, n, dim
        self.q, self.d = self._read(n, vectors, dists)
        self.norm = (self.q.astype(np.float64) ** 2).sum(1)
        self.best_score = [np.empty(0, np.int64)] * n
        self.best_id = [np.empty(0, np.int64)] * n

    def _read(self, n: int, vectors: bytes, dists: bytes) -> tuple[np.ndarray, np.ndarray]:
        kind = np.int16 if len(vectors) == 2 * n * self.dim else np.int64
        return np.frombuffer(vectors, kind).reshape(n, self.dim).astype(np.int64), np.frombuffer(dists, np.float32).reshape(-1, n)

    def _merge(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, v = np.concatenate([self.best_score[i], score]), np.concatenate([self.best_id[i], ids])
        own = v != self.ids[i]
        s, v = s[own], v[own]
        if len(s) > 4 * self.k:  # cheap cut before the sort: ties of the k-th stay
            keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, v = s[keep], v[keep]
        order = np.lexsort((v, -s))[: self.k]
        self.best_score[i], self.best_id[i] = s[order], v[order]

    def meet(self, n: int, ids: bytes, vectors: bytes, dists: bytes) -> None:
        x_id = np.frombuffer(ids, np.int64)
        x, d = self._read(n, vectors, dists)
        f = x.astype(np.float64)
        norm = (f**2).sum(1)
        # Products and sums of integers below 2^53 are exact in double precision; beyond that, integers.
        top = float(np.abs(x).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * self.dim
        qs, xs = (self.q.astype(np.float64), f) if top < 2**53 else (self.q, x)
        slack = np.float32(1e-5) * (1 + max(d.max(initial=0), self.d.max(initial=0)))  # of distances rounded to 24 bits
        step = max(1, (1 << 20) // max(n, 1))
        for lo in range(0, self.n, step):
            hi = min(self.n, lo + step)
            low = np.zeros((hi - lo, n), np.float32)
            for p in range(len(d)):
                np.maximum(low, np.abs(self.d[p, lo:hi, None] - d[p][None, :]), out=low)
            low = np.maximum(low - slack, 0).astype(np.float64)
            upper = (self.norm[lo:hi, None] + norm[None, :] - low**2) / 2
            upper += 1e-3 + 1e-9 * np.abs(upper)
            for i in range(lo, hi):
                self._scan(i, upper[i - lo], qs[i], xs, x_id)

    def _scan(self, i: int, upper: np.ndarray, q: np.ndarray, xs: np.ndarray, x_id: np.ndarray) -> None:
        """Evaluate candidates in bound order, in growing runs, until the next bound is below the k-th score."""
        kth = self.best_score[i][-1] if len(self.best_score[i]) == self.k else -np.inf
        alive = np.flatnonzero(upper >= kth)
        alive = alive[np.argsort(-upper[alive], kind="stable")]
        at, run = 0, 4 * self.k
        while at < len(alive) and upper[alive[at]] >= kth:
            take = alive[at : at + run]
            self._merge(i, np.asarray(xs[take] @ q).astype(np.int64), x_id[take])
            kth = self.best_score[i][-1] if len(self.best_score[i]) == self.k else -np.inf
            at, run = at + run, run * 4

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.best_id]
        cols = [np.repeat(self.ids, n), np.concatenate([*self.best_id, np.empty(0, np.int64)]), np.concatenate([*self.best_score, np.empty(0, np.int64)])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=arrow_schema(HITS))


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row with ``is_query`` (a condition on ``vec_id``)."""
    vectors = written(integer_vectors(df, id_col, vec_col, scale), "topk-vectors")
    dim = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()
    pivots = _choose_pivots(_matrix([r[0] for r in sample], dim), N_PIVOTS)
    queries = vectors.where(is_query)
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    asked = _packed(dealt.repartition("block").sortWithinPartitions("block", "vec_id"), dim, pivots, 2 * QUERY_BLOCK)
    cands = _packed(vectors.withColumn("block", F.lit(0)), dim, pivots, CAND_BLOCK)
    cands = cands.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("ids"), F.lit(STRIPES)).cast("int").alias("stripe"),
        *[F.col(c).alias(f"x_{c}") for c in ("n", "ids", "vectors", "dists")],
    )
    asked = asked.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(STRIPES - 1))))
    # A sort-merge join leaves the pairs of one query block and stripe next to each other.
    pairs = asked.hint("merge").join(cands, ["block", "stripe"]).sortWithinPartitions("block", "stripe", F.xxhash64("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, key = None, None
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("n", "ids", "vectors", "dists", "x_n", "x_ids", "x_vectors", "x_dists", "stripe")]
            for r in range(b.num_rows):
                q, x, stripe = [c[r].as_py() for c in cols[:4]], [c[r].as_py() for c in cols[4:8]], cols[8][r].as_py()
                if search is None or (q[1], stripe) != key:
                    if search is not None:
                        yield search.rows()
                    search, key = _Search(*q, dim, k), (q[1], stripe)
                search.meet(*x)
        if search is not None:
            yield search.rows()

    hits = pairs.mapInArrow(run, HITS)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products over ``embeddings`` for every vector whose id is divisible by 20."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q, v x WHERE q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
