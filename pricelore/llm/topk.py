"""Exact top-k by inner product over an impact-ordered index, score at a time.

Within a block of vectors each component is quantised to levels of one width, and the postings of a level, the rows and
components that have it on either side of zero, are one segment. Segments are taken by descending level, for many queries at
once: each adds its postings' quantised impacts to their rows' scores. Each row also has the squared length of what its
scores leave out: components of segments not yet taken, and what quantisation cuts off. By Cauchy and Schwarz that length times
the query's bounds what is missing from a score. Exact scores of the rows that lead give a floor for the k-th best, and so do
the blocks that a task has answered before; once the bounds prove that few rows reach the floor, a query stops, and those
rows are scored again exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of

SCALE = 1024
#: Levels on each side of zero.
LEVELS = 10
#: A query stops when at most one row in so many can still be among the best: to score those again is quicker than to go on.
RESCORE = 48
#: Queries that go through a block's segments together.
TOGETHER = 128
#: Vectors in one index. Bytes of queries in one broadcast; more queries make more passes over the table.
BLOCK_ROWS, QUERY_BYTES = 16_384, 32_000_000


class ImpactIndex:
    """Segments of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors, self.levels = vectors, levels
        n = len(vectors)
        self.step = max(1, int(np.abs(vectors).max())) / levels if vectors.size else 1.0
        self.level = np.rint(vectors / self.step).astype(np.int8)
        self.length2 = (vectors.astype(float) ** 2).sum(axis=1)
        self.longest = float(np.sqrt(self.length2.max())) if n else 0.0

    def segment(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The level's postings as a matrix of impacts, and by how much they change the square of what scores leave out."""
        at = np.abs(self.level) == level
        value = np.where(at, self.level * self.step, 0.0)
        change = np.where(at, value * (value - 2.0 * self.vectors), 0.0).sum(axis=1)
        return value.astype(np.float32), change

    def best(self, queries: np.ndarray, k: int, floors: np.ndarray, without: list[tuple[int, np.ndarray]]):
        """Of each query its place and the rows that may be among the k of highest score and reach its floor: all that are, and few
        others. Rows paired with a query in `without` take no part for it."""
        n = len(self.vectors)
        weights, floors = queries.astype(np.float32), floors.astype(float)
        lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        # Scores are of single precision: what that may cost comes on top of the bounds.
        blur = 1e-5 * lengths * self.longest + 1e-3
        score = np.zeros((len(queries), n), np.float32)
        for q, rows in without:
            score[q, rows] = -np.inf
        left, live = self.length2.copy(), np.arange(len(queries))
        for level in range(self.levels, 0, -1) if n > 4 * k else ():
            impacts, change = self.segment(level)
            score += weights[live] @ impacts.T
            left += change
            if level > self.levels // 2:
                continue
            missing = np.sqrt(np.maximum(left, 0.0)).astype(np.float32)
            lead = np.argpartition(score, n - k, axis=1)[:, n - k :]
            sure = np.isfinite(np.take_along_axis(score, lead, axis=1)).all(axis=1)
            for at in np.flatnonzero(sure):
                floors[live[at]] = max(floors[live[at]], float((self.vectors[lead[at]] @ queries[live[at]]).min()))
            bound = score + lengths[live].astype(np.float32)[:, None] * (missing * np.float32(1 + 1e-5))[None, :]
            possible = bound >= (floors[live] - blur[live])[:, None]
            few = possible.sum(axis=1) <= max(4 * k, n // RESCORE)
            if level == 1:
                few[:] = True
            for at in np.flatnonzero(few):
                yield int(live[at]), np.flatnonzero(possible[at])
            live, score = live[~few], score[~few]
            if not len(live):
                return
        for at in range(len(live)):
            yield int(live[at]), np.flatnonzero(score[at] > -np.inf)


def _whole(vector, scale: int):
    """floor(scale * x) of each component, or None if the vector takes no part."""
    if vector is None:
        return None
    x = np.array([np.nan if c is None else c for c in vector], float)
    return np.floor(x * scale).astype(np.int64) if np.isfinite(x).all() else None


def _padded(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(dims, len(v))] = v[:dims]
    return out


def _query_blocks(queries: DataFrame, id_col: str, vector_col: str, scale: int, query_bytes: int):
    ids, vectors, held = [], [], 0
    for i, v in queries.select(id_col, vector_col).toLocalIterator():
        v = _whole(v, scale)
        if v is None or i is None:
            continue
        ids.append(i)
        vectors.append(v)
        held += 8 * (len(v) + 1)
        if held >= query_bytes:
            yield np.array(ids, np.int64), _padded(vectors, max(map(len, vectors)))
            ids, vectors, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), _padded(vectors, max(map(len, vectors)))


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: for each query the k rows of df of the highest integer inner products, ties to
    the smaller id; all, if there are fewer. An empty table, or no query, gives no rows.

    Rows that are null, have a null id or hold null or non-finite components take no part. A vector shorter than another
    counts as filled up with zeros. A query is not compared with rows of its own id; repeated rows are each ranked. Of queries with
    equal ids the one with the smallest vector, in the order of arrays, counts. Products are exact while they stay within a long.
    Queries reach the executors in blocks of bounded size, and every block of the table is indexed where it lies; what
    is shuffled are k rows at most for a query and a task. Other columns are not looked at.
    """
    context = df.sparkSession.sparkContext
    asking = queries.select(F.col(f"`{id_col}`").cast("bigint").alias("__id"), F.col(f"`{vector_col}`").alias("__vector")).filter(F.col("__id").isNotNull() & F.col("__vector").isNotNull())
    asking = asking.filter(F.forall("__vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))).groupBy("__id").agg(F.min("__vector").alias("__vector"))
    passes = []
    for block in _query_blocks(asking, "__id", "__vector", scale, query_bytes):
        shared = context.broadcast(block)

        def run(batches, shared=shared):
            schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
            query_ids, query_vectors = shared.value
            place = {i: at for at, i in enumerate(query_ids.tolist())}
            #: Of each query the best rows of the blocks before: ids and scores.
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in place]

            def answer(ids, vectors):
                dims = max(query_vectors.shape[1], *map(len, vectors), 1)
                ids, own = np.array(ids, np.int64), _padded(vectors, dims)
                index = ImpactIndex(own)
                asked = _padded(list(query_vectors), dims)
                inside = place.keys() & set(ids.tolist())
                without = [(place[i], np.flatnonzero(ids == i)) for i in inside]
                for at in range(0, len(held), TOGETHER):
                    floors = np.array([s[-1] if len(s) == k else -np.inf for _, s in held[at : at + TOGETHER]], float)
                    mine = [(q - at, rows) for q, rows in without if at <= q < at + TOGETHER]
                    for q, rows in index.best(asked[at : at + TOGETHER], k, floors, mine):
                        v, s = held[at + q]
                        v, s = np.concatenate((v, ids[rows])), np.concatenate((s, own[rows] @ asked[at + q]))
                        best = np.lexsort((v, -s))[:k]
                        held[at + q] = v[best], s[best]

            ids, vectors, some = [], [], False
            for b in batches:
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    v = _whole(v, scale)
                    if v is not None and i is not None:
                        ids.append(i)
                        vectors.append(v)
                while len(ids) >= block_rows:
                    answer(ids[:block_rows], vectors[:block_rows])
                    ids, vectors, some = ids[block_rows:], vectors[block_rows:], True
            if ids:
                answer(ids, vectors)
                some = True
            for at in range(0, len(held) if some else 0, 5_000):
                part = held[at : at + 5_000]
                own = np.repeat(query_ids[at : at + 5_000], [len(v) for v, _ in part])
                yield batch_of(schema, [pa.array(own), pa.array(np.concatenate([v for v, _ in part])), pa.array(np.concatenate([s for _, s in part]))])

        passes.append(df.select(F.col(f"`{id_col}`").cast("bigint").alias("__id"), F.col(f"`{vector_col}`").alias("__vector")).mapInArrow(run, "query_id long, vec_id long, score long"))
    if not passes:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
