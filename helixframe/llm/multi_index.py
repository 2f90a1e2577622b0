"""Nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately; an entry's list is its pair of centroids. A
query walks the pairs by summed distance with a heap until the lists that it has passed hold the
asked share of all entries; these entries are ranked again by the exact measure. Every row is indexed;
only the centroids are fitted on a bounded sample. Lists are dealt by the first centroid, and long
ones, as well as many queries of one list, are cut into blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Centroids of a half, rows that the centroids are fitted on, share of the entries that a query reaches.
CENTROIDS, SAMPLE, REACH = 32, 8192, 0.55
#: Entries and queries of a block.
ENTRIES, ASKED = 4096, 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector that is neither null nor zero nor holds null or non-finite components."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def fitted(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows by Lloyd's algorithm, from evenly spread first centres."""
    rows = np.unique(sample, axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(sample, centres)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = sample[own == j].mean(axis=0)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def walked(one: np.ndarray, two: np.ndarray, held: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of centroids by summed distance, until their lists (``held`` entries each) hold ``least``."""
    a, b = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    heap, got, out = [(one[a[0]] + two[b[0]], 0, 0)], 0, []
    while heap and got < least:
        _, i, j = heapq.heappop(heap)
        if n := held[a[i], b[j]]:
            got += n
            out.append((a[i], b[j]))
        if j + 1 < len(b):
            heapq.heappush(heap, (one[a[i]] + two[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (one[a[i + 1]] + two[b[0]], i + 1, 0))
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _best(queries: np.ndarray, ids: np.ndarray, reads: np.ndarray, entries: np.ndarray, entry_ids: np.ndarray, second: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """For each query its ``k`` best of the entries whose second centroid it reads, without itself.

    The product only chooses; scores are summed in one order, so that equal vectors tie.
    """
    for i in range(0, len(queries), 256):
        scores = queries[i : i + 256] @ entries.T
        slack = 1e-9 * (1 + np.abs(scores).max(initial=0))
        scores[~reads[i : i + 256][:, second]] = -np.inf
        for q, own, s in zip(queries[i : i + 256], ids[i : i + 256].tolist(), scores):
            s[entry_ids == own] = -np.inf
            least = np.partition(s, len(s) - k)[len(s) - k] - slack if len(s) > k else -np.inf
            near = np.flatnonzero((s >= least) & (s > -np.inf))
            exact = (entries[near] * q).sum(axis=1)
            for j in np.lexsort((entry_ids[near], -exact))[:k]:
                yield own, int(entry_ids[near[j]]), float(exact[j])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, sample: int = SAMPLE, reach: float = REACH, block: int = ENTRIES, asked: int = ASKED) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest of those that it reaches, by inner product.

    Nearest first, ties to the smaller id. A query does not find rows of its own id. Rows without an
    id, and vectors null, zero, with null or non-finite components, or of another length than most
    sampled ones, take no part. With at most ``k`` entries, all are found. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"].tolist()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not drawn:
        return spark.createDataFrame([], schema)
    lengths = np.bincount([len(v) for v in drawn])
    width = int(lengths.argmax())
    half = (width + 1) // 2
    fit = np.array([v for v in drawn if len(v) == width])
    one, two = fitted(fit[:, :half], centroids), fitted(fit[:, half:], centroids) if width > 1 else np.zeros((1, 0))
    rows = rows.where(F.size("v") == width)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(m[:, :half], one).astype(np.int32)), pa.array(nearest(m[:, half:], two).astype(np.int32))], names=["vec_id", "v", "a", "b"])

    entries = rows.mapInArrow(listed, "vec_id bigint, v array<double>, a int, b int")
    held = np.zeros((len(one), len(two)), np.int64)
    for r in entries.groupBy("a", "b").count().collect():  # at most one row for each pair of centroids
        held[r["a"], r["b"]] = r["count"]
    least = max(k + 1, reach * held.sum())

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), width)
            to_one, to_two = ((c**2).sum(axis=1) - 2 * x @ c.T for x, c in ((m[:, :half], one), (m[:, half:], two)))
            out: list[list] = [[], [], [], []]
            for i, (key, v) in enumerate(zip(b.column(0).to_pylist(), m)):
                lists: dict[int, list[int]] = {}
                for p, q in walked(to_one[i], to_two[i], held, least):
                    lists.setdefault(p, []).append(q)
                for p, q in lists.items():
                    for x, value in zip(out, (key, v, p, q)):
                        x.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int32()))], names=["vec_id", "v", "a", "lists"])

    walks = usable(queries, id_col, vector_col).where(F.size("v") == width).mapInArrow(asking, "vec_id bigint, v array<double>, a int, lists array<int>")
    by_list = {r["a"]: r["count"] for r in walks.groupBy("a").count().collect()}
    parts = {a: (-(-int(held[a].sum()) // block) or 1, -(-by_list.get(a, 0) // asked) or 1) for a in range(len(one))}
    of_entries = F.array(*(F.lit(parts[a][0]) for a in range(len(one))))[F.col("a")]
    of_queries = F.array(*(F.lit(parts[a][1]) for a in range(len(one))))[F.col("a")]
    here = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int")
    left = entries.withColumn("part", here % of_entries).withColumn("turn", F.explode(F.sequence(F.lit(0), of_queries - 1)))
    right = walks.withColumn("turn", here % of_queries).withColumn("part", F.explode(F.sequence(F.lit(0), of_entries - 1)))

    def ranked(_key, held_here: pa.Table, asked_here: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if held_here.num_rows and asked_here.num_rows:
            lists = asked_here["lists"].to_pylist()
            reads = np.zeros((len(lists), len(two)), bool)
            reads[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)] = True
            for found in _best(_matrix(asked_here["v"], width), asked_here["vec_id"].to_numpy(), reads, _matrix(held_here["v"], width), held_here["vec_id"].to_numpy(), held_here["b"].to_numpy(), k):
                for x, v in zip(out, found):
                    x.append(v)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.groupBy("a", "part", "turn").cogroup(right.groupBy("a", "part", "turn")).applyInArrow(ranked, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
