"""Nearest vectors by inner product, by collision-counting hashing (query-aware LSH).

Largest inner product becomes smallest angle by one more coordinate, sqrt(M**2 - |v|**2) with
M the largest norm. Each of up to PROJECTIONS directions (random rotations) has the vectors of a block
sorted by their single projection. A query opens a window around its own projection in each
array; a vector that lies in enough windows has collided often enough to be verified, in double
precision on the original vectors. Windows are widened (virtual rehashing: the arrays stay,
only the bounds move) until a query has at least as many candidates as it wants neighbours.
Of a window that holds more than half of an array, the entries outside are counted instead.

The number of directions, the first width and the collision threshold are fitted on a bounded
sample of rows, to the least work at which TARGET of the sample's true neighbours are verified
and, if that can be, at most MOST of the other rows; every row is indexed. Neighbours of the
sample are taken at the rank that k has among all rows.

Vectors stay where they are read, in blocks of BLOCK; queries travel to them in blocks. Each
pair of blocks gives the query's best k of the block, and those are merged. The search is
approximate; tests hold its recall against brute force.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no
part, nor do those of another length than most (the shorter of equally frequent lengths).
Equal scores are ranked by the smaller vec_id. A row never finds rows of its own vec_id; of
rows that repeat a query's vec_id with another vector, the query is the one with the largest
hash; candidates are rows, so repeated rows are found each. A null vec_id is no query. Finite
components whose products overflow take part: scores are infinite, or not a number, which
ranks last.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.scratch import cut, session_for, shuffle_partitions

PROJECTIONS = 256
SAMPLE = 2048
SAMPLE_QUERIES = 256
#: Shares of a block that a first window may cover.
SHARES = (0.01, 0.03, 0.08, 0.15, 0.25, 0.8, 0.87, 0.93)
TARGET = 0.96
MOST = 0.06
WIDEN = 1.25
BLOCK = 8192
QUERY_BLOCK = 256


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their largest component, and their lengths then; squares stay finite."""
    top = np.abs(vectors).max(1, keepdims=True).astype(np.float64)
    unit = vectors / np.where(top > 0, top, 1)
    return unit, np.sqrt((unit**2).sum(1)) * top[:, 0]


class Hashing:
    """Directions, first half-width of windows, and the collision threshold.

    sample: rows to fit on; largest: the largest absolute component of all rows; rows: their number.
    """

    def __init__(self, sample: np.ndarray, largest: float, k: int, rows: int | None = None, norm: float | None = None, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.largest, width = largest, sample.shape[1] + 1
        sample = sample / largest
        self.norm = float(norm if norm is not None else np.sqrt((sample**2).sum(1).max()))
        turns = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-PROJECTIONS // width))]
        self.directions = np.concatenate(turns, 1)[:, :PROJECTIONS].astype(np.float32)
        sample = sample[(sample != 0).any(1)]
        projected, asked = self.project(sample * largest), self.project(sample[:SAMPLE_QUERIES] * largest, query=True)
        scores = sample[:SAMPLE_QUERIES] @ sample.T
        np.fill_diagonal(scores, -np.inf)
        wanted = max(1, min(round(k * len(sample) / max(rows or 0, len(sample))), len(sample) - 1))
        near = np.argsort(-scores, 1)[:, :wanted]
        far = np.abs(projected[rng.integers(len(sample), size=(64, 32))] - asked[rng.integers(len(asked), size=64), None, :])
        every = np.abs(projected[None] - asked[:32, None]) if len(sample) > 1 else None
        best = (np.inf, 0, float(np.quantile(far, 0.5)), PROJECTIONS)
        for number in (PROJECTIONS // 4, PROJECTIONS // 2, PROJECTIONS):
            for share in SHARES if every is not None else ():
                half = float(np.quantile(far, share))
                hits = (np.abs(projected[near, :number] - asked[:, None, :number]) <= half).sum(2)
                threshold = max(1, int(np.quantile(hits, 1 - TARGET, method="lower")))
                verified = float(((every[:, :, :number] <= half).sum(2) >= threshold).mean())
                work = number * min(share, 1 - share) + 40 * verified + (1000 * verified if verified > MOST else 0)
                best = min(best, (work, threshold, half, number))
        _, self.threshold, self.half, number = best
        self.directions = self.directions[:, :number]

    def project(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            unit, lengths = _scaled(vectors)
            top = np.abs(vectors).max(1).astype(np.float64)
            scaled, last = unit / (lengths / top)[:, None], np.zeros(len(vectors))
        else:
            scaled = vectors / self.largest / self.norm
            last = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        return np.column_stack((scaled, last)).astype(np.float32) @ self.directions


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, hashing: Hashing, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.hashing, self.ids, self.vectors, self.verified = hashing, ids, vectors, 0
        projected = hashing.project(vectors)
        self.order = np.argsort(projected, 0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(projected, self.order.T, 0).T.copy()

    def bounds(self, asked: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of queries begin and end in each array."""
        low = np.array([np.searchsorted(s, x - half, "left") for s, x in zip(self.sorted, asked.T, strict=True)]).T
        high = np.array([np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, asked.T, strict=True)]).T
        return low, high

    def counts(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Collisions of every vector with a query of these windows."""
        if 2 * int((high - low).sum()) <= self.order.size:
            inside = np.concatenate([o[a:b] for o, a, b in zip(self.order, low.tolist(), high.tolist(), strict=True)])
            return np.bincount(inside, minlength=len(self.ids))
        outside = np.concatenate([x for o, a, b in zip(self.order, low.tolist(), high.tolist(), strict=True) for x in (o[:a], o[b:])])
        return len(self.order) - np.bincount(outside, minlength=len(self.ids))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best candidates (ids, scores) of each query; no row of its own id."""
        asked = self.hashing.project(queries, query=True)
        lows, highs = self.bounds(asked, self.hashing.half)
        out = []
        for query, place, me, low, high in zip(queries, asked, own, lows, highs, strict=True):
            other = self.ids != me
            wanted, half = min(k, int(other.sum())), self.hashing.half
            while True:
                found = np.flatnonzero((self.counts(low, high) >= self.hashing.threshold) & other)
                if len(found) >= wanted:
                    break
                if half > 4:  # projections of unit vectors are nearer than that
                    found = np.flatnonzero(other)
                    break
                half = max(half * WIDEN, 1e-3)
                low, high = (x[0] for x in self.bounds(place[None], half))
            self.verified += len(found)
            with np.errstate(over="ignore", invalid="ignore"):
                score = (self.vectors[found].astype(np.float64) * query).sum(1)
            order = np.where(np.isnan(score), -np.inf, score)
            if len(found) > k:
                keep = order >= np.partition(order, len(order) - k)[len(order) - k]
                found, score, order = found[keep], score[keep], order[keep]
            best = np.lexsort((self.ids[found], -order))[:k]
            out.append((self.ids[found[best]], score[best]))
        return out


def _fit(width: int, largest: float, k: int, rows: int, norm: float):
    """The hashing for a sample, which comes as one task's rows; the driver gets only the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) for b in batches]
        if parts:
            yield pa.record_batch([pa.array([pickle.dumps(Hashing(np.concatenate(parts), largest, k, rows, norm))])], ["hashing"])

    return run


def _packed(size: int):
    """Blocks of rows (id, vector) as bytes; one task's rows stay in its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, task, number = [], [], 0, 0

        def flush(n: int) -> pa.RecordBatch:
            every, matrix = np.concatenate(ids), np.concatenate(vectors)
            ids[:], vectors[:] = [every[n:]], [matrix[n:]]
            return pa.record_batch([pa.array([task]), pa.array([number]), pa.array([every[:n].tobytes()]), pa.array([matrix[:n].tobytes()], pa.binary())], ["task", "number", "ids", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task")[0].as_py()
            column = batch.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ids.append(batch.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
            vectors.append(flat.reshape(batch.num_rows, -1))
            while sum(map(len, ids)) >= size:
                yield flush(size)
                number += 1
        if sum(map(len, ids)):
            yield flush(sum(map(len, ids)))

    return run


def _search(hashing, width: int, kind: str, k: int):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for task, number, ids, vectors, q_ids, q_vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (task, number) != last:
                    last, index = (task, number), Index(hashing.value, np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(-1, width))
                own = np.frombuffer(q_ids, np.int64)
                queries = np.frombuffer(q_vectors, kind).reshape(-1, width).astype(np.float64)
                found = index.search(queries, own, k)
                n = [len(x) for x, _ in found]
                yield pa.record_batch([pa.array(np.repeat(own, n)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose vec_id is divisible by ``every``.

    vectors: vec_id and embedding, an array of float or double.
    """
    spark = session_for(vectors)
    kind = {"float": "f4", "double": "f8"}[vectors.schema["embedding"].dataType.elementType.typeName()]
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).where(
        F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    )
    top = F.array_max(F.transform("vector", F.abs)).cast("double")
    widths = usable.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(top).alias("largest")).orderBy(F.desc("n"), "width").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    width, largest, rows = widths[0]["width"], widths[0]["largest"], widths[0]["n"]
    usable = usable.where(F.size("vector") == width)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x.cast("double") / F.lit(largest)) * (x.cast("double") / F.lit(largest)))
    norm = float(usable.agg(F.max(square)).first()[0]) ** 0.5
    chosen = usable.orderBy(F.xxhash64("id", F.lit(3))).limit(SAMPLE).select("vector")
    fitted = chosen.mapInArrow(_fit(width, largest, k, rows, norm), "hashing binary").first()
    hashing = spark.sparkContext.broadcast(pickle.loads(fitted["hashing"]))
    task = F.spark_partition_id().cast("long").alias("task")
    blocks = "task long, number long, ids binary, vectors binary"
    slots = shuffle_partitions(spark)
    stored = usable.select("id", "vector", task).mapInArrow(_packed(BLOCK), blocks).withColumn("slot", F.pmod(F.xxhash64("task", "number"), F.lit(slots)).cast("int"))
    asking = usable.where(F.col("id") % every == 0).groupBy("id").agg(F.max_by("vector", F.xxhash64("vector")).alias("vector"))
    asked = cut(asking.select("id", "vector", task).mapInArrow(_packed(QUERY_BLOCK), blocks))
    asked = asked.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    # never broadcast: the planner doesn't see that every query is repeated for each slot
    met = stored.join(asked.hint("merge"), "slot").select("task", "number", "ids", "vectors", "q_ids", "q_vectors")
    found = met.mapInArrow(_search(hashing, width, kind, k), "query_id long, vec_id long, score double")
    found = found.withColumn("vec_id", F.nullif("vec_id", F.lit(int(np.iinfo(np.int64).min))))
    number = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    order = Window.partitionBy("query_id").orderBy(number.desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
