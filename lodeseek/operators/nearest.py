"""Nearest rows of many queries by blocks of matrices.

Queries are dealt to blocks of bounded bytes. A block goes to the executors once, as one matrix; each task
multiplies it with its batches of rows and keeps the best rows of each query, so that a task sends at most k
rows a query, however many rows there are. What tasks have kept is ranked by query.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.session import Scratch, materialise, ship_package

#: Bytes of the vectors of one block of queries, and distances that a task holds at a time.
BLOCK_BYTES = 16 << 20
HELD = 4 << 20
#: Places to which distances are rounded: equal vectors get equal distances, whatever batch they stand in.
PLACES = 12


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """One row for each query, one column for each row; a zero vector has cosine distance 1 from all."""
    if metric == "COSINE":
        return 1.0 - _unit(queries) @ _unit(rows).T
    if metric == "DOT":
        return -(queries @ rows.T)
    each = np.empty((len(queries), len(rows)))
    for k, q in enumerate(queries):
        apart = rows - q
        each[k] = np.sqrt((apart * apart).sum(axis=1)) if metric == "EUCLIDEAN" else np.abs(apart).sum(axis=1)
    return each


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if column.null_count or len(flat) % len(column):
        raise ValueError("vectors are null or differ in length")
    return flat.reshape(len(column), -1)


class Best:
    """The k smallest of each of `count` queries so far, ties by key."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.value = [np.zeros(0)] * count
        self.key: list[list] = [[] for _ in range(count)]

    def add(self, keys: list, d: np.ndarray) -> None:
        """d has a row for each query and a column for each key; what is infinite doesn't count."""
        k = min(self.k, d.shape[1])
        if not k:
            return
        # Ties with the k-th stay until keys have decided.
        bound = np.partition(d, k - 1, axis=1)[:, k - 1]
        for q in np.flatnonzero(np.isfinite(d).any(axis=1)):
            own = self.value[q]
            most = min(bound[q], own[-1] if len(own) >= self.k else np.inf)
            near = np.flatnonzero((d[q] <= most) & np.isfinite(d[q]))
            if len(near):
                both = sorted([*zip(own.tolist(), self.key[q]), *((d[q, i], keys[i]) for i in near)])[: self.k]
                self.value[q] = np.array([x for x, _ in both])
                self.key[q] = [x for _, x in both]

    def columns(self) -> tuple[list[int], list, list[float]]:
        """Number of the query, key and value of all that are kept."""
        return (
            [q for q, found in enumerate(self.key) for _ in found],
            [x for found in self.key for x in found],
            [x for found in self.value for x in found.tolist()],
        )


def _blocks(queries: DataFrame, block_bytes: int) -> tuple[int, Iterator[dict]]:
    """How many blocks of about so many bytes of vectors there are, and the blocks, one at a time."""
    scratch = Scratch(queries.sparkSession)
    asked = scratch.write(queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec"), F.col("qscope").cast("string").alias("qscope")), "queries")
    count, width = asked.agg(F.count(F.lit(1)), F.max(F.size("qvec"))).first()
    blocks = max(1, -(-count * 8 * (width or 1) // block_bytes))

    def each() -> Iterator[dict]:
        for b in range(blocks):
            own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
            table = own.toArrow()
            if not len(table):
                continue
            names = {s: i for i, s in enumerate(sorted({s for s in table.column("qscope").to_pylist() if s is not None}))}
            vectors = np.concatenate([_matrix(c) for c in table.column("qvec").chunks if len(c)])
            scopes = np.array([names.get(s, -2) for s in table.column("qscope").to_pylist()])
            yield {"qid": table.column("qid").to_pylist(), "kind": table.schema.field("qid").type, "names": names, "vectors": vectors, "scopes": scopes}
        # The blocks are on the executors now.
        scratch.clear()

    return blocks, each()


def _prepared(rows: DataFrame, several: bool) -> DataFrame:
    rows = rows.select("key", F.col("vec").cast("array<double>").alias("vec"), F.col("scope").cast("string").alias("scope"))
    return materialise(rows, "rows") if several else rows


def _scores(block: dict, batches: Iterator[pa.RecordBatch], metric: str, places: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys of some rows, and their distances from all queries of a block; infinite if out of scope."""
    step = max(1, HELD // max(1, len(block["qid"])))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            scopes = np.array([-1 if s is None else block["names"].get(s, -3) for s in part.column(2).to_pylist()])
            d = np.round(distances(_matrix(part.column(1)), block["vectors"], metric), places) + 0.0
            seen = (scopes[None, :] == -1) | (scopes[None, :] == block["scopes"][:, None])
            yield part.column(0), np.where(seen, d, np.inf)


def nearest_many(
    queries: DataFrame, rows: DataFrame, k: int = 6, max_distance: float = 1.0, metric: str = "COSINE", places: int | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """qid, key, distance, rank of the k nearest rows in scope of each query (qid, qvec, qscope); ties by key (K2, K3).

    All rows are compared with all queries: the result is exact. Distances are rounded to `places` before they
    are ranked. A row without scope is in every scope. Keys must not be null; repeated keys count each. Vectors
    have to be of one length. No queries or no rows give no rows.
    """
    order = Window.partitionBy("qid").orderBy("distance", "key")
    out = _searched(queries, rows, k, metric, PLACES if places is None else places, block_bytes)
    return out.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("distance") <= max_distance))


def all_distances(queries: DataFrame, rows: DataFrame, metric: str = "COSINE", places: int = PLACES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """qid, key and distance of every row in scope from every query of a stated set, in blocks of queries."""
    return _searched(queries, rows, None, metric, places, block_bytes)


def _searched(queries: DataFrame, rows: DataFrame, k: int | None, metric: str, places: int, block_bytes: int) -> DataFrame:
    spark = queries.sparkSession
    ship_package(spark)
    qid, key = (df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (rows, "key")))
    schema = f"qid {qid}, key {key}, distance double"
    count, blocks = _blocks(queries, block_bytes)
    rows = _prepared(rows, count > 1)
    out = None
    for block in blocks:
        near = rows.mapInArrow(_scan(spark.sparkContext.broadcast(block), k, metric, places), schema)
        out = near if out is None else out.unionByName(near)
    return spark.createDataFrame([], schema) if out is None else out


def _scan(shared, k: int | None, metric: str, places: int):
    names = ["qid", "key", "distance"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kind = shared.value, None
        kept = Best(len(block["qid"]), k)
        for keys, d in _scores(block, batches, metric, places):
            kind = keys.type
            kept.add(keys.to_pylist(), d)
        if kind is not None:
            numbers, keys, found = kept.columns()
            yield pa.RecordBatch.from_arrays([pa.array([block["qid"][q] for q in numbers], block["kind"]), pa.array(keys, kind), pa.array(found, pa.float64())], names=names)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        asked = pa.array(block["qid"], block["kind"])
        for keys, d in _scores(block, batches, metric, places):
            q, r = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), keys.take(pa.array(r)), pa.array(d[q, r])], names=names)

    return every if k is None else best
