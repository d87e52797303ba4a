"""A compact vector index: eight bits a component in one binary column, searched in scans.

A query set may be as large as a table: :func:`search_all` and :func:`nearest` take it in
blocks of QUERIES rows, each answered by one scan, so the driver holds one block at a time.

:func:`build` makes it, one partition of a model at a time; a caller keeps it with
``cache()`` or as Parquet. :func:`search` answers many queries in one scan: a batch of rows
is one matrix over its Arrow buffer, its product with all queries is one call, and only rows
that can be among a query's first k leave the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that one scan answers.
QUERIES = 2048


def _rounded(x: np.ndarray) -> np.ndarray:
    """Rows at length 127, rounded half away from zero; zero rows stay zero."""
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0) * 127
    return np.clip(np.sign(unit) * np.floor(np.abs(unit) + 0.5), -127, 127).astype(np.int8)


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, code, norm); ValueError if the dimensions of a batch are mixed, or a vector is null."""
    kind = dict(vectors.dtypes)[key]

    def run(batches):
        for batch in batches:
            column, n = batch.column(1), len(batch)
            if not n:
                continue
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            dim = len(flat) // n
            if column.null_count or (column.value_lengths().to_numpy() != dim).any():
                raise ValueError("an index holds vectors of one dimension")
            q = _rounded(flat.reshape(n, dim))
            norm = np.sqrt((q.astype(np.int32) ** 2).sum(axis=1))
            code = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * dim).astype(np.int32)), pa.py_buffer(q.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), code, pa.array(norm)], [key, "code", "norm"])

    return vectors.select(key, vector).mapInArrow(run, f"`{key}` {kind}, code binary, norm double")


def search(index: DataFrame, queries: list[list[float]], k: int, key: str = "vec_id") -> DataFrame:
    """The first k of each query: query (its place), key, score, rank. Ties by key.

    Queries are a constant of the plan, so few enough for that. A zero query finds nothing.
    """
    kind, most = dict(index.dtypes)[key], max(k, 1)
    q = _rounded(np.asarray(queries, dtype=np.float64).reshape(len(queries), -1)).astype(np.float32)
    size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    live = np.flatnonzero(size > 0)

    def run(batches):
        for batch in batches:
            n = len(batch)
            if not n or not len(live):
                continue
            offsets = np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: n + 1]
            data = np.frombuffer(batch.column(1).buffers()[2], np.int8)[offsets[0] : offsets[-1]]
            if len(data) != n * q.shape[1]:
                raise ValueError("queries have another dimension than the index")
            norm = batch.column(2).to_numpy()
            # sums of products of such codes are exact in single precision up to 1,000 components
            dots = (data.reshape(n, -1).astype(np.float32) @ q[live].T).astype(np.float64)
            score = np.round(np.divide(dots, norm[:, None] * size[live], out=np.zeros_like(dots), where=norm[:, None] > 0), 6)
            for c, place in enumerate(live.tolist()):
                s = score[:, c]
                keep = np.arange(n) if n <= most else np.flatnonzero(s >= np.partition(s, n - most)[n - most])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), place, np.int32)), batch.column(0).take(pa.array(keep)), pa.array(s[keep])], ["query", key, "score"])

    found = index.select(key, "code", "norm").mapInArrow(run, f"query int, `{key}` {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, key: str, vector: str):
    """(keys, vectors of one dimension) of at most about QUERIES rows, zero and null ones aside."""
    rows = queries.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    count = rows.count()
    parts = -(-count // QUERIES)
    for b in range(parts):
        by: dict[int, list] = {}
        for r in rows.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == b).orderBy("k").collect():
            by.setdefault(len(r["v"]), []).append((r["k"], r["v"]))
        for own in by.values():
            yield [k for k, _ in own], np.array([v for _, v in own], dtype=np.float64)


def _together(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    out = none
    for part in parts:
        out = out.unionByName(part)
    return out


def search_all(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The first k of the index for each row of `queries`: query (its key), key, score, rank. Ties by key."""
    kind = dict(queries.dtypes)[key]
    parts = []
    for keys, rows in _blocks(queries, key, vector):
        names = queries.sparkSession.createDataFrame(list(enumerate(keys)), f"place int, name {kind}")
        found = search(index, rows.tolist(), k, key).withColumnRenamed("query", "place")
        parts.append(found.join(F.broadcast(names), "place").select(F.col("name").alias("query"), key, "score", "rank"))  # a row a query of the block
    none = queries.select(F.col(key).alias("query"), F.col(key), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    return _together(parts, none)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", others: bool = False) -> DataFrame:
    """The k rows of `vectors` with the largest cosine for each row of `queries`: query, key,
    score, rank, in double precision. Ties by key. others: a query isn't its own answer.

    Rows of another dimension, and null, zero and not finite vectors, are in no answer.
    """
    kind, own = dict(queries.dtypes)[key], dict(vectors.dtypes)[key]
    usable = F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))

    def one(keys, rows) -> DataFrame:
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        dim, most = unit.shape[1], max(k, 1) + others

        def run(batches):
            for batch in batches:
                n = len(batch)
                if not n:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                score = x @ unit.T
                for c, name in enumerate(keys):
                    s = score[:, c]
                    keep = np.arange(n) if n <= most else np.flatnonzero(s >= np.partition(s, n - most)[n - most])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keep)), batch.column(0).take(pa.array(keep)), pa.array(s[keep])], ["query", key, "score"])

        rows = vectors.where(usable & (F.size(vector) == dim)).select(key, vector)
        return rows.mapInArrow(run, f"query {kind}, `{key}` {own}, score double")

    none = queries.select(F.col(key).alias("query"), F.col(key), F.lit(0.0).alias("score")).limit(0)
    found = _together([one(*block) for block in _blocks(queries, key, vector)], none)
    if others:
        found = found.where(F.col("query") != F.col(key))
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fingerprint(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row that tells a table's state: its count, its largest key, and a hash of both."""
    return rows.agg(F.count("*").alias("n"), F.max(key).alias("largest")).withColumn("fingerprint", F.md5(F.concat_ws(":", F.col("n").cast("string"), F.col("largest").cast("string"))))


def append_new(index: DataFrame, vectors: DataFrame, watermark, key: str = "vec_id", vector: str = "embedding", stamp: str = "created_at") -> tuple[DataFrame, bool]:
    """The index brought up to `vectors`, and whether it had to be built anew.

    New are the rows stamped at `watermark` or later that the index doesn't hold. If those and
    what it holds don't come to all rows, some were deleted or missed, and all is built.
    """
    new = vectors.where(F.col(stamp) >= F.lit(watermark)).join(index.select(key), key, "left_anti")
    if new.count() + index.count() != vectors.count():
        return build(vectors, key, vector), True
    return index.unionByName(build(new, key, vector)), False
