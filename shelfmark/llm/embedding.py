"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A unit vector is rotated at random and reduced to its signs; the code is those bits, and
the correction factor is the inner product of the vector with its own rounded form. With
both, the inner product with another vector is estimated without bias, with a confidence
bound that narrows with the number of bits. The other vector stands there in eight bits a
component, rounded at random, so an estimate needs no exact vector.

Candidates come from the same rotations: BANDS bands of BAND bits, each a key together with
label and dimension, so that rows meet only in a bucket. A pair at the threshold shares no
band with a probability of about 2e-6; closer pairs, far less. Equal vectors of a label are
one class first. Then, in two rounds:

1. codes, factors and rounded vectors of a bucket's classes are compared, and a class goes
   on if the upper bound of some estimate reaches the threshold;
2. exact vectors are sent for those alone, and every pair whose bound reaches the threshold
   is computed exactly, in doubles, in the first band that it shares.

Large buckets are dealt out in pairs of blocks in both rounds; only counts and the edges of
a spanning forest leave them.

A vector that is null, zero, or holds null or non-finite components, or whose label is
null, links with nothing; vectors of different lengths never link. Vectors are classed by
64-bit hashes. Rows that repeat a vec_id are rows of their own, and equal vectors under one
label link. An empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm import textkernel as tk
from shelfmark.llm.shared import Forest, begins, blocked, components, cut, runs, ship, tidy

BAND, BANDS = 16, 96
#: Rotations whose bits serve the estimate, and standard errors of its bound.
ESTIMATE, ERRORS = 4, 6.0
#: Components below which a bound says too little, so that every pair is computed.
LEAST_DIM = 8
#: Pairs compared at a time.
BLOCK = 32_768
#: Classes of a bucket that are compared with one another, or with as many, in one task.
BUCKET = 4096

_ROTATIONS: dict[int, np.ndarray] = {}


def rotations(dim: int) -> np.ndarray:
    """(dim, rotations * dim): random rotations side by side, enough for all bands."""
    if dim not in _ROTATIONS:
        need = max(ESTIMATE, -(-BAND * BANDS // dim))
        rng = np.random.default_rng([dim, 91])
        parts = []
        for _ in range(need):
            q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
            parts.append(q * np.sign(np.diag(r)))
        _ROTATIONS[dim] = np.concatenate(parts, axis=1)
    return _ROTATIONS[dim]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors the BANDS keys of 16 bits, the ESTIMATE rotations' bits, and the correction factors."""
    dim = x.shape[1]
    y = x @ rotations(dim)
    keys = np.packbits(y[:, : BAND * BANDS] > 0, axis=1).view(np.uint16).reshape(len(x), BANDS)
    y = y[:, : ESTIMATE * dim]
    return keys, np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / (ESTIMATE * dim**0.5)


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in eight bits a component, and their scales; rounding is random, so without bias."""
    scale = np.abs(x).max(axis=1) / 127
    dither = np.random.default_rng([x.shape[1], 17]).random(x.shape[1])
    return np.clip(np.floor(x / scale[:, None] + dither), -128, 127).astype(np.int8), scale


def decode(bits: np.ndarray, factors: np.ndarray, dim: int) -> np.ndarray:
    """The vectors whose inner products with others are the estimates of the coded ones'."""
    signs = np.unpackbits(bits, axis=1, count=ESTIMATE * dim).astype(np.float64) * 2 - 1
    return signs @ rotations(dim)[:, : ESTIMATE * dim].T / (ESTIMATE * dim**0.5 * factors)[:, None]


def bounds(decoded: np.ndarray, factors: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """ERRORS standard errors of the estimates for coded vectors and others with such scales."""
    dim = decoded.shape[1]
    if dim < LEAST_DIM:
        return np.full(len(decoded), 4.0)
    spread = np.sqrt(np.maximum(1 - factors**2, 0)) / factors / np.sqrt(ESTIMATE * (dim - 1))
    return ERRORS * np.sqrt(spread**2 + (0.5 * scales) ** 2 * np.einsum("ij,ij->i", decoded, decoded))


def _code(batches):
    names = ["id", "label", "n", "dim", "unit", "code", "bits", "factor", "levels", "scale"]
    for batch in batches:
        if not len(batch):
            continue
        values, offsets = batch.column(3).flatten(), np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
        values = values.to_numpy().astype(np.float64)
        dims = np.diff(offsets)
        raw = {c: np.empty(len(batch), object) for c in ("unit", "code", "bits", "levels")}
        factors, scales = np.zeros(len(batch)), np.zeros(len(batch))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = values[tk.ranges(offsets[at], dims[at])].reshape(len(at), dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            code, bits, factors[at] = encode(x)
            levels, scales[at] = rounded(x)
            for name, rows in (("unit", x), ("code", code), ("bits", bits), ("levels", levels)):
                raw[name][at] = [v.tobytes() for v in rows]
        held = {c: pa.array(list(v), pa.binary()) for c, v in raw.items()}
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(dims, pa.int32()), held["unit"], held["code"], held["bits"], pa.array(factors), held["levels"], pa.array(scales)]
        yield pa.RecordBatch.from_arrays(columns, names)


def _keys(batches):
    for batch in batches:
        if len(batch):
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(batch), BANDS).astype(np.uint64)
            group = tk.mix(batch.column(1).to_numpy().view(np.uint64))
            band = np.arange(BANDS, dtype=np.uint64)
            keys = tk.mix(group[:, None] + ((band << np.uint64(BAND)) | codes) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(batch))), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "band", "id"])


def _pairs(bucket: np.ndarray, block: np.ndarray, alone: np.ndarray):
    """Places (i, j) of the pairs of each bucket, BLOCK at a time; buckets are runs of rows.

    Pairs of one block are only met where the block is `alone`, as everywhere else they come again."""
    live, gap, m = np.arange(len(bucket)), 0, len(bucket)
    while True:
        gap += 1
        live = live[live + gap < m]
        live = live[bucket[live] == bucket[live + gap]]
        if not len(live):
            return
        for s in range(0, len(live), BLOCK):
            i = live[s : s + BLOCK]
            i = i[alone[i] | (block[i] != block[i + gap])]
            yield i, i + gap


def _runs_of(batches, columns: int):
    """(columns, buckets) of rows by key, i and j that have one dimension; the sixth column is the dimension."""
    for part in runs(batches, 3, columns):
        starts = begins(*part[:3])
        bucket = np.repeat(np.arange(len(starts)), np.diff([*starts, len(part[0])]))
        for d in np.unique(part[5]):
            own = np.flatnonzero(part[5] == d)
            yield int(d), [x[own] for x in part], bucket[own]


def _open(threshold: float):
    """The rows that have a pair whose estimate's bound reaches the threshold."""

    def run(batches):
        for d, (key, left, right, block, ids, _, band, bits, factor, levels, scale), bucket in _runs_of(batches, 11):
            decoded = decode(np.frombuffer(b"".join(bits), np.uint8).reshape(len(ids), -1), factor, d)
            other = np.frombuffer(b"".join(levels), np.int8).reshape(-1, d) * scale[:, None]
            goes_on = np.zeros(len(ids), bool)
            most = bounds(decoded, factor, np.full(len(ids), scale.max()))
            for i, j in _pairs(bucket, block, left == right):
                found = np.einsum("ij,ij->i", decoded[i], other[j]) + most[i] >= threshold
                goes_on[i[found]] = goes_on[j[found]] = True
            if goes_on.any():
                columns = [pa.array(x[goes_on]) for x in (key, left, right, block, ids, band)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "i", "j", "own", "id", "band"])

    return run


def _links(threshold: float):
    def run(batches):
        """Rows come by key and blocks. Holds the rows of one pair of blocks besides a batch."""
        for d, (key, left, right, block, ids, _, band, n, unit, code), bucket in _runs_of(batches, 10):
            forest, counts_of, counts = Forest(), [], []
            codes = np.frombuffer(b"".join(code), np.uint16).reshape(-1, BANDS)
            x = np.frombuffer(b"".join(unit), np.float64).reshape(-1, d)
            _, bits, factor = encode(x)
            decoded = decode(bits, factor, d)
            most = bounds(decoded, factor, np.zeros(len(x)))
            for i, j in _pairs(bucket, block, left == right):
                mine = (codes[i] == codes[j]).argmax(axis=1) == band[i]
                i, j = i[mine], j[mine]
                may = np.einsum("ij,ij->i", decoded[i], x[j]) + most[i] >= threshold
                i, j = i[may], j[may]
                good = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[good], j[good]
                if len(i):
                    counts_of += [ids[i], ids[j]]
                    counts += [n[j], n[i]]
                    for a, b in zip(ids[i].tolist(), ids[j].tolist()):
                        forest.join(a, b)
            if counts_of:
                who, back = np.unique(np.concatenate(counts_of), return_inverse=True)
                total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
                up = np.array([forest.root(x) for x in who.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(up), pa.array(total)], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of `vectors`: key, n_links, component_id, kept.

    Links are pairs with equal labels and a cosine of `threshold` or more. Shuffles: keys
    (20 bytes each, BANDS a class); for the buckets of two or more ESTIMATE bits and a byte
    a component; exact vectors for classes with an estimate that leaves the pair open.
    """
    ship(vectors.sparkSession)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.col(label).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    clean = F.transform(vector, lambda x: x + F.lit(0.0).cast("float") if dict(vectors.dtypes)[vector] == "array<float>" else x + F.lit(0.0))
    tag = F.xxhash64(F.col(label))
    rows = vectors.select(F.col(key).alias("vec_id"), tag.alias("label"), F.when(usable, clean).alias("v"))
    rows = rows.withColumn("id", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    classes = rows.where("id is not null").groupBy("id").agg(F.first("label").alias("label"), F.count("*").alias("n"), F.first("v").alias("v"), F.min("vec_id").alias("least"))
    form = "id long, label long, n long, dim int, unit binary, code binary, bits binary, factor double, levels binary, scale double"
    coded = cut(classes.select("id", "label", "n", "v").mapInArrow(tidy(_code), form))
    whole = F.xxhash64("label", "dim")
    keyed = coded.select("id", whole.alias("group"), "code").mapInArrow(tidy(_keys), "key long, band int, id long")
    by_key = Window.partitionBy("key")
    shared = keyed.withColumn("low", F.min("id").over(by_key)).withColumn("high", F.max("id").over(by_key)).where("low < high").select("key", "band", "id")
    shared = cut(blocked(shared, ["key"], "id", BUCKET))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    near = dealt(shared.join(coded, "id").select("key", "i", "j", "own", "id", "dim", "band", "bits", "factor", "levels", "scale"))
    near = near.mapInArrow(tidy(_open(threshold)), "key long, i int, j int, own int, id long, band int")
    exact = dealt(near.join(coded, "id").select("key", "i", "j", "own", "id", "dim", "band", "n", "unit", "code"))
    found = cut(exact.mapInArrow(tidy(_links(threshold)), "a long, b long, n long"))
    groups = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("n").alias("links"))
    info = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    info = info.join(links.withColumnRenamed("a", "id"), "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    info = cut(info.select("id", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("group")))
    least = info.groupBy("group").agg(F.min("least").alias("component_id"))
    info = info.join(least, "group").select("id", "n_links", "component_id")
    out = rows.select("vec_id", "id").join(info, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a) SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN r ON v.vec_id = r.a LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id
"""
