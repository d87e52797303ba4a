import numpy as np
import pyarrow as pa

from shelfmark.llm import embedding

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ok = [r for r in rows if r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    links = {r.vec_id: 0 for r in rows}
    up = {r.vec_id: r.vec_id for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a.vec_id] += 1
                    links[b.vec_id] += 1
                    p, q = root(a.vec_id), root(b.vec_id)
                    up[max(p, q)] = min(p, q)
    return {k: (links[k], root(k), root(k) == k) for k in links}


def table(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in (1, 2, None):
        for _ in range(25):
            v = rng.standard_normal(64)
            for scale in (0.0, 0.0, 0.02, 0.045, 0.05, 0.055, 0.2):
                w = v / np.linalg.norm(v) + rng.standard_normal(64) * scale
                rows.append((k, [float(x) for x in w], label))
                k += 1
    odd = [None, [], [0.0] * 64, [1.0, None], [float("nan")] * 64, [float("inf")] + [0.0] * 63, [1.0, 2.0], [2.0, 4.0], [1e-30] * 64, [3e30] * 64, [-0.0, 1.0], [0.0, 1.0]]
    rows += [(k + i, v, 1) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_matches_brute_force(spark):
    vectors = table(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(vectors).collect()}
    want = brute(vectors.collect())
    assert got == want
    assert sum(n > 0 for n, _, _ in want.values()) > 100


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BUCKET", 2)
    vectors = table(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(vectors).collect()}
    assert got == brute(vectors.collect())


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal(x.shape) * rng.uniform(0, 0.3, (4000, 1))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    _, bits, factors = embedding.encode(x)
    decoded = embedding.decode(bits, factors, 64)
    levels, scales = embedding.rounded(y)
    other = levels * scales[:, None]
    miss = np.einsum("ij,ij->i", decoded, other) - np.einsum("ij,ij->i", x, y)
    assert abs(miss.mean()) < 0.005 and (np.abs(miss) <= embedding.bounds(decoded, factors, scales)).all()
    assert (np.abs(np.einsum("ij,ij->i", decoded, x) - 1) < 1e-9).all()  # a vector's estimate with itself is exact


def test_estimates_spare_exact_vectors(spark):
    """Vectors that share a bucket by chance alone don't go on to the exact round."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1] = x[0] + 0.01 * x[2]
    x[1] /= np.linalg.norm(x[1])
    _, bits, factors = embedding.encode(x)
    levels, scales = embedding.rounded(x)
    n = len(x)
    zeros = np.zeros(n, np.int32)
    columns = [np.full(n, 5), zeros, zeros, zeros, np.arange(n), np.full(n, 64, np.int32), zeros, [v.tobytes() for v in bits], factors, [v.tobytes() for v in levels], scales]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "i", "j", "own", "id", "dim", "band", "bits", "factor", "levels", "scale"])
    out = pa.Table.from_batches(list(embedding._open(0.93)([batch])))
    assert {0, 1} <= set(out["id"].to_pylist()) and out.num_rows < 20


def test_clashing_columns(spark):
    vectors = table(spark).selectExpr("*", "1 AS id", "2 AS n", "3 AS component_id", "4 AS code", "5 AS least")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(vectors).collect()}
    assert got == brute(vectors.collect())


def test_empty_and_null_keys(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = embedding.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, None, None)], SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in rows) == [("4", 2, "4", True), ("4", 2, "4", True), ("None", 0, "None", True), ("None", 2, "4", False)]
