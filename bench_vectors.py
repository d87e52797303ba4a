"""Latency of the compact vector index over 200,000 x 768 made-up vectors, as one line of JSON."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfmark.operators import vector_index  # noqa: E402
from shelfmark.session import local_session  # noqa: E402

ROWS, DIM, K, RUNS, MANY = 200_000, 768, 100, 10, 64


def main() -> None:
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)
    where = tempfile.mkdtemp(prefix="vectors-")

    def make(batches):
        for batch in batches:
            n = len(batch)
            x = np.random.default_rng(int(batch.column(0)[0].as_py())).standard_normal(n * DIM).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * DIM, pa.int32()), pa.array(x))], ["vec_id", "embedding"])

    try:
        spark.range(0, ROWS, 1, cores).mapInArrow(make, "vec_id long, embedding array<float>").write.parquet(f"{where}/vectors")
        vectors = spark.read.parquet(f"{where}/vectors")
        began = time.perf_counter()
        index = vector_index.build(vectors).cache()
        index.count()
        built = time.perf_counter() - began
        queries = np.random.default_rng(1).standard_normal((MANY, DIM)).tolist()
        vector_index.search(index, queries[:1], K).collect()
        began = time.perf_counter()
        for i in range(RUNS):
            assert len(vector_index.search(index, queries[i : i + 1], K).collect()) == K
        one = (time.perf_counter() - began) / RUNS
        began = time.perf_counter()
        assert len(vector_index.search(index, queries, K).collect()) == K * MANY
        many = (time.perf_counter() - began) / MANY
    finally:
        shutil.rmtree(where, ignore_errors=True)
    print(json.dumps({"rows": ROWS, "dim": DIM, "k": K, "build_sec": round(built, 3), "one_query_ms": round(one * 1000, 1), f"ms_a_query_of_{MANY}": round(many * 1000, 1), "cores": cores}))


if __name__ == "__main__":
    main()
