import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_minhash import brute as near_brute
from test_substring import brute as passage_brute
from tokenizers import Tokenizer

from shelfmark.llm import mixing


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "minhash_near_dedup":
            assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "substring_dedup":
            assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
    assert len(ids) >= counts[0] >= counts[1] == counts[2] and counts[4] == counts[3]
    assert counts[0] > 0.95 * len(ids)


def test_run_is_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert set(rows.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and rows.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_documents(spark, sf_dir, odd_docs, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, no_docs, sf_dir).collect() == []
    rows = stage(spark, odd_docs, sf_dir).collect()
    lettered = [r for r in odd_docs.collect() if any(c.isalpha() for c in r.text or "")]
    if name == "language_id":
        assert len(rows) <= len(lettered)
    elif name == "minhash_near_dedup":
        assert len([r for r in rows if len(r.text or "") > 100_000]) == 1
    elif name in ("substring_dedup", "bpe"):
        assert len(rows) == odd_docs.count()


def test_stages_match_brute_force(spark, sf_dir, copied, tmp_path):
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        stages[name](spark, docs, sf_dir).write.parquet(str(tmp_path / f"brute-{name}"))
        return spark.read.parquet(str(tmp_path / f"brute-{name}"))

    told = step("language_id", copied)
    assert sorted(r.doc_id for r in told.collect()) == sorted(r.doc_id for r in copied.collect())

    one = step("minhash_near_dedup", told)
    want = {k for k, (_, _, kept) in near_brute(told.collect()).items() if kept}
    assert {r.doc_id for r in one.collect()} == want

    bare = step("substring_dedup", one)
    digests = passage_brute(one.collect())
    before = {r.doc_id: r.text for r in one.collect()}
    assert any(n for _, n, _ in digests.values())
    for r in bare.collect():
        _, gone, sha = digests[r.doc_id]
        assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == sha
        assert gone or r.text == before[r.doc_id]

    mixed = step("mixing", bare)
    con = duckdb.connect()
    con.register("documents", bare.toPandas())
    copies = dict(con.sql(f"SELECT doc_id, copies FROM ({mixing.ORACLE}) WHERE copies > 0").fetchall())
    assert Counter(r.doc_id for r in mixed.collect()) == copies

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in bare.collect()}
    tokens = step("bpe", mixed).collect()
    assert len(tokens) == sum(copies.values())
    for r in tokens:
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert bytes(r.ids) == ids.tobytes() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
