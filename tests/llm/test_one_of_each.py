import random

import corpus_pipeline
from conftest import DOCS, words


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS).repartition(3)
    return sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()), key=str)


def test_one_row_of_each_group(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(words(rng, 80)) for _ in range(3))
    near = a + " end"
    equal = [(1, a, "s"), (1, a, "s"), (1, a, "r")]
    assert _kept(spark, equal) == [(1, a, "r")]
    assert _kept(spark, [(5, a, "s"), (7, near, "s"), (7, b, "s")]) == [(5, a, "s"), (7, b, "s")]
    assert _kept(spark, [(None, a, "s"), (None, a, "s"), (None, c, "s")]) == sorted([(None, a, "s"), (None, c, "s")], key=str)
    assert _kept(spark, [(None, a, "s"), (9, near, "s")]) == [(9, near, "s")]
    assert _kept(spark, [(None, "", "s"), (None, "", "s"), (None, "*", "s")]) == [(None, "", "s"), (None, "*", "s")]
