import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import DOCS, thue_morse

from shelfmark.llm import substring


def brute(rows, window=35):
    split = {r.doc_id: (r.text or "").encode().split() for r in rows}
    seen = Counter(tuple(w[i : i + window]) for w in split.values() for i in range(len(w) - window + 1))
    out = {}
    for key, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[key] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window", [35, 20, 5, 1])
def test_matches_brute_force(copied, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(copied, window=window).collect()}
    want = brute(copied.collect(), window)
    assert got == want
    assert any(n for _, n, _ in want.values())


def test_kept_text_and_columns(copied):
    rows = substring.dedup(copied, with_text=True, keep=("source",)).collect()
    assert {r.source for r in rows} == {"s0", "s1", "s2", "s3"}
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and len(r.kept_text.split()) == r.n_words - r.n_removed for r in rows)


def test_odd_rows(odd_docs):
    rows = substring.dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.n_removed for r in rows if r.n_words > 1000) == [60_000, 60_000]
    assert all(r.n_words == 0 and r.n_removed == 0 for r in rows if r.doc_id in (0, 1, 2))


def test_empty(no_docs):
    assert substring.dedup(no_docs).collect() == []


def test_words_that_weak_hashes_confuse(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{word} {rest}", "en", "s", 0) for i, word in enumerate(thue_morse(10))]
    assert [r.n_removed for r in substring.dedup(spark.createDataFrame(rows, DOCS)).collect()] == [0, 0]


def test_equal_first_hashes_are_told_apart():
    one, two = np.array([3, 3, 3, 9], np.uint64), np.array([1, 5, 8, 2], np.uint64)
    h, h2 = np.array([3, 3, 3, 9, 9, 4], np.uint64), np.array([8, 6, 1, 2, 3, 1], np.uint64)
    assert substring._known(h, lambda i: h2[i], one, two).tolist() == [True, False, True, True, False, False]


def test_more_groups_for_more_bytes(spark, copied, monkeypatch, tmp_path):
    copied.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    few = substring.groups(docs)
    monkeypatch.setattr(substring, "GROUP_BYTES", 1000)
    assert substring.groups(docs) > few
    assert substring.groups(docs.limit(5)) >= 1
