from conftest import DOCS, thue_morse

from shelfmark.llm import minhash

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows):
    sets = {}
    for r in rows:
        w = (r.text or "").encode().translate(FOLD).split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def test_matches_brute_force(copied):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(copied).collect()}
    want = brute(copied.collect())
    assert got == want
    assert sum(not kept for _, _, kept in want.values()) > 10


def test_large_groups_in_blocks(copied, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "LARGE", 4)
    monkeypatch.setattr(minhash, "BUCKET", 3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(copied).collect()}
    assert got == {k: v[1] for k, v in brute(copied.collect()).items()}


def test_large_buckets_row_by_row():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, minhash.POSITIONS).astype(np.uint16)
    rows = []
    for i in range(200):
        sig = base.copy()
        at = rng.permutation(len(sig))[: 10 if i < 150 else 60]
        sig[at] = rng.integers(0, 1 << 16, len(at))
        rows.append((5, 0, 0, i, i, 100, sig.tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(7)], ["key", "i", "j", "id", "component", "n", "signature"])
    edges = [(a, b) for out in minhash._apart([batch]) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert len(edges) == 149 and all(b < 150 for _, b in edges)


def test_odd_rows(odd_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0
    assert by[0].kept and by[1].kept and by[1].component_id == 1
    assert by[15].component_id == 14 and not by[15].kept
    assert by[4].n_shingles == 1


def test_empty(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []


def test_words_that_weak_hashes_confuse(spark):
    rows = [(i, word, "en", "s", 0) for i, word in enumerate(thue_morse(10))]
    assert sorted(r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == [0, 1]


def test_sets_of_one_id_are_told_apart(copied, monkeypatch):
    ids = minhash._ids
    monkeypatch.setattr(minhash, "_ids", lambda flat, first: ids(flat, first) & ~0x7FFFFFFFFFFFFFF8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(copied).collect()}
    assert got == {k: v[1] for k, v in brute(copied.collect()).items()}


def test_signatures_in_blocks(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    flat, first = rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.array([0, 0, 3, 200, 201, 201, 500, 500])
    whole = minhash.signatures(flat, first)
    monkeypatch.setattr(minhash.tk, "BLOCK_WORDS", 7)
    assert whole.shape == (4, minhash.POSITIONS) and (minhash.signatures(flat, first) == whole).all()
