import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from shelfmark.llm import langid, quality
from shelfmark.llm import textkernel as tk


def table(spark, n=400):
    rng = random.Random(3)
    sets = {"xx": ["ka", "lo", "ki", "ra"], "yy": ["the", "ing", "ow", "sh"], "zz": ["é", "ña", "ue", "ció"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(sets))
        w = ["".join(rng.choice(sets[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        good = int(i % 3 > 0)
        text = " ".join(w) if good else " ".join(x + "###" for x in w)
        rows.append((i, text, lang if i % 7 else None, "s", len(text), good))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, start = rng.standard_normal((2, 5, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    lengths = np.array([5, 3])
    post, expected = langid.forward_backward(scores, lengths, moves, start, pairs=True)
    total = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        marginal, norm, pairs = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(start[path[0]] + sum(scores[c, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            norm += p
            for t, y in enumerate(path):
                marginal[t, y] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        assert np.allclose(post[c, :n], marginal / norm)
        total += pairs / norm
    assert np.allclose(expected, total)


def test_language_held_out(spark, odd_docs):
    docs = table(spark)
    model = langid.fit(*langid.sample(docs), chains=300, rounds=25)
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [k for k in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in rows.items() if r.held_out} == set(held)
    known = [k for k in held if lang[k]]
    assert np.mean([rows[k].lang_pred == lang[k] for k in known]) > 0.97
    odd = langid.predict(odd_docs, model, keep=("text",)).collect()
    assert len(odd) == odd_docs.count()
    for r in odd:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1


def test_code_switching_is_seen(spark):
    model = langid.fit(*langid.sample(table(spark)), chains=300, rounds=25)
    mixed = " ".join(["kalora"] * 40 + ["thesheowing"] * 40)
    _, _, words = next(tk.word_slices(pa.array([mixed]), lower=True))
    best = model.sums(words, each=True).argmax(axis=1)
    labels = [model.labels[k] for k in best]
    assert labels[:38] == ["xx"] * 38 and labels[42:] == ["yy"] * 38


def test_a_text_is_one_chain(monkeypatch):
    rng = np.random.default_rng(2)
    n_labels = 3
    texts = [" ".join(f"w{rng.integers(40)}" for _ in range(n)) for n in (1, 300, 5, 64, 65, 700, 0, 128)]
    empty = langid.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), n_labels)
    weights = (rng.standard_normal(((1 << langid.TABLE_BITS) + empty.size, n_labels)) * 0.3).astype(np.float32)
    moves, start = rng.standard_normal((n_labels, n_labels)).astype(np.float32) * 2, rng.standard_normal(n_labels).astype(np.float32)
    model = langid.Model(["a", "b", "c"], empty, weights, moves, start)
    _, _, words = next(tk.word_slices(pa.array(texts)))
    each, scores = model.sums(words, each=True), model.emissions(words).astype(float)
    for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        if b > a:
            want = langid.forward_backward(scores[None, a:b], np.array([b - a]), moves, start)[0]
            assert np.allclose(each[a:b], want, atol=1e-4)
            assert np.allclose(model.sums(words)[k], want.sum(axis=0), rtol=1e-4, atol=1e-3)
    monkeypatch.setattr(langid, "BLOCK", 7)
    monkeypatch.setattr(tk, "BLOCK_WORDS", 50)
    assert np.allclose(model.sums(words, each=True), each, atol=1e-4)


def test_every_language_is_learned(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice(f"{i % 90:02d}xyzuvw") for _ in range(4)) + f"{i % 90:02d}k" for _ in range(30)), f"l{i % 90}") for i in range(720)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = langid.sample(docs)
    assert len(set(langs)) == 90
    few = langid.CHARACTERS
    try:
        langid.CHARACTERS = 90 * 300
        texts, langs = langid.sample(docs)
        assert len(set(langs)) == 90 and sum(map(len, texts)) <= 90 * 300
    finally:
        langid.CHARACTERS = few


def test_affixes_are_letters():
    word = "ñandú漢字".encode()
    data = np.frombuffer(word, np.uint8)
    to, since = langid._affixes(data, np.array([0]), np.array([len(word)]))
    assert word[: to[0]].decode() == "ñan" and word[since[0] :].decode() == "ú漢字"


def test_supplied_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, langid.fit(*langid.sample(docs)), keep=("lang",)).where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_whole_long_text_counts(spark):
    model = langid.fit(*langid.sample(table(spark)), chains=300, rounds=25)
    text = " ".join(["kalora"] * 3000 + ["thesheowing"] * 9000)
    names, scores = model.predict(pa.array([text, None]))
    assert names == ["yy", "und"] and abs(scores[0] - 0.75) < 0.05


def test_quality_held_out(spark, odd_docs):
    docs = table(spark)
    labels = docs.select("doc_id", "quality").where("doc_id % 2 = 0").union(spark.createDataFrame([(None, 1), (3, None), (5, 7)], "doc_id long, quality int"))
    model = quality.fit(*quality.sample(docs, labels))
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    good = {r.doc_id: r.quality for r in docs.collect()}
    held = [k for k, r in rows.items() if r.held_out]
    assert np.mean([rows[k].predicted == good[k] for k in held]) > 0.95
    odd = quality.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)


def test_nothing_to_learn_from(spark, odd_docs, no_docs):
    model = langid.fit(*langid.sample(no_docs))
    assert {(r.lang_pred, r.score) for r in langid.predict(odd_docs, model).collect()} == {("und", 0.0)}
    assert langid.predict(no_docs, model).collect() == []
    blank = langid.fit(["", "  "], ["en", "fr"])
    assert blank.predict(pa.array(["abc", "1"]))[0] == ["en", "und"]
    flat = quality.fit(*quality.sample(no_docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert {(r.score, r.predicted) for r in quality.score(odd_docs, flat).collect()} == {(0.5, 0)}
    assert 0 <= quality.fit(["", ""], np.array([0.0, 1.0]), np.ones(2)).score(pa.array(["", "a b"]))[1] <= 1


def test_words_are_the_pattern(odd_texts):
    import re

    pattern = re.compile("[^\x20\x09-\x0d]+")
    column = pa.array(odd_texts, pa.string())
    for i, j, words in tk.word_slices(column):
        for k in range(i, j):
            a, b = words.first[k - i], words.first[k - i + 1]
            got = [words.data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b])]
            assert got == pattern.findall(odd_texts[k] or "")


def test_equal_windows_have_equal_hashes():
    column = pa.array(["a b c d", "x\ta  b\nc", "b c d"])
    _, _, words = next(tk.word_slices(column))
    h = tk.windows(words.hashes, 3)
    assert h[0] == h[5] and h[1] == h[8] and len({int(x) for x in h[[0, 1, 4]]}) == 3


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 64), (1, 64), (5, 3), (1000, 20), (5000, 44), (5000, 64)):
        values = np.unique(rng.integers(0, 1 << min(bits, 63), n, dtype=np.uint64))
        assert (tk.unpack(tk.pack(values)) == values).all()


def test_pooling_by_hand(monkeypatch):
    texts = ["The cat. The cat!", "", "one", "a b c d e f g h"]
    words = [t.lower().split() for t in texts]
    model = quality.fit(texts * 3, np.array([1.0, 0, 1, 0] * 3), np.ones(12))
    _, _, w = next(tk.word_slices(pa.array(texts), lower=True))
    vector = (model.words.of(w.hashes) + model.shapes.of(quality.shapes(w))).astype(float)
    got = model.pool(w)
    for k, own in enumerate(words):
        v = vector[w.first[k] : w.first[k + 1]]
        mean = [sum(x[d] for x in v) / max(len(own), 1) for d in range(quality.DIM)]
        both = [sum(v[i][d] * v[i + 1][d] for i in range(len(v) - 1)) / max(len(own) - 1, 1) for d in range(quality.DIM)]
        assert np.allclose(got[k], [*mean, *both, np.log(1 + len(own))], atol=1e-5)
    _, _, alone = next(tk.word_slices(pa.array([" ".join(["a", "b!", "C"] * 200)]), lower=True))
    whole = model.pool(alone)
    monkeypatch.setattr(tk, "BLOCK_WORDS", 7)
    assert np.allclose(model.pool(alone), whole, atol=1e-5)


def test_word_vectors_are_their_neighbours():
    _, _, w = next(tk.word_slices(pa.array(["x left y x left y", "x left"])))
    vectors = quality.learn_vectors(w.hashes, w.hashes, w.first, 10)
    index = {h: quality.index_vectors(np.array([h]))[0] for h in w.hashes}
    x, left, y = w.hashes[:3]
    want = 2 * np.roll(index[x], 1) + np.roll(index[x], 1) + 2 * np.roll(index[y], -1)
    assert np.allclose(vectors.of(np.array([left]))[0], want / np.linalg.norm(want), atol=1e-5)


def test_gradients_are_differences():
    rng = np.random.default_rng(8)
    z, y, w = rng.standard_normal((9, 4)), rng.integers(0, 2, 9).astype(float), rng.random(9)
    layers = [rng.standard_normal((4, 3)), rng.standard_normal(3), rng.standard_normal((3, 1)), rng.standard_normal(1)]

    def loss():
        total = 0.0
        for row, label, weight in zip(z, y, w):
            h = [np.tanh(sum(row[i] * layers[0][i, j] for i in range(4)) + layers[1][j]) for j in range(3)]
            p = 1 / (1 + np.exp(-(sum(h[j] * layers[2][j, 0] for j in range(3)) + layers[3][0])))
            total -= weight / w.sum() * (label * np.log(p) + (1 - label) * np.log(1 - p))
        return total + 0.5e-4 * ((layers[0] ** 2).sum() + (layers[2] ** 2).sum())

    for p, g in zip(layers, quality.gradients(layers, z, y, w)):
        for at in np.ndindex(*p.shape):
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - g[at]) < 1e-6
            p[at] = old


def test_temperature_calibrates():
    rng = np.random.default_rng(9)
    logits = rng.standard_normal(4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(quality.calibrate(logits * 3, y, np.ones(4000)) - 3) < 0.4


def test_supplied_held_out_ranking(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(*quality.sample(docs, labels))
    rows = quality.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 50 and np.mean([[g > b for b in bad] for g in good]) > 0.97
