import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def same(library, text):
    codec = bpe.codec(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(codec, text) == want, text[:80]
    assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(library, odd_texts):
    for text in odd_texts:
        same(library, text or "")


def test_every_space_and_some_of_every_block(library):
    for lo in range(0, 0x11000, 7):
        chars = "".join(chr(c) for c in range(lo, lo + 7) if not 0xD800 <= c < 0xE000)
        same(library, f"a{' '.join(chars)} b{chars}'s")
    for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8208), 8232, 8233, 8239, 8287, 12288, 65279]:
        same(library, f"x{chr(c)}y {chr(c)}{chr(c)} z{chr(c)}")


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abtheing  '\n\t.,<|>endoftext12é漢🙂\u00a0"), max_size=60))
def test_any_text(text):
    t = Tokenizer.from_file(PATH)
    same(t, text)


def test_long_words(library):
    rng = random.Random(1)
    for n in (255, 256, 257, 3000):
        same(library, "".join(rng.choice("theingon") for _ in range(n)))
    codec = bpe.codec(PATH)
    parts = [codec.single[b] for b in ("".join(rng.choice("abcdthe") for _ in range(400))).encode()]
    assert codec._scan(list(parts)) == codec._heap(list(parts))


def test_supplied_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, PATH).collect():
        want = np.array(library.encode(text[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest() and bytes(r.ids) == want.tobytes()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_latin_words_are_the_words():
    rng, wide = random.Random(3), regex.compile(bpe.WORD).findall
    latin = re.compile(bpe.LATIN_WORD).findall
    for _ in range(5000):
        text = "".join(chr(rng.choice((rng.randrange(256), 32, 39, 115))) for _ in range(rng.randrange(14)))
        assert latin(text) == wide(text)


def test_forgotten_words_are_encoded_alike(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 6)
    small, whole = bpe.Codec(PATH), bpe.codec(PATH)
    words = [f" {a}{b}" for a in "theing" for b in ("and", "ion", "er", "x")]
    for word in words + words[::-1] + words:
        assert small[word] == whole[word] and len(small) + len(small.older) <= 6


def test_rows(odd_docs, no_docs):
    rows = bpe.encode(odd_docs, PATH, ids=False).collect()
    assert len(rows) == odd_docs.count() and "ids" not in rows[0].asDict()
    assert bpe.encode(no_docs, PATH).collect() == []
