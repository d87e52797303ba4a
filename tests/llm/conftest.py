import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    parts = ["ka", "lo", "mi", "ne", "ru", "ta", "vo", "si", "pe", "dun"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of 2**n letters that polynomial hashes modulo 2**64 confuse."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that operators have to bear: null, empty, blank, odd spaces and letters, very long."""
    rng = random.Random(5)
    long_ = " ".join(words(rng, 60_000))
    return [None, "", "   ", "\t\n\x0b\x0c\r", "one", "a b c d", "a\u00a0b \u2003c", "été ÉTÉ ñ 漢字 🙂", "x" * 5000, "***", "12 34", "<|endoftext|> a<|endoftext|>", "\x1c\x1d y \x85z", "\ud7ff\ue000", long_, long_]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts with null and repeated keys, null sources, and columns with awkward names."""
    rows = [(None if i == 3 else 7 if i in (5, 6) else i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "k", 1.5, i) for i, t in enumerate(odd_texts)]
    rows += rows[4:6]
    return spark.createDataFrame(rows, DOCS + ", key string, score double, component long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def copied(spark):
    """Documents with copies, near copies, shared passages and repeats within a text."""
    rng = random.Random(11)
    texts, base = [], words(rng, 120)
    passage = words(rng, 50)
    for i in range(60):
        texts.append(words(rng, rng.choice([3, 20, 34, 35, 36, 80, 150])))
    for i in range(40):
        near = list(base)
        for _ in range(rng.randint(0, 12)):
            near[rng.randrange(len(near))] = words(rng, 1)[0]
        texts.append(near)
    for i in range(30):
        own = words(rng, 60)
        at = rng.randrange(60)
        texts.append(own[:at] + passage[: rng.choice([34, 35, 50])] + own[at:])
    texts.append(passage + words(rng, 7) + passage)
    texts.append(["again"] * 90)
    texts += [texts[0], texts[5], texts[5]]
    rows = [(i, (" " if i % 2 else "\n").join(t), "en", f"s{i % 4}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(4)
