"""Quality scores: random-indexing word vectors, pooled, and a two-layer network.

A word starts with a sparse ternary index vector that its hash determines, and so does its
shape (letter case, digits and punctuation, with runs collapsed). Words and shapes that
are frequent in the training sample get learned vectors instead: the sum of the index
vectors of their neighbours, of words for a word and of shapes for a shape, rotated by side
and scaled to unit length. A text is pooled over all its words to the mean vector and the mean product of neighbours, which shows
repetition, and a two-layer numpy network maps that to a logit. Its temperature is fitted
on a part of the sample that the network never sees.

Null and empty texts pool to zeros and get a score as well. Labels, language, source and
id are never inputs of a score. A model that had nothing to learn from scores 0.5. Labels
other than 0 and 1 are left out; a key with both counts with both, and rows that repeat a key
are rows of their own. Equal texts get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkernel as tk
from shelfmark.llm.langid import held_out
from shelfmark.llm.shared import ship, tidy

DIM = 32
#: Learned vectors of words and of shapes.
WORDS, SHAPES = 20_000, 4_000
#: Bounds of the training sample: texts of each label, characters of a text.
PER_LABEL, LONGEST = 1_500, 20_000
#: From this score on a text is predicted to be good.
GOOD = 0.7

_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58] = 48
_KIND[65:91] = 65
_KIND[97:123] = 97
_KIND[128:] = 97


def shapes(words: tk.Words) -> np.ndarray:
    """Hash of each word's shape."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    sizes = words.ends - words.starts
    kinds = _KIND[words.data[tk.ranges(words.starts, sizes)]]
    begins = np.cumsum(sizes) - sizes
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[begins] = True
    before = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum(new, out=before[1:])
    starts, ends = before[begins], before[begins + sizes]
    return tk.word_hashes(kinds[new], starts, ends)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Ternary vectors of DIM, half of them zeros, from 64 bits each."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    return (bits[:, :DIM] - bits[:, DIM:]).astype(np.float32) * np.float32(DIM**-0.5)


@dataclass
class Vectors:
    """Learned vectors by sorted hash."""

    keys: np.ndarray
    rows: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = index_vectors(hashes)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            out[known] = self.rows[at[known]]
        return out


def learn_vectors(hashes: np.ndarray, neighbours: np.ndarray, first: np.ndarray, most: int) -> Vectors:
    """Vectors of the `most` frequent hashes that occur twice or more, from their contexts."""
    keys, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.lexsort((keys, -counts))[:most]
    order = np.sort(order[counts[order] > 1])
    place = np.full(len(keys), -1)
    place[order] = np.arange(len(order))
    rows = np.zeros((len(order), DIM), np.float32)
    edge = np.zeros(len(hashes) + 1, bool)
    edge[first] = True
    own = place[back]
    known = np.flatnonzero(own >= 0)
    for shift, turn in ((1, 1), (-1, -1)):
        at = known[~edge[known if shift == 1 else known + 1]]
        for k in range(0, len(at), 100_000):
            some = at[k : k + 100_000]
            np.add.at(rows, own[some], np.roll(index_vectors(neighbours[some - shift]), turn, axis=1))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return Vectors(keys[order], rows / np.maximum(norm, 1e-9))


@dataclass
class Model:
    words: Vectors
    shapes: Vectors
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def pool(self, words: tk.Words) -> np.ndarray:
        """(texts, 2 * DIM + 1): mean vector, mean product of neighbours, log of the length."""
        counts = np.diff(words.first)
        out = np.zeros((len(counts), 2 * DIM + 1))
        out[:, -1] = np.log1p(counts)
        n = len(words.hashes)
        step = n if n <= 4 * tk.BLOCK_WORDS else tk.BLOCK_WORDS  # only a text that is alone is taken in parts
        for a in range(0, n, max(step, 1)):
            some = words.part(a, min(a + step + 1, n))  # with the next part's first word
            v = self.words.of(some.hashes) + self.shapes.of(shapes(some))
            m = min(step, n - a)
            i, j = int(np.searchsorted(words.first, a, side="right")) - 1, int(np.searchsorted(words.first, a + m))
            full = i + np.flatnonzero(counts[i:j])
            at = np.maximum(words.first[full] - a, 0)
            out[full, :DIM] += np.add.reduceat(v[:m], at, axis=0)
            both = np.zeros_like(v[:m])
            both[: len(v) - 1] = v[:-1] * v[1:]
            last = words.first[full + 1] - 1 - a
            both[last[last < m]] = 0
            out[full, DIM:-1] += np.add.reduceat(both, at, axis=0)
        out[:, :DIM] /= np.maximum(counts, 1)[:, None]
        out[:, DIM:-1] /= np.maximum(counts - 1, 1)[:, None]
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.zeros(len(pooled))
        a, b, c, d = self.layers
        return (np.tanh(((pooled - self.mean) / self.scale) @ a + b) @ c + d).ravel()

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, j, words in tk.word_slices(column, lower=True):
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.logits(self.pool(words)) / self.temperature, -30, 30)))
        return out


def gradients(layers: list[np.ndarray], z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the weighted mean cross-entropy of labels y, with a small penalty on the weights, by layer."""
    a, b, c, d = layers
    h = np.tanh(z @ a + b)
    p = 1 / (1 + np.exp(-np.clip((h @ c + d).ravel(), -30, 30)))
    g = ((p - y) * w / w.sum())[:, None]
    back = g @ c.T * (1 - h * h)
    return z.T @ back + 1e-4 * a, back.sum(axis=0), h.T @ g + 1e-4 * c, g.sum(axis=0)


def calibrate(logits: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The temperature, of a fixed ladder, under which such logits fit the labels best."""

    def loss(t: float) -> float:
        return float((np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t) * w).sum())

    return min(np.geomspace(0.25, 8, 61), key=loss)


def fit(texts: list[str], good: np.ndarray, weight: np.ndarray, hidden: int = 24, rounds: int = 400, seed: int = 11) -> Model:
    """A model from texts, labels 0 or 1 and weights, by Adam on weighted cross-entropy."""
    if not len(texts):
        none = Vectors(np.zeros(0, np.uint64), np.zeros((0, DIM), np.float32))
        return Model(none, none, np.zeros(1), np.ones(1), [], 1.0)
    rng = np.random.default_rng(seed)
    column = pa.array(texts, pa.string())
    parts = [(w.hashes, shapes(w), np.diff(w.first)) for _, _, w in tk.word_slices(column, lower=True)]
    hashes, form, counts = (np.concatenate(x) for x in zip(*parts))
    first = np.concatenate([[0], np.cumsum(counts)])
    model = Model(learn_vectors(hashes, hashes, first, WORDS), learn_vectors(form, form, first, SHAPES), np.zeros(1), np.ones(1), [], 1.0)
    x = np.concatenate([model.pool(w) for _, _, w in tk.word_slices(column, lower=True)])
    apart = rng.random(len(x)) < 0.2
    if apart.all() or not apart.any():
        apart[:] = False
    model.mean, model.scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-3
    z, y, w = ((x - model.mean) / model.scale)[~apart], good[~apart], weight[~apart]
    layers = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    for r in range(1, rounds + 1):
        for p_, g_, (m, v) in zip(layers, gradients(layers, z, y, w), state):
            m += 0.1 * (g_ - m)
            v += 0.01 * (g_ * g_ - v)
            p_ -= 0.02 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model.layers = layers
    side = apart if apart.any() else ~apart
    model.temperature = calibrate(model.logits(x[side]), good[side], weight[side])
    return model


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded sample: about PER_LABEL texts of each label by a hash of the key, at most
    LONGEST characters each; weights restore the labels' shares of all labelled rows."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("q")).where(F.col("q").isin(0, 1) & F.col("k").isNotNull() & ~held_out(F.col("k")))
    counts = {r["q"]: r["count"] for r in known.groupBy("q").count().collect()}
    if not counts:
        return [], np.zeros(0), np.zeros(0)
    spot = F.pmod(F.xxhash64(F.lit("quality"), "k"), F.lit(1 << 30))
    chosen = F.lit(False)
    for q, n in counts.items():
        chosen = chosen | ((F.col("q") == q) & (spot < int(min(1.0, PER_LABEL / n) * (1 << 30))))
    ids = known.where(chosen).orderBy(spot, "k", "q").limit(4 * PER_LABEL)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(ids), "k").where(F.char_length("t") <= LONGEST).orderBy("k", "t", "q").limit(4 * PER_LABEL).collect()
    good = np.array([r["q"] for r in rows], float)
    share = {q: n / max(1, int((good == q).sum())) for q, n in counts.items()}
    weight = np.array([share[int(q)] for q in good])
    return [r["t"] for r in rows], good, weight / max(weight.sum(), 1e-9) * len(weight)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, held_out, score, predicted. No shuffle."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for batch in batches:
            scores = model.score(batch.column(1))
            columns = [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array((scores >= GOOD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key), F.col(text).alias("_text"), held_out(F.col(key)).alias("_held_out"))
    return rows.mapInArrow(tidy(run), f"`{key}` {kind}, held_out boolean, score double, predicted int")
