"""Language identification by a linear-chain conditional random field over words.

A text's words are one chain, whatever its length. A word's features are hashed into one
table: character bigrams and trigrams with word borders, prefixes and suffixes of AFFIX
letters, and two of a lexicon, the words that are frequent in the training sample: the
word's own entry, and the language that it mostly stands in. Transitions are learned on
code-switched chains that are spliced from texts of different languages, and
forward-backward gives each word a posterior; a text's language is the one with the largest
mean posterior, the first by name of equal ones, and that mean is its score.

Chains are computed in blocks of BLOCK words side by side. What a block does to the chain
is a matrix of labels by labels, so the messages that enter each block from both ends come
from products of those, and posteriors are those of the whole chain.

A null text, or one without a letter, is ``und`` with score 0. Language and source are
never features. Where there is nothing to learn from, every text is ``und``. Equal texts get
equal labels; rows that repeat a key are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm import textkernel as tk
from shelfmark.llm.shared import ship, tidy

#: Rows of the feature table.
TABLE_BITS = 16
#: Letters of prefixes and suffixes.
AFFIX = 3
#: Words of a block.
BLOCK = 128
#: Words of the lexicon, the most frequent ones of the training sample that occur twice or more.
LEXICON = 20_000
#: Bounds of the training sample: texts for each language, characters of a text, and
#: characters together, which all languages share alike.
PER_LANGUAGE, LONGEST, CHARACTERS = 300, 20_000, 16_000_000
#: Languages up to which their counts are broadcast.
NAMES = 10_000

_LETTER = regex.compile(r"\p{L}")
# Letters are folded to lower case, other ASCII to one value; bytes above 127 stay.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[:128] = 2
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def held_out(key: Column) -> Column:
    """Rows that models never learn from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _affixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of each word's first AFFIX letters, and starts of its last ones, as byte places.

    A letter of UTF-8 begins at a byte that doesn't continue one."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = np.searchsorted(at, starts)
    last = np.searchsorted(at, ends)
    bound = np.append(at, len(data))
    return np.minimum(bound[np.minimum(first + AFFIX, len(at))], ends), np.maximum(bound[np.maximum(last - AFFIX, 0)], starts)


def _features(words: tk.Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of each word, flat, and where each word's begin."""
    starts, ends = words.starts.astype(np.int64), words.ends.astype(np.int64)
    sizes = ends - starts
    # each word with a border value on both sides
    at = np.cumsum(sizes + 2) - (sizes + 2)
    padded = np.ones(int((sizes + 2).sum()) + 2, np.uint64)
    body = words.data[tk.ranges(starts, sizes)]
    padded[tk.ranges(at + 1, sizes)] = _CLASS[body]
    shift = np.uint64(64 - TABLE_BITS)
    two = ((padded[:-1] * np.uint64(256) + padded[1:]) * _SALTS[0]) >> shift
    three = ((padded[:-2] * np.uint64(65536) + padded[1:-1] * np.uint64(256) + padded[2:]) * _SALTS[1]) >> shift
    folded = _CLASS[body].astype(np.uint8)
    begin = np.cumsum(sizes) - sizes
    to, since = _affixes(body, begin, begin + sizes)
    pre = (tk.word_hashes(folded, begin, to) * _SALTS[2]) >> shift
    post = (tk.word_hashes(folded, since, begin + sizes) * _SALTS[3]) >> shift
    entry, place = lexicon.rows(words.hashes)
    per = sizes + 1 + sizes + 4
    first = np.cumsum(per) - per
    out = np.empty(int(per.sum()), np.int64)
    out[tk.ranges(first, sizes + 1)] = two[tk.ranges(at, sizes + 1)]
    out[tk.ranges(first + sizes + 1, sizes)] = three[tk.ranges(at, sizes)]
    out[first + per - 4], out[first + per - 3], out[first + per - 2], out[first + per - 1] = pre, post, entry, place
    return out, first


@dataclass
class Lexicon:
    """Words by sorted hash, with the label that each mostly stands in.

    Its features have rows of their own behind the hashed table: one for each word, one for
    each label that a word speaks for, and one for words that aren't known."""

    keys: np.ndarray
    labels: np.ndarray
    n_labels: int

    @property
    def size(self) -> int:
        return len(self.keys) + self.n_labels + 1

    def rows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = 1 << TABLE_BITS
        none = base + len(self.keys) + self.n_labels
        entry = np.full(len(hashes), none)
        label = entry.copy()
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            entry[known] = base + at[known]
            label[known] = base + len(self.keys) + self.labels[at[known]]
        return entry, label


def learn_lexicon(hashes: np.ndarray, label: np.ndarray, n_labels: int) -> Lexicon:
    """The LEXICON most frequent words that occur twice or more, from words and their labels."""
    keys, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    chosen = np.lexsort((keys, -counts))[:LEXICON]
    chosen = np.sort(chosen[counts[chosen] > 1])
    by = np.stack([np.bincount(back[label == k], minlength=len(keys)) for k in range(n_labels)], axis=1)
    share = by / np.maximum(by.sum(axis=0), 1)
    return Lexicon(keys[chosen], share[chosen].argmax(axis=1), n_labels)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False, ahead: np.ndarray | None = None, behind: np.ndarray | None = None):
    """Posteriors of padded chains, longest first; with `pairs` also summed expected moves.

    scores: (chains, words, labels) log potentials. moves[a, b]: from a to b. Chains that
    are parts of longer ones get the messages at their ends: `ahead`, of the labels at the
    first word, instead of `start`, and `behind`, of those at the last word.
    """
    chains, steps, labels = scores.shape
    psi = np.exp(scores - scores.max(axis=2, keepdims=True))
    go, first = np.exp(moves - moves.max()), np.exp(start - start.max())
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains with a word at each step
    alpha = np.empty_like(psi)
    alpha[:, 0] = psi[:, 0] * (first if ahead is None else ahead)
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        k = live[t]
        if not k:
            break
        a = (alpha[:k, t - 1] @ go) * psi[:k, t]
        alpha[:k, t] = a / a.sum(axis=1, keepdims=True)
    post = np.zeros_like(psi)
    beta = np.ones((chains, labels), psi.dtype) if behind is None else behind.copy()
    expected = np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        g = alpha[:k, t] * beta[:k]
        post[:k, t] = g / g.sum(axis=1, keepdims=True)
        if t:
            after = psi[:k, t] * beta[:k]
            if pairs:
                before = alpha[:k, t - 1]
                norm = np.einsum("ka,ab,kb->k", before, go, after)
                expected += np.einsum("ka,kb->ab", before / norm[:, None], after) * go
            beta[:k] = after @ go.T
            beta[:k] /= beta[:k].sum(axis=1, keepdims=True)
    return (post, expected) if pairs else post


def block_matrices(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(blocks, labels, labels): what each padded block, longest first, makes of the message
    of the labels at the word before it, up to a factor."""
    blocks, steps, labels = scores.shape
    psi = np.exp(scores - scores.max(axis=2, keepdims=True))
    go = np.exp(moves - moves.max()).astype(psi.dtype)
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")
    out = go[None] * psi[:, 0, None, :]
    for t in range(1, steps):
        k = live[t]
        if not k:
            break
        m = (out[:k].reshape(-1, labels) @ go).reshape(k, labels, labels) * psi[:k, t, None, :]
        out[:k] = m / m.max(axis=(1, 2), keepdims=True)
    return out


def block_heads(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(blocks, labels): the message of the labels at the last word of blocks that begin chains."""
    psi = np.exp(scores - scores.max(axis=2, keepdims=True))
    go = np.exp(moves - moves.max())
    alpha = psi[:, 0] * np.exp(start - start.max())
    live = np.searchsorted(-lengths, -np.arange(scores.shape[1]), side="left")
    for t in range(1, scores.shape[1]):
        k = live[t]
        a = (alpha[:k] @ go) * psi[:k, t]
        alpha[:k] = a / a.sum(axis=1, keepdims=True)
    return alpha / alpha.sum(axis=1, keepdims=True)


def messages(matrices: np.ndarray, counts: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block of chains of `counts` blocks the messages at its first and last word.

    A first block has no move into it: its matrix has equal rows, its own message (:func:`block_heads`).
    """
    labels = len(start)
    go = np.exp(moves - moves.max())
    ahead = np.empty((len(matrices), labels), matrices.dtype)
    behind = np.ones((len(matrices), labels), matrices.dtype)
    first = np.cumsum(counts) - counts
    alpha = np.full((len(counts), labels), 1 / labels)
    order = np.argsort(-counts, kind="stable")
    live_at = [order[: int(np.searchsorted(-counts[order], -t, side="left"))] for t in range(int(counts.max(initial=0)))]
    for t, chains in enumerate(live_at):
        at = first[chains] + t
        ahead[at] = np.exp(start - start.max()) if t == 0 else alpha[chains] @ go
        alpha[chains] = np.einsum("ka,kab->kb", alpha[chains], matrices[at])
        alpha[chains] /= alpha[chains].sum(axis=1, keepdims=True)
    beta = np.ones((len(counts), labels))
    for t in range(len(live_at) - 1, -1, -1):
        chains = live_at[t]
        at = first[chains] + t
        behind[at] = beta[chains]
        beta[chains] = np.einsum("kab,kb->ka", matrices[at], beta[chains])
        beta[chains] /= beta[chains].sum(axis=1, keepdims=True)
    return ahead / ahead.sum(axis=1, keepdims=True), behind


@dataclass
class Model:
    labels: list[str]
    lexicon: Lexicon
    weights: np.ndarray  # (2**TABLE_BITS + the lexicon's, labels)
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, words: tk.Words) -> np.ndarray:
        """Log potentials of each word; features of a repeated word are summed once."""
        if not len(words.hashes):
            return np.zeros((0, len(self.labels)), np.float32)
        _, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        ids, first = _features(tk.Words(words.data, words.starts[at], words.ends[at], words.first, words.hashes[at]), self.lexicon)
        out = np.empty((len(at), len(self.labels)), np.float32)
        cuts = [0, *np.searchsorted(first, np.arange(tk.BLOCK_WORDS, len(ids), tk.BLOCK_WORDS)).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                e = first[b] if b < len(first) else len(ids)
                out[a:b] = np.add.reduceat(self.weights[ids[first[a] : e]], first[a:b] - first[a], axis=0)
        return out[back]

    def sums(self, words: tk.Words, each: bool = False) -> np.ndarray:
        """(texts, labels): summed posteriors of the words; with `each`, (words, labels): each one's."""
        counts = np.diff(words.first)
        parts = -(-counts // BLOCK)
        text = np.repeat(np.arange(len(counts)), parts)
        place = tk.ranges(np.zeros(len(counts), np.int64), parts)
        begins = words.first[:-1][text] + place * BLOCK
        lengths = np.minimum(words.first[1:][text] - begins, BLOCK)
        n, step, wide = len(words.hashes), 1024, len(self.labels)
        whole = self.emissions(words) if n <= 4 * tk.BLOCK_WORDS else None

        def run(i: int, work):
            """work(scores, lengths, blocks, places) for `step` blocks from i on, padded and longest first."""
            b, size = begins[i : i + step], lengths[i : i + step]
            a, z = int(b[0]), int(b[-1] + size[-1])
            own = self.emissions(words.part(a, z)) if whole is None else whole[a:z]  # a long text's are made twice rather than kept
            order = np.argsort(-size, kind="stable")
            index = np.minimum(b[order][:, None] + np.arange(int(size.max())), z - 1)
            work(own[index - a], size[order], order + i, index)

        matrices = np.ones((len(begins), wide, wide), np.float32)

        def learn(scores, size, blocks, _):
            long_ = parts[text[blocks]] > 1
            scores, size, blocks = scores[long_], size[long_], blocks[long_]
            if not len(blocks):
                return
            matrices[blocks] = block_matrices(scores, size, self.moves)
            head = np.flatnonzero(place[blocks] == 0)
            if len(head):  # a chain begins: no move into it
                matrices[blocks[head]] = block_heads(scores[head], size[head], self.moves, self.start)[:, None, :]

        several = (parts > 1).any()
        if several:
            for i in range(0, len(begins), step):
                run(i, learn)
            ahead, behind = messages(matrices, parts, self.moves, self.start)
        out = np.zeros((n, wide), np.float32) if each else np.zeros((len(counts), wide))

        def tell(scores, size, blocks, index):
            ends = (ahead[blocks], behind[blocks]) if several else (None, None)
            post = forward_backward(scores, size, self.moves, self.start, False, *ends)
            if each:
                inside = np.arange(scores.shape[1]) < size[:, None]
                out[index[inside]] = post[inside]
            else:
                np.add.at(out, text[blocks], post.sum(axis=1, dtype=np.float64))

        for i in range(0, len(begins), step):
            run(i, tell)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a column."""
        names: list[str] = []
        scores = np.zeros(len(column))
        if not self.labels:
            return ["und"] * len(column), scores
        for i, j, words in tk.word_slices(column, lower=True):
            mean = self.sums(words) / np.maximum(np.diff(words.first), 1)[:, None]
            best = mean.argmax(axis=1)
            for k in range(i, j):
                text = column[k].as_py()
                if text and _LETTER.search(text):
                    names.append(self.labels[best[k - i]])
                    scores[k] = min(1.0, mean[k - i, best[k - i]])
                else:
                    names.append("und")
        return names, scores


def fit(texts: list[str], langs: list[str], chains: int = 3000, steps: int = 48, rounds: int = 40, seed: int = 7) -> Model:
    """A model from labelled texts, by maximum likelihood with Adam on code-switched chains."""
    labels = sorted(set(langs))
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), len(labels))
    none = Model(labels, empty, np.zeros(((1 << TABLE_BITS) + empty.size, len(labels)), np.float32), np.zeros((len(labels),) * 2, np.float32), np.zeros(len(labels), np.float32))
    if not labels:
        return none
    rng = np.random.default_rng(seed)
    data, offsets = tk.buffers(pa.array(texts, pa.string()))
    words = tk.split(data, offsets, lower=True)
    of_text = np.array([labels.index(x) for x in langs])
    if not len(words.hashes):
        return none
    _, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    lang_of = np.repeat(of_text, np.diff(words.first))
    pools = [np.flatnonzero(lang_of == k) for k in range(len(labels))]
    usable = [k for k, p in enumerate(pools) if len(p)]
    if not usable:
        return none
    word, gold = np.empty((chains, steps), np.int64), np.empty((chains, steps), np.int64)
    for c in range(chains):
        t = 0
        while t < steps:
            k = usable[rng.integers(len(usable))]
            n = min(steps - t, int(rng.geometric(1 / 24)))
            s = int(rng.integers(len(pools[k])))
            take = pools[k][(s + np.arange(n)) % len(pools[k])]
            word[c, t : t + n], gold[c, t : t + n] = back[take], k
            t += n
    used, word = np.unique(word, return_inverse=True)
    at, word = at[used], word.reshape(chains, steps)
    lexicon = learn_lexicon(words.hashes, lang_of, len(labels))
    ids, first = _features(tk.Words(words.data, words.starts[at], words.ends[at], words.first, words.hashes[at]), lexicon)
    owner = np.repeat(np.arange(len(at)), np.diff([*first, len(ids)]))
    L, size = len(labels), (1 << TABLE_BITS) + lexicon.size
    w, moves, start = np.zeros((size, L)), np.zeros((L, L)), np.zeros(L)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, moves, start)]
    truth = np.eye(L)[gold]
    flat = word.ravel()
    seen = np.zeros((L, L))
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    lengths = np.full(chains, steps)
    for r in range(1, rounds + 1):
        scores = np.add.reduceat(w[ids], first, axis=0)[word]
        post, expected = forward_backward(scores, lengths, moves, start, pairs=True)
        miss = (truth - post).reshape(-1, L)
        per_word = np.stack([np.bincount(flat, miss[:, k], len(at)) for k in range(L)], axis=1)
        up = np.stack([np.bincount(ids, per_word[owner, k], size) for k in range(L)], axis=1)
        grads = (up / chains - 1e-4 * w, (seen - expected) / chains, miss.reshape(truth.shape)[:, 0].mean(axis=0))
        for x, g, (m, v) in zip((w, moves, start), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
    return Model(labels, lexicon, w.astype(np.float32), moves.astype(np.float32), start.astype(np.float32))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts of every language: at most about PER_LANGUAGE of
    each by a hash of the key, of at most LONGEST characters, or fewer and shorter ones with
    many languages, so that all together have CHARACTERS at most, or one text a language."""
    known = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & ~held_out(F.col("k")))
    counts = known.groupBy("l").count().select(F.col("l").alias("name"), "count")
    total = counts.count()
    if not total:
        return [], []
    share = max(CHARACTERS // total, 200)
    spot = F.pmod(F.xxhash64(F.lit("langid"), "k"), F.lit(1 << 30))
    few = known.where(F.char_length("t") <= min(LONGEST, share)).withColumn("spot", spot)
    few = few.join(F.broadcast(counts) if total <= NAMES else counts, F.col("l") == F.col("name"))
    few = few.where(F.col("spot") < F.greatest(F.lit(PER_LANGUAGE) / F.col("count"), F.lit(0.0)) * (1 << 30))
    drawn = Window.partitionBy("l").orderBy("spot", "k", "t")
    few = few.withColumn("place", F.row_number().over(drawn)).withColumn("upto", F.sum(F.char_length("t")).over(drawn.rowsBetween(Window.unboundedPreceding, 0)))
    few = few.where((F.col("place") <= 2 * PER_LANGUAGE) & ((F.col("upto") <= share) | (F.col("place") == 1)))
    rows = few.orderBy("spot", "k", "t").select("t", "l").collect()
    return [r["t"] for r in rows], [r["l"] for r in rows]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: key, `keep` columns, held_out, lang_pred, score. No shuffle."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)
    fields = ", ".join([f"`{key}` {kinds[key]}", *(f"`{c}` {kinds[c]}" for c in keep), "held_out boolean, lang_pred string, score double"])
    also = [c for c in keep if c != text]

    def run(batches):
        for batch in batches:
            names, scores = model.predict(batch.column(1))
            kept = dict(zip([text, *also], [batch.column(1), *batch.columns[3:]]))
            columns = [batch.column(0), *(kept[c] for c in keep), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [key, *keep, "held_out", "lang_pred", "score"])

    # the text travels once, also where it is to be kept
    rows = docs.select(F.col(key), F.col(text).alias("_text"), held_out(F.col(key)).alias("_held_out"), *[F.col(c).alias(f"_keep_{c}") for c in also])
    return rows.mapInArrow(tidy(run), fields)
