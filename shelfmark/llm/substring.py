"""Substring deduplication by fixed-block anchors.

Reference blocks of BLOCK words are indexed where they do not overlap, and every rolling
window of BLOCK words probes that index. With ``BLOCK = (WINDOW + 1) // 2`` each window of
WINDOW words holds a whole aligned block, so if its words start anywhere else, that block
is hit from there and it is itself hit by the block of the other place. Hits are then
extended: windows of WINDOW words around a hit are confirmed by their own words, over all
places where they start, and consecutive confirmed windows are merged into maximal exact
repeats, whose words are removed.

Texts are dealt to groups by hash. A group sends each distinct hash once to the hash's
bucket, however often it occurs, with two marks (aligned here, several here), so a common
passage costs a bucket one entry a group. Entries are sorted and packed by difference.
Buckets answer with the hashes that count, and the group's texts look them up; only hashes
move, and texts are shuffled once. Confirmation and removal use 128 bits, from two
independent hashes of each word.

Null and empty texts have no words. Texts shorter than WINDOW words keep all of them. Rows
that repeat a doc_id are texts of their own, so they remove one another. An empty table
gives no rows; columns that aren't named in `keep` play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkernel as tk
from shelfmark.llm.shared import partitions, ship

WINDOW = 35
#: Bits of a block's hash that probing uses. A false hit costs one candidate, no more.
PROBE_BITS = 44
#: Bytes of input, as its files or the planner count them, that a group of texts gets at most.
GROUP_BYTES = 64 << 20
_ENTRY = "bucket int, grp int, hashes binary, more binary"


def _marks(*flags: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.packbits(f).tobytes() for f in flags), 1)


def _unmark(blob: bytes, count: int, of: int) -> list[np.ndarray]:
    size = -(-count // 8)
    blob = zlib.decompress(blob)
    return [np.unpackbits(np.frombuffer(blob, np.uint8, size, k * size), count=count).astype(bool) for k in range(of)]


def _blocks(hashes: np.ndarray, block: int) -> np.ndarray:
    return tk.windows(hashes, block) >> np.uint64(64 - PROBE_BITS)


def _send(group: int, buckets: int, bits: int, hashes: np.ndarray, more):
    """Entries for each bucket; `hashes` are sorted and distinct. more(a, b): marks of a run."""
    # a bucket is an equal span of the hashes, so each bucket's entries are a run
    edges = (np.arange(1, buckets, dtype=np.uint64)) * np.uint64((1 << bits) // buckets)
    cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
    full = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pa.table([
        pa.array([k for k, _, _ in full], pa.int32()),
        pa.array([group] * len(full), pa.int32()),
        pa.array([tk.pack(hashes[a:b]) for _, a, b in full], pa.binary()),
        pa.array([more(a, b) for _, a, b in full], pa.binary()),
    ], names=["bucket", "grp", "hashes", "more"])


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _probes(window: int, buckets: int):
    block = (window + 1) // 2

    def run(key, texts):
        found = []
        for _, _, words in tk.word_slices(texts.column("text")):
            counts = np.diff(words.first)
            long_ = np.flatnonzero(counts >= window)
            n = counts[long_] - block + 1
            at = tk.ranges(words.first[long_], n)
            value = _blocks(words.hashes, block)[at] << np.uint64(1)
            # the lowest bit marks the blocks that stand in the text's own grid
            value |= (tk.ranges(np.zeros(len(n), np.int64), n) % block == 0).view(np.uint8)
            found.append(value)
        flat = _joined(found)
        del found
        flat.sort()
        index = (flat & np.uint64(1)).astype(bool)
        flat >>= np.uint64(1)
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        begins = np.flatnonzero(new)
        several = np.diff([*begins, len(flat)]) > 1 if len(flat) else np.zeros(0, bool)
        index = np.logical_or.reduceat(index, begins) if len(flat) else index
        return _send(key[0].as_py(), buckets, PROBE_BITS, flat[new], lambda a, b: _marks(index[a:b], several[a:b]))

    return run


def _answer(groups: np.ndarray, hashes: np.ndarray, more: np.ndarray | None = None) -> pa.Table:
    """For each group its hashes in order and, with `more`, the second hashes beside them."""
    order = np.argsort(groups, kind="stable")  # hashes are in order
    groups, hashes = groups[order], hashes[order]
    begins = np.flatnonzero(np.diff(groups, prepend=-1))
    spans = list(zip(begins.tolist(), [*begins[1:].tolist(), len(groups)]))
    columns = [pa.array(groups[begins], pa.int32()), pa.array([tk.pack(hashes[a:b]) for a, b in spans], pa.binary())]
    if more is not None:
        more = more[order]
        columns.append(pa.array([more[a:b].tobytes() for a, b in spans], pa.binary()))
    return pa.table(columns, names=["grp", "hits", "more"][: len(columns)])


def _probe(key, entries):
    """Of a bucket the hashes that are an indexed block somewhere and start in two places."""
    hashes, index, several, groups = [], [], [], []
    for group, blob, more in zip(*(entries.column(c).to_pylist() for c in ("grp", "hashes", "more"))):
        own = tk.unpack(blob)
        a, b = _unmark(more, len(own), 2)
        hashes.append(own)
        index.append(a)
        several.append(b)
        groups.append(np.full(len(own), group, np.int32))
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h, i, s, g = h[order], np.concatenate(index)[order], np.concatenate(several)[order], np.concatenate(groups)[order]
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff([*begins, len(h)])
    hit = (np.add.reduceat(i, begins, dtype=np.int64) > 0) & ((sizes > 1) | (np.add.reduceat(s, begins, dtype=np.int64) > 0))
    keep = np.repeat(hit, sizes)
    return _answer(g[keep], h[keep])


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _hits(table: pa.Table) -> np.ndarray:
    parts = [tk.unpack(x) for x in table.column("hits").to_pylist()]
    return np.sort(_joined(parts))


def _both(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First and second hashes of a group's repeats, in order of both."""
    one = _joined([tk.unpack(x) for x in table.column("hits").to_pylist()])
    two = _joined([np.frombuffer(x, np.uint64) for x in table.column("more").to_pylist()])
    order = np.lexsort((two, one))
    return one[order], two[order]


def _known(h: np.ndarray, second, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether (h, second of it) is among (one, two). second(i): the second hashes at places i."""
    out = _member(h, one)
    open_ = np.flatnonzero(out)
    if not len(open_):
        return out
    out[open_] = False
    at, h2 = np.searchsorted(one, h[open_]), second(open_)
    while len(open_):
        same = two[at] == h2
        out[open_[same]] = True
        at = at + 1
        go = ~same & (at < len(one))
        go[go] = one[at[go]] == h[open_[go]]
        open_, at, h2 = open_[go], at[go], h2[go]
    return out


def _extend(window: int, buckets: int):
    block = (window + 1) // 2

    def run(key, texts, found):
        hits = _hits(found)
        one, two = [], []
        if len(hits) and len(texts):
            for _, _, words in tk.word_slices(texts.column("text")):
                at = tk.inside(words.first, window)
                if not len(at):
                    continue
                hit = _member(_blocks(words.hashes, block), hits)
                total = np.concatenate([[0], np.cumsum(hit)])
                at = at[total[at + window - block + 1] > total[at]]  # a hit starts within the window and fits
                one.append(tk.windows(words.hashes, window)[at])
                two.append(tk.windows(words.second(), window, 1)[at] if len(at) else np.zeros(0, np.uint64))
        h, h2 = _joined(one), _joined(two)
        order = np.lexsort((h2, h))
        h, h2 = h[order], h2[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        begins = np.flatnonzero(new)
        several = np.diff([*begins, len(h)]) > 1 if len(h) else np.zeros(0, bool)
        h2 = h2[new]
        return _send(key[0].as_py(), buckets, 64, h[new], lambda a, b: h2[a:b].tobytes() + _marks(several[a:b]))

    return run


def _confirm(key, entries):
    """Of a bucket the windows that start in two places, by 128 bits."""
    one, two, several, groups = [], [], [], []
    for group, blob, more in zip(*(entries.column(c).to_pylist() for c in ("grp", "hashes", "more"))):
        own = tk.unpack(blob)
        one.append(own)
        two.append(np.frombuffer(more, np.uint64, len(own)))
        several += _unmark(more[8 * len(own) :], len(own), 1)
        groups.append(np.full(len(own), group, np.int32))
    h, h2 = np.concatenate(one), np.concatenate(two)
    order = np.lexsort((h2, h))
    h, h2, s, g = h[order], h2[order], np.concatenate(several)[order], np.concatenate(groups)[order]
    begins = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]))
    sizes = np.diff([*begins, len(h)])
    keep = np.repeat((sizes > 1) | (np.add.reduceat(s, begins, dtype=np.int64) > 0), sizes)
    return _answer(g[keep], h[keep], h2[keep])


def _remove(window: int, with_text: bool, carried: list[str]):
    def run(key, texts, found):
        one, two = _both(found)
        n = len(texts)
        counts, removed, spans = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        digests, kept_texts = [], []
        for i, j, words in tk.word_slices(texts.column("text")) if n else ():
            counts[i:j] = np.diff(words.first)
            cover = np.zeros(len(words.hashes) + 1, np.int32)
            at = tk.inside(words.first, window)
            if len(one) and len(at):
                second = lambda i, at=at, words=words: tk.windows(words.second(), window, 1)[at[i]]
                at = at[_known(tk.windows(words.hashes, window)[at], second, one, two)]
                cover[at] += 1
                np.subtract.at(cover, at + window, 1)
            gone = np.cumsum(cover)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed[i:j] = total[words.first[1:]] - total[words.first[:-1]]
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            edge = words.first[:-1][np.diff(words.first) > 0]
            starts[edge] = gone[edge]
            total = np.concatenate([[0], np.cumsum(starts)])
            spans[i:j] = total[words.first[1:]] - total[words.first[:-1]]
            # the kept words with a space before each, and where each text's begin
            keep = ~gone
            s, sizes = words.starts[keep].astype(np.int64), (words.ends - words.starts)[keep].astype(np.int64)
            place = np.cumsum(sizes + 1) - sizes
            out = np.full(int((sizes + 1).sum()), 32, np.uint8)
            out[tk.ranges(place, sizes)] = words.data[tk.ranges(s, sizes)]
            upto = np.concatenate([[0], np.cumsum(keep)])
            bytes_upto = np.concatenate([[0], np.cumsum(sizes + 1)])
            edges = bytes_upto[upto[words.first]].tolist()
            joined = out.tobytes()
            for a, b in zip(edges, edges[1:]):
                body = joined[a + 1 : b]
                digests.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    kept_texts.append(body)
        columns = [texts.column(c).combine_chunks() for c in carried]
        columns += [pa.array(counts), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())]
        names = [*carried, "n_words", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        return pa.table(columns, names=names)

    return run


def groups(docs: DataFrame) -> int:
    """How many groups, and buckets, the texts of `docs` are dealt to: two a shuffle
    partition, and more where a group would have over GROUP_BYTES. No job is run for it."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2 * partitions(docs.sparkSession), -(-size // GROUP_BYTES) if size < 1 << 60 else 0)  # larger: not known


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: key, `keep` columns, n_words, n_removed, n_spans,
    kept_sha256 and, with `with_text`, kept_text, the kept words joined by one space.

    n_spans counts the maximal repeats that were removed. A task holds one group of texts.
    """
    spark = docs.sparkSession
    ship(spark)
    count = groups(docs)
    kinds = dict(docs.dtypes)
    group = F.pmod(F.xxhash64(key, text), F.lit(count)).cast("int")
    also = [c for c in keep if c != text]
    texts = docs.select(group.alias("grp"), F.col(text).alias("text"), F.col(key).alias("_key"), *[F.col(c).alias(f"_keep_{c}") for c in also])
    # the text travels once, also where it is to be kept
    sent = {"_key": kinds[key]} | {f"_keep_{c}": kinds[c] for c in also} | ({"text": kinds[text]} if text in keep else {})

    entries = texts.groupBy("grp").applyInArrow(_probes(window, count), _ENTRY)
    hits = entries.groupBy("bucket").applyInArrow(_probe, "grp int, hits binary")
    entries = texts.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(_extend(window, count), _ENTRY)
    repeats = entries.groupBy("bucket").applyInArrow(_confirm, "grp int, hits binary, more binary")
    fields = [*(f"`{c}` {kind}" for c, kind in sent.items()), "n_words long, n_removed long, n_spans long, kept_sha256 string"] + ["kept_text string"] * with_text
    out = texts.groupBy("grp").cogroup(repeats.groupBy("grp")).applyInArrow(_remove(window, with_text, list(sent)), ", ".join(fields))
    columns = [F.col("text" if c == text else f"_keep_{c}").alias(c) for c in keep]
    return out.select(F.col("_key").alias(key), *columns, "n_words", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT row_number() OVER () AS r, doc_id, w FROM d),
u AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM t),
s AS (SELECT r, i, x, CASE WHEN count(*) OVER n = 35 THEN md5(string_agg(x, ' ') OVER n) END AS h FROM u WINDOW n AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
m AS (SELECT h FROM s WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
f AS (SELECT s.r, s.i, s.x, m.h IS NOT NULL AS hit FROM s LEFT JOIN m ON s.h = m.h),
g AS (SELECT r, i, x, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM g),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (r)
"""
