"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A text's signature is POSITIONS MinHash values of BITS bits. Two sets of similarity s
differ in a binomial number of positions with mean ``POSITIONS * (1 - s)``; at the
threshold 0.75 more than DISTANCE differing positions have a probability under 1e-5. The
signature is split into CHUNKS chunks; by the pigeonhole principle a pair within DISTANCE
has a chunk with at most ``DISTANCE // CHUNKS`` = 1 error, so indexing each chunk once with
each of its positions left out finds every pair within the distance, whatever the data.

Texts with equal sets are one class from the start. No step emits a group's pairs: (1)
each bucket links its classes to its smallest, where signatures are within DISTANCE; (2)
classes of a bucket that were not drawn together so are compared by signature there, and
the edges of a spanning forest leave; (3) components of those edges are the candidate
groups, which hold every pair within DISTANCE; (4) full sets are sent to their group, large
groups in pairs of blocks, every pair that could still join two parts is confirmed on full
sets there, and again a forest leaves. Its components are those of all links.

Words are split and A-Z lower-cased as in :mod:`textkernel`; a text of fewer words than a
shingle is one shingle; null and empty texts have no shingles and link with nothing. Sets
are told apart by 128 bits, from two independent hashes of each word, and shingles within
a pair of sets by 64. Rows that repeat a doc_id are rows of their own; a component's id is
its smallest doc_id, nulls aside. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm import textkernel as tk
from shelfmark.llm.shared import Forest, begins, blocked, components, cut, runs, ship, tidy

WORDS = 5
POSITIONS, BITS, CHUNK = 68, 16, 4
CHUNKS = POSITIONS // CHUNK
DISTANCE = 33
assert DISTANCE // CHUNKS == 1
#: Classes of a candidate group that are compared with one another, or with as many, in one task.
BLOCK = 512
#: The same for the classes of a bucket, whose signatures are compared.
BUCKET = 4096
#: Buckets from this size on are compared row by row, smaller ones many at a time.
LARGE = 64

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: tk.Words, size: int = WORDS, both: bool = False) -> tuple[np.ndarray, ...]:
    """Sorted distinct shingle hashes of each text, flat, where each text's begin and, with
    `both`, an independent hash of each of them."""
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    full = counts >= size

    def hashed(hashes: np.ndarray, seed: int) -> np.ndarray:
        flat = np.zeros(int(first[-1]), np.uint64)
        flat[tk.ranges(first[:-1][full], n[full])] = tk.windows(hashes, size, seed)[tk.inside(words.first, size)]
        for short in range(1, size):
            these = np.flatnonzero(counts == short)
            if len(these):
                at = tk.ranges(words.first[these], np.full(len(these), short))
                flat[first[these]] = tk.windows(hashes[at], short, seed)[::short]
        return flat

    flat, more = hashed(words.hashes, 0), hashed(words.second(), 1) if both else None
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if both:
            order = np.argsort(flat[a:b])
            flat[a:b], more[a:b] = flat[a:b][order], more[a:b][order]
        else:
            flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[first[:-1][n > 0]] = True
    before = np.concatenate([[0], np.cumsum(new)])
    return (flat[new], before[first], more[new]) if both else (flat[new], before[first])


def _ids(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set, 0 for an empty one."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        n = np.diff(first)[full].astype(np.uint64)
        total = np.add.reduceat(tk.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first[full])
        out[full] = tk.mix(total + n * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def signatures(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(non-empty sets, POSITIONS) values of BITS bits; made in blocks of shingles."""
    starts = first[:-1][np.diff(first) > 0]
    least = np.full((POSITIONS, len(starts)), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(flat), tk.BLOCK_WORDS):
        b = min(a + tk.BLOCK_WORDS, len(flat))
        i, j = int(np.searchsorted(starts, a, side="right")) - 1, int(np.searchsorted(starts, b))
        at = np.maximum(starts[i:j] - a, 0)
        for k in range(POSITIONS):
            np.minimum(least[k, i:j], np.minimum.reduceat((flat[a:b] ^ _XOR[k]) * _MUL[k], at), out=least[k, i:j])
    return (tk.mix(least) >> np.uint64(64 - BITS)).astype(np.uint16).T.copy()


def _sign(batches):
    names = ["doc_id", "text_hash", "n_shingles", "set_id", "check", "signature"]
    for batch in batches:
        parts = []
        for i, j, words in tk.word_slices(batch.column(1), lower=True):
            flat, first, more = shingles(words, both=True)
            n = np.diff(first)
            raw = np.full(j - i, None, object)
            raw[n > 0] = [r.tobytes() for r in signatures(flat, first)]
            parts.append((n, _ids(flat, first), _ids(more, first), raw))
        if parts:
            n, ids, checks, raw = (np.concatenate(x) for x in zip(*parts))
            own = [pa.array(n), *(pa.array(x, pa.int64(), mask=n == 0) for x in (ids, checks)), pa.array(list(raw), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *own], names)


def _keys(batches):
    """Every chunk of each signature with each of its positions left out, as a hash."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, CHUNKS, CHUNK).astype(np.uint64)
        out = np.empty((n, CHUNKS, CHUNK), np.uint64)
        for left in range(CHUNK):
            h = np.full((n, CHUNKS), left + 1, np.uint64) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK + 1)
            for i in range(CHUNK):
                if i != left:
                    h = tk.mix(h * np.uint64(1 << BITS) + sig[:, :, i])
            out[:, :, left] = h
        ids = np.repeat(batch.column(0).to_numpy(), POSITIONS)
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])


def _near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether rows of signatures are within DISTANCE, and set sizes allow the threshold."""
    good = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * 75
    at = np.flatnonzero(good)
    good[at] = (a[at] != b[at]).sum(axis=1) <= DISTANCE
    return good


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _close(batches):
    for batch in batches:
        if len(batch):
            a, b, sa, sb, na, nb = batch.columns
            good = _near(_rows(sa), _rows(sb), na.to_numpy(), nb.to_numpy())
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good)), b.filter(pa.array(good))], ["a", "b"])


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _apart(batches):
    """A spanning forest of the pairs within DISTANCE that share a key and differ in component.

    Rows come by key and blocks: key, i, j, id, component, n, signature.
    """
    forest = Forest()
    for key, left, right, ids, comp, n, raw in runs(batches, 3, 7):
        sig = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, POSITIONS)
        found: list[tuple[int, int]] = []
        first = begins(key, left, right)
        sizes = np.diff([*first, len(key)])
        bucket = np.repeat(np.arange(len(first)), sizes)
        for a, size in zip(first[sizes >= LARGE].tolist(), sizes[sizes >= LARGE].tolist()):
            label = np.unique(comp[a : a + size], return_inverse=True)[1]
            for i in range(size - 1):
                if (label == label[0]).all():
                    break
                j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                j = j[_near(sig[a + j], np.broadcast_to(sig[a + i], (len(j), POSITIONS)), n[a + j], n[a + i])]
                if len(j):
                    _, one = np.unique(label[j], return_index=True)
                    found += [(int(ids[a + i]), int(ids[a + k])) for k in j[one]]
                    label[np.isin(label, label[j])] = label[i]
        live = np.flatnonzero(np.repeat(sizes < LARGE, sizes))
        gap = 0
        while len(live):
            gap += 1
            live = live[live + gap < len(key)]
            live = live[bucket[live] == bucket[live + gap]]
            two = live[comp[live] != comp[live + gap]]
            two = two[_near(sig[two], sig[two + gap], n[two], n[two + gap])]
            found += zip(ids[two].tolist(), ids[two + gap].tolist())
        found = [x for x in found if forest.join(*x)]
        if found:
            yield _edges(*zip(*found))


def _sets(batches):
    for batch in batches:
        for _, _, words in tk.word_slices(batch.column(0), lower=True):
            flat, first, more = shingles(words, both=True)
            blobs = [flat[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(_ids(flat, first)), pa.array(_ids(more, first)), pa.array(blobs, pa.binary())], ["set_id", "check", "members"])


def _linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets, by their places."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    out: list[tuple[int, int]] = []
    if m == 2:
        a, b = sorted(sets, key=len)
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        same = int((b[at] == a).sum())
        return [(0, 1)] if 100 * same >= 75 * (len(a) + len(b) - same) else []
    # places of each element that occurs more than once, so that a set's overlaps are counts
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, posting = flat[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    length = np.diff([*begins, len(flat)])
    element = np.empty(len(flat), np.int64)
    element[order] = np.repeat(np.arange(len(begins)), length)
    first = np.cumsum(size) - size
    label = np.arange(m)
    for i in range(m - 1):
        if (label == label[0]).all():
            break
        if (label[i + 1 :] == label[i]).all():
            continue
        own = element[first[i] : first[i] + size[i]]
        own = own[length[own] > 1]
        same = np.bincount(posting[tk.ranges(begins[own], length[own])], minlength=m)
        j = i + 1 + np.flatnonzero((100 * same >= 75 * (size + size[i] - same))[i + 1 :] & (label[i + 1 :] != label[i]))
        if len(j):
            _, one = np.unique(label[j], return_index=True)
            out += [(i, int(k)) for k in j[one]]
            label[np.isin(label, label[j])] = label[i]
    return out


def _confirm(batches):
    """A forest of the links of each candidate group or pair of its blocks, on full sets.

    Rows come by group and blocks: component, i, j, id, members.
    """
    for comp, i, j, ids, blobs in runs(batches, 3, 5):
        cuts = begins(comp, i, j)
        a, b = [], []
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(comp)]):
            own, at = np.unique(ids[x:y], return_index=True)
            if len(own) > 1:
                for p, q in _linked([np.frombuffer(blobs[x + k], np.uint64) for k in at]):
                    a.append(int(own[p]))
                    b.append(int(own[q]))
        if a:
            yield _edges(a, b)


def _grouped(docs: DataFrame, key: str, text: str, *also: str) -> DataFrame:
    """One row per row of `docs`: doc_id, `also` (text_hash), n_shingles, and the group, null without a shingle.

    Classes are numbered where they are written, so a class's id is its own at any size.

    Shuffles: the keys once (16 bytes each, POSITIONS a class), texts once for the classes
    that have a candidate, and small tables of classes and links. No bucket is cut off.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    ship(docs.sparkSession)
    kind = dict(rows.dtypes)["doc_id"]
    signed = cut(rows.mapInArrow(tidy(_sign), f"doc_id {kind}, text_hash long, n_shingles long, set_id long, check long, signature binary"))
    classes = signed.where("set_id is not null").groupBy("set_id", "check").agg(F.min("n_shingles").alias("n"), F.min(F.struct("text_hash", "doc_id")).alias("one"), F.min("signature").alias("signature"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))

    by_key = Window.partitionBy("key")
    keyed = classes.select("id", "signature").mapInArrow(tidy(_keys), "key long, id long")
    shared = keyed.withColumn("low", F.min("id").over(by_key)).withColumn("high", F.max("id").over(by_key)).where("low < high")
    shared = cut(shared.select("key", "id", "low"))

    def signed_pairs(pairs: DataFrame) -> DataFrame:
        a = classes.select(F.col("id").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
        b = classes.select(F.col("id").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(tidy(_close), "a long, b long")

    def across(groups: DataFrame) -> DataFrame:
        """A forest of pairs within the distance in a bucket whose two groups differ."""
        seen = shared.select("key", "id").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        seen = seen.withColumn("x", F.min("component").over(by_key)).withColumn("y", F.max("component").over(by_key)).where("x < y").select("id", "key", "component")
        seen = blocked(seen, ["key"], "id", BUCKET)
        full = seen.join(classes.select("id", "n", "signature"), "id").select("key", "i", "j", "id", "component", "n", "signature")
        return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidy(_apart), "a long, b long")

    stars = cut(signed_pairs(shared.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()))
    # a group by signatures alone: what a bucket's smallest class draws together
    loose = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    near = components(cut(stars.union(across(loose))))

    tasks = blocked(near, ["component"], "node", BLOCK).select(F.col("node").alias("id"), "component", "i", "j").join(classes.select("id", "set_id", "check"), "id")
    wanted = near.select(F.col("node").alias("id")).join(classes.select("id", "one"), "id").select("one.text_hash", F.col("one.doc_id").alias("one_id"))
    chosen = (rows["text_hash"] == wanted["text_hash"]) & rows["doc_id"].eqNullSafe(wanted["one_id"])
    members = cut(rows.join(wanted.hint("shuffle_hash"), chosen, "left_semi").select("text").mapInArrow(tidy(_sets), "set_id long, check long, members binary"))
    sent = members.join(tasks, ["set_id", "check"]).select("component", "i", "j", "id", "members")
    links = sent.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(tidy(_confirm), "a long, b long")
    groups = components(cut(links))

    linked = groups.join(classes.select(F.col("id").alias("node"), "set_id", "check"), "node").select("set_id", "check", "component")
    own = signed.join(linked, ["set_id", "check"], "left")
    alone = F.col("component").isNull()
    group = F.when(F.col("set_id").isNotNull(), F.struct(alone.alias("alone"), F.coalesce("component", "set_id").alias("x"), F.when(alone, F.col("check")).otherwise(0).alias("y")))
    return cut(own.select("doc_id", *also, "n_shingles", group.alias("group")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, n_shingles, component_id, kept."""
    own = _grouped(docs, key, text)
    least = own.where("`group` is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = own.join(least, "group", "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash) of one text of each group: of the smallest key, nulls last, then by hash.

    A text without a shingle has only those rows in its group that have its key and hash.
    """
    own = _grouped(docs, key, text, "text_hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    of_groups = own.where("`group` is not null").groupBy("group").agg(first).select("first.doc_id", "first.text_hash")
    alone = own.where("`group` is null").select("doc_id", "text_hash").distinct()
    return of_groups.union(alone).select(F.col("doc_id").alias(key), "text_hash")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT r, len(w) AS n, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
s AS (SELECT r, n, i, count(*) OVER v AS c, string_agg(x, ' ') OVER v AS sh FROM u WINDOW v AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
h AS (SELECT DISTINCT r, md5(sh) AS sh FROM s WHERE c = 5 OR (n < 5 AND i = 1)),
z AS (SELECT r, count(*) AS size FROM h GROUP BY r),
l AS (SELECT a.r AS a, b.r AS b, count(*) AS same FROM h a JOIN h b ON a.sh = b.sh AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT l.a, l.b FROM l JOIN z x ON x.r = l.a JOIN z y ON y.r = l.b WHERE 100 * same >= 75 * (x.size + y.size - same)),
q AS (WITH RECURSIVE reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1)
SELECT d.doc_id, coalesce(z.size, 0)::BIGINT AS n_shingles, q.component_id, d.doc_id IS NOT DISTINCT FROM q.component_id AS kept FROM d LEFT JOIN z USING (r) JOIN q USING (r)
"""
