"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard scores every key with a number that depends on the key and the shard alone,
``-weight / ln(u)`` with u from a hash, and the highest score wins. A new shard changes a
key's place only where its own score wins, so growing by one moves only what the new shard
receives, and a shard gets keys in proportion to its weight. No state, no shuffle.

A null key is a key like any other; equal keys share a shard. Null texts have no bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells that the rows of a shard are numbered in, 16**3; only their counts meet in one place.
CELLS = 4096


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards; weights are positive.

    With equal weights the hash itself is compared, which gives the same order. The hash is
    MD5 of shard and key, the same in every engine, so any reader can find a key's shard.
    """
    return _best(key, weights, 0)["shard"]


def _best(key: Column, weights: list[float], first: int) -> Column:
    """The largest (score, shard) of a key over shards numbered from `first`."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    equal = len(set(weights)) == 1
    named = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))

    def score(shard: int, weight: float) -> Column:
        h = F.md5(F.concat(F.lit(f"{shard}:"), named))
        if equal:
            return F.substring(h, 1, 16)
        u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / math.ldexp(1, 52)
        return F.lit(-float(weight)) / F.ln(u)

    scored = [F.struct(score(first + i, w).alias("score"), F.lit(first + i).alias("shard")) for i, w in enumerate(weights)]
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def assign(docs: DataFrame, shards: int | list[float] = 24, key: str = "doc_id", text: str = "text", grown: float = 1.0) -> DataFrame:
    """One row per row of `docs`: key, size, text_crc32, law, shard, slot, grown_shard.

    `shards` is a count or a list of weights; `grown` is the weight of the shard by which
    grown_shard has more. slot numbers a shard's rows from 0 without gaps: rows are
    numbered within CELLS cells of a shard, and the counts of the cells before are added,
    a table of CELLS rows a shard at most. Rows with equal key and text are interchangeable
    in that, and no others are. An empty table gives no rows; other columns play no part.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    same = len({*weights, grown}) == 1  # a key stays or goes to the new shard; else scores are of another kind
    more = F.greatest("best", _best(F.col("_key"), [grown], len(weights)))["shard"] if same else rendezvous(F.col("_key"), [*weights, grown])
    rows = docs.select(F.col(key).alias("_key"), body.alias("body"), _best(F.col(key), weights, 0).alias("best"))
    rows = rows.select(
        "_key",
        (F.octet_length("body") + 8).cast("long").alias("size"),
        F.crc32("body").alias("text_crc32"),
        F.xxhash64("body").alias("tie"),
        F.col("best.shard").alias("shard"),
        more.alias("grown_shard"),
    )
    rows = rows.withColumn("cell", F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_key").cast("string"), F.col("text_crc32").cast("string"))), 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "cell").orderBy("_key", "text_crc32", "size", "tie")
    rows = rows.withColumn("at", F.row_number().over(within) - 1)
    out = rows.join(starts, ["shard", "cell"])
    return out.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int | list[float] = 24, key: str = "doc_id", file_type: str = "parquet") -> None:
    """Every column of `docs` below ``path/shard=N``. A shard's rows are spread over the
    tasks that hold them, so a large shard is several files and no task writes a whole one."""
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    name = "shard" if "shard" not in docs.columns else "shard_"
    docs.withColumn(name, rendezvous(F.col(key), weights)).write.mode("overwrite").partitionBy(name).format(file_type).save(path)


# CRC-32 in SQL takes the bytes' hexadecimal digits, the lower one of each first.
ORACLE = """
WITH n AS (SELECT list_transform(range(16), lambda x: list_reduce(range(4), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
c AS (SELECT r, doc_id, (octet_length(encode(body)) + 8)::BIGINT AS size, xor(4294967295, list_reduce(regexp_extract_all(hex(encode(body)), '..'),
  lambda s, b: list_reduce([strpos('0123456789ABCDEF', b[2]) - 1, strpos('0123456789ABCDEF', b[1]) - 1], lambda s, v: xor(s >> 4, t[1 + (xor(s, v) & 15)::INT]), s), 4294967295)) AS text_crc32 FROM d, n),
h AS (SELECT *, list_transform(range(25), lambda s: substr(md5(s || ':' || coalesce('k' || doc_id, 'n')), 1, 16)) AS scores, substr(md5(concat_ws(':', doc_id::VARCHAR, text_crc32::VARCHAR)), 1, 3) AS cell FROM c),
p AS (SELECT *, (list_position(scores, list_max(scores[1:24])) - 1)::INT AS shard, (list_position(scores, list_max(scores)) - 1)::INT AS grown_shard FROM h)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM p
"""
