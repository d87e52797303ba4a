"""Full-text search over several fields, from postings that are stored once.

A posting is one term in one field of one document, with its places. Postings are dealt by
a hash of the term into buckets, which are folders, and within a bucket by a hash of the
document, so that a frequent term is many files; files are sorted by term. A search reads
the buckets and row groups of its own words only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T

K1, B = 1.2, 0.75
BUCKETS = 16
#: Bytes of text, as the planner counts them, that one task of a build is meant for.
TASK_BYTES = 128 << 20


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without their accents."""
    return F.filter(F.split(T.fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrases(query: str) -> list[str]:
    """A search box's text as phrases, folded as the texts are: each word is one, parted where it
    holds other signs."""
    letters, plain = T.FOLD
    table = {ord(ch): plain[i] if i < len(plain) else None for i, ch in enumerate(letters)}
    words = ("".join(ch if ch.isalnum() else " " for ch in word).split() for word in query.translate(table).lower().split())
    return [" ".join(w) for w in words if w]


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def splits(table: DataFrame) -> int:
    """Splits of a bucket for the texts of a table that is read from files, by its bytes."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(1, -(-size // (BUCKETS * TASK_BYTES))), 1 << 16)


def postings(docs: DataFrame, key: str, fields: list[str], splits: int) -> DataFrame:
    """bucket, split, term, field, key, places, len: one shuffle, of tokens to their bucket's split.

    `len` counts the tokens of all fields. Null fields are empty; rows that repeat a key are
    one document; a document without a token has no posting.
    """
    rows = docs.select(F.col(key).alias("key"), *[F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias(f"_{i}") for i, f in enumerate(fields)])
    rows = rows.withColumn("len", reduce(Column.__add__, [F.size(f"_{i}") for i in range(len(fields))]))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"_{i}").alias("t")) for i in range(len(fields))]))
    placed = rows.select("key", "len", each.alias("f")).select("key", "len", "f.field", F.posexplode("f.t").alias("at", "term"))
    split = F.pmod(F.xxhash64("key"), F.lit(splits)).cast("int")
    dealt = placed.withColumns({"bucket": _bucket(F.col("term")), "split": split}).repartition(BUCKETS * splits, "bucket", "split")
    return dealt.groupBy("bucket", "split", "term", "field", "key").agg(F.array_sort(F.collect_list("at")).alias("places"), F.max("len").alias("len"))


def build(docs: DataFrame, key: str, fields: list[str], path: str, splits: int = 1) -> None:
    """Write postings, and the totals that scores need, below `path`."""
    postings(docs, key, fields, splits).sortWithinPartitions("bucket", "term", "key").write.partitionBy("bucket").parquet(f"{path}/postings")
    length = reduce(Column.__add__, [F.coalesce(F.size(tokens(F.col(f))), F.lit(0)) for f in fields])
    lengths = docs.select(F.col(key).alias("key"), F.when(length > 0, length).otherwise(0).alias("len")).groupBy("key").agg(F.max("len").alias("len"))
    lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).write.parquet(f"{path}/totals")


def found(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """Documents with any of the phrases: key, len, and how often each occurs (_0, _1, ...).

    The words of a phrase stand side by side in one field. No phrase finds nothing.
    """
    index = spark.read.parquet(f"{path}/postings")
    if not asked:
        return index.select("key", "len").limit(0)
    asked = [" ".join(p.split()) for p in asked]
    words = sorted({w for p in asked for w in p.split()})
    in_phrases = sorted({w for p in asked if " " in p for w in p.split()})
    places = F.when(F.col("term").isin(*in_phrases), F.col("places")) if in_phrases else F.lit(None).cast("array<int>")
    rows = index.where(F.col("bucket").isin(*[_bucket(F.lit(w)) for w in words]) & F.col("term").isin(*words))
    rows = rows.select("key", "field", "len", "term", F.size("places").alias("n"), places.alias("places")).repartition("key")
    at = {w: f"w{i}" for i, w in enumerate(words)}
    facts = [F.coalesce(F.sum(F.when(F.col("term") == w, F.col("n"))), F.lit(0)).alias(f"n_{at[w]}") for w in words]
    facts += [F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p_{at[w]}") for w in in_phrases]
    by_field = rows.groupBy("key", "field").agg(F.max("len").alias("len"), *facts)

    def times(phrase: str) -> Column:
        parts = phrase.split()
        if len(parts) == 1:
            return F.col(f"n_{at[phrase]}")
        starts = [F.transform(f"p_{at[w]}", lambda x: x - F.lit(j)) for j, w in enumerate(parts)]
        return F.coalesce(F.size(F.array_distinct(reduce(F.array_intersect, starts))), F.lit(0))

    counted = by_field.select("key", "len", *[F.greatest(times(p), F.lit(0)).alias(f"_{i}") for i, p in enumerate(asked)])
    whole = counted.groupBy("key").agg(F.max("len").alias("len"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(asked))])
    return whole.where(reduce(Column.__or__, [F.col(f"_{i}") > 0 for i in range(len(asked))]))


def bm25(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """key and score of the documents with any of the phrases, by Robertson's formula with an
    idf that stays positive. Two rows of totals come back to each task."""
    hits = found(spark, path, asked)
    if not asked:
        return hits.select("key", F.lit(0.0).alias("score"))
    n = range(len(asked))
    rarity = hits.agg(*[F.count_if(F.col(f"_{i}") > 0).alias(f"df{i}") for i in n])
    rows = hits.join(F.broadcast(rarity), F.lit(True)).join(F.broadcast(spark.read.parquet(f"{path}/totals")), F.lit(True))  # one row each
    score = F.lit(0.0)
    for i in n:
        tf, df = F.col(f"_{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.select("key", F.round(score, 6).alias("score"))
