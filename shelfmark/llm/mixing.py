"""Mixing sources to target weights by systematic sampling, with built-in functions only.

Every document of a source is expected ``target / size of the source`` times. The expected
copies are summed up in a fixed order within the source, one random offset is added, and a
document is emitted once for each integer boundary that its step crosses. The order is by
size, so that a source's words, and not only its documents, come near the target.

The running position within a source is found in two levels: an aggregate counts documents
by size class and salt, a window over those few counts gives each cell's start, and a
window within the cell the rest. So no task sees a whole source. Offsets and salts come
from MD5 of the seed, the source and the key: reruns agree, and so does plain SQL.

Null texts have size 0; a null source is a source of its own, the last in the order; rows
that are equal are mixed as separate documents; a source whose documents are all empty has
target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = "[^\\x20\\x09-\\x0D]+"
#: A document is taken at most so many times.
CAP = 3
#: Weights by the source's place in code point order, repeating.
WEIGHTS = (1, 2, 3)


def _unit(text: Column) -> Column:
    """A number in [0, 1) from a text, with 32 random bits."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The total is shared by weight; no target is above `cap` times its source's size, and
    the excess is shared by weight among the rest. With sources in order of cap / weight
    that is one pass: the first source whose share of what is left fits fixes the level.
    `sizes` has a row per source, which is what its one-task window sees.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(place) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * cap)
    ranked = ranked.withColumn("need", F.col("limit") / F.col("weight"))
    order = Window.orderBy("need", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0)))
    ranked = ranked.withColumn("shares", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) - F.col("spent")) / F.col("shares")
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("fixed", F.min(F.when(F.col("need") >= F.col("level"), F.struct("need", "level")))  .over(whole)["level"])
    return ranked.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("fixed")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, `keep` columns, size, source_size, target, copies, taken.

    `copies` says how often the mix holds the document; ``taken = copies * size``. Shuffles
    carry keys and sizes, besides `keep`, never texts that aren't kept.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    bits = F.char_length(F.bin("size"))
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), size.alias("size"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.withColumn("class", bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").cast("int"))
    rows = rows.withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))  # never null: one partitioning serves window and join
    rows = rows.withColumn("salt", F.substring(F.md5(F.coalesce(F.col("_key").cast("string"), F.lit(""))), 1, 2))
    cells = rows.groupBy("name", "class", "salt").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words"))
    aims = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap).withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    aims = aims.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", _unit(F.concat(F.lit(seed), F.col("name"))))
    earlier = Window.partitionBy("name").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("name", "class", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    cells = cells.join(aims.drop("source"), "name")
    within = Window.partitionBy("name", "class", "salt").orderBy("size", "_key")
    rows = rows.withColumn("at", F.row_number().over(within)).join(cells, ["name", "class", "salt"])
    place = F.col("start") + F.col("at")
    copies = (F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))).cast("long")
    return rows.select(F.col("_key").alias(key), *[F.col(f"_keep_{c}").alias(c) for c in keep], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS lim FROM s),
o AS (SELECT *, lim::DOUBLE / weight AS need FROM w),
p AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY need, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
  sum(weight) OVER (ORDER BY need, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS shares,
  (sum(source_size) OVER ())::BIGINT AS whole FROM o),
l AS (SELECT *, (whole - spent)::DOUBLE / shares AS lvl FROM p),
f AS (SELECT *, (SELECT lvl FROM l WHERE need >= lvl ORDER BY need, lvl LIMIT 1) AS fixed FROM l),
t AS (SELECT source, source_size, least(lim::DOUBLE, weight * fixed) AS target,
  (('0x' || substr(md5('mix-1' || coalesce('s' || source, 'n')), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS off FROM f),
c AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)::BIGINT) AS class, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS salt FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS FIRST) AS place FROM c),
j AS (SELECT n.doc_id, n.size, t.source_size, t.target, n.place, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (floor(place * rate + off) - floor((place - 1) * rate + off))::BIGINT AS copies FROM j)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM k
"""
