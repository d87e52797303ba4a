"""A training corpus from `documents`, in stages that each call one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
`documents`; other columns of docs play no part. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm import bpe, langid, minhash, mixing, substring
from shelfmark.llm.shared import folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text's mean word posterior below which its language counts as unknown.
LEAST_SCORE = 0.35
#: What a batch of rows on its way to or from Python holds at most, where the session keeps
#: Spark's defaults of 10,000 rows and 64 MB, which a task holds several times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304")}


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; text without a letter and undecided text goes.

    Where no document has a language to learn from, only text without a letter goes.
    """
    model = langid.fit(*langid.sample(docs))
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = langid.predict(docs, model, keep=COLUMNS[1:])
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id, then text hash; equal rows count once."""
    row = F.xxhash64("text_hash", "doc_id").alias("row")
    one = minhash.representatives(docs).select("text_hash", row)
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash")).select("*", row)
    found = rows.join(one.hint("shuffle_hash"), ["text_hash", "row"], "left_semi")
    copies = Window.partitionBy("text_hash", "row").orderBy("lang", "source", "n_chars")
    return found.withColumn("place", F.row_number().over(copies)).where("place = 1").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; a text that loses nothing stays as it is.

    A null text stays null, with null n_chars, and a text that loses every word is empty; rows
    that repeat a doc_id are documents of their own, which remove one another's passages.
    """
    done = substring.dedup(docs, with_text=True, keep=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return done.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in rows that are alike.

    Null texts have size 0, and a null source is a source of its own; rows that repeat a
    doc_id are documents of their own. What the mix takes not once goes.
    """
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars", "source")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the text decoded from them.

    A null text counts as empty and has no ids; rows that repeat a doc_id stay rows.
    """
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, with each result kept in the shared folder until
    the next one is written; what the last stage reads stays, as its result is lazy."""
    for name, (default, own) in BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, own)  # stays set, as the last stage is lazy
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
