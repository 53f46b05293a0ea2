"""The training-data pipeline: toxicity, language, exact copies, near copies, packing.

What holds of every stage: a null text counts as empty, a null doc_id is a row without an id, an empty table gives
an empty one, and columns of any name stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, language_id, packing, simhash, toxicity
from quillspark.llm.common import free_name, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on this stage's input and the table of labels.

    Repeated rows stay or go together; an empty text stays unless an empty text would be toxic; without a toxic
    label nothing goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.id_remainder("doc_id", 3) != 1)
    return toxicity.filter_texts(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in none of the languages that rows are marked with, go.

    Nothing is foreign if no row is marked. Repeated rows stay or go together.
    """
    parser = language_id.fit(docs, language_id.id_remainder("doc_id", 4) != 2)
    return language_id.filter_texts(docs, parser)


def with_row_key(docs: DataFrame, **more: Column) -> tuple[DataFrame, str, list[str]]:
    """docs with a number of its own for each row and the columns `more`, written so that it stays; their names."""
    key = free_name(docs, "row_key")
    out, names = docs.withColumn(key, F.monotonically_increasing_id()), []
    for name, column in more.items():
        names.append(free_name(out, name))
        out = out.withColumn(names[-1], column)
    return materialize(out, "rows"), key, names


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows but those whose keys are in gone(key): the keys become bitmaps, an eighth of a byte a row, which rows meet.

    So texts stay in place wherever Spark finds the bitmaps small enough to send to all tasks, as it knows from the
    written table; else rows are dealt by stretches of keys.
    """
    bucket, bits = free_name(rows, "bucket"), free_name(rows, "bits")
    marked = materialize(gone.groupBy(F.bitmap_bucket_number(F.col(key)).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias(bits)), "gone")
    at = F.bitmap_bit_position(F.col(key)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_gone = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    met = rows.withColumn(bucket, F.bitmap_bucket_number(F.col(key))).join(marked, bucket, "left")
    return met.filter(~F.coalesce(is_gone, F.lit(False))).select(rows.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the one with the largest doc_id, any one of rows that repeat it; one without an id only where none has one."""
    rows, key, (sha,) = with_row_key(docs, sha=F.sha2(F.coalesce("text", F.lit("")), 256))
    groups = exact_dedup.duplicate_groups(rows)
    firsts = rows.groupBy(F.col("doc_id").cast("long").alias("id"), F.col(sha).alias("text_sha")).agg(F.min(key).alias(key))  # repeats fold before they meet
    kept = firsts.join(groups, (firsts["text_sha"] == groups["text_sha256"]) & firsts["id"].eqNullSafe(groups["keep_id"])).select(key)
    return without(rows, key, rows.select(key).join(kept, key, "left_anti")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest doc_id, one without an id only where none has one."""
    rows, key, _ = with_row_key(docs)
    groups = simhash.simhash_groups(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    ids = rows.select(key, F.col("doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(key))
    kept = groups.join(ids, key).groupBy("component_id").agg(F.min(order)[key].alias(key)).select(key)
    return without(rows, key, rows.select(key).join(kept, key, "left_anti")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of at most 2,048 tokens; repeated rows each for itself. Of the columns only doc_id stays."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("packing", pack_sequences)]

#: No SQL: the first two stages are learnt models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
