"""File sources and sinks: listing, validation, JSON lines, partition overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import safe_name
from quillspark.operators.retrieval import vector_topk

# Registered extensions with their kind, locator prefix and leading bytes.
FORMATS = [(".pdf", "page", "p", "%PDF-"), (".md", "section", "sec", ""), (".markdown", "section", "sec", ""), (".docx", "section", "sec", "PK"), (".txt", "block", "blk", ""), (".text", "block", "blk", "")]
MAX_BYTES = 50 * 1024 * 1024


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "extension string, kind string, prefix string, magic string")


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Registered files below a folder: path, extension, kind, prefix, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    return named.join(F.broadcast(formats(spark)), "extension").select("path", "extension", "kind", "prefix", "length", "content")


def storage_key(content: Column, name: Column) -> Column:
    """The first 12 digits of the content's SHA-256 and the safe name; equal bytes give equal keys."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 12), F.lit("_"), safe_name(name))


def file_reason(extension: Column, length: Column, content: Column) -> Column:
    """Why a file is refused, or an empty string."""
    magic = F.create_map(*[F.lit(x) for e, _, _, m in FORMATS for x in (e, m)])
    wanted = F.try_element_at(magic, extension)
    head = F.substring(content, 1, 4096)
    binary = F.contains(head, F.lit(b"\x00")) & extension.isin([e for e, _, _, m in FORMATS if not m])
    starts = F.hex(F.substring(content, 1, 5)).startswith(F.hex(wanted))
    return F.when(wanted.isNull(), "unsupported_extension").when(length > MAX_BYTES, "too_large").when((F.length(wanted) > 0) & ~starts, "bad_magic").when(binary, "binary_text").otherwise("")


def write_jsonl(df: DataFrame, path: str) -> None:
    """S27."""
    df.write.mode("overwrite").json(path)


def replace_source(chunks: DataFrame, path: str) -> None:
    """All chunks of the sources in `chunks` take the place of those stored before."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def read_runs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Run imports from JSON lines, or from CSV whose dotted columns become maps."""
    if kind == "json":
        return spark.read.schema("experiment_id string, run_id string, seed int, config map<string,string>, metrics map<string,double>, environment map<string,string>, artifact_paths array<string>").json(path)
    rows = spark.read.option("header", True).csv(path)

    def gather(prefix: str, kind: str) -> Column:
        found = [c for c in rows.columns if c.startswith(prefix)]
        pairs = [x for c in found for x in (F.lit(c[len(prefix) :]), F.col(f"`{c}`").cast(kind))]
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast(f"map<string,{kind}>")

    return rows.select("experiment_id", "run_id", F.col("seed").cast("int").alias("seed") if "seed" in rows.columns else F.lit(None).cast("int").alias("seed"), gather("config.", "string").alias("config"), gather("metrics.", "double").alias("metrics"), gather("environment.", "string").alias("environment"), F.filter(F.split("artifact_paths", ";"), lambda x: x != "").alias("artifact_paths"))


def point_id(name: Column) -> Column:
    """The UUID of version 5 of a name in the namespace of addresses."""
    # The namespace; digits of the variant.
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def export_vectors(chunks: DataFrame, path: str) -> int:
    """Write chunks under point_id of their own, and fail unless all arrive."""
    chunks.withColumn("point_id", point_id(F.col("chunk_id"))).write.mode("overwrite").parquet(path)
    there, wanted = chunks.sparkSession.read.parquet(path).count(), chunks.count()
    if there != wanted:
        raise ValueError(f"{there} of {wanted} rows arrived")
    return there


def export_differences(chunks: DataFrame, path: str, queries: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest of queries(query_id, v) among the chunks and among their copies: places at which they differ, with both scores."""

    def nearest(df: DataFrame, score: str) -> DataFrame:
        items = df.select(F.xxhash64("chunk_id").alias("doc"), F.col("embedding").alias("v"))
        return vector_topk(queries, items, k).select("query_id", "rank", F.col("doc").alias(f"{score}_doc"), F.col("score").alias(score))

    j = nearest(chunks, "here").join(nearest(chunks.sparkSession.read.parquet(path), "there"), ["query_id", "rank"], "full_outer")
    return j.filter(~F.col("here_doc").eqNullSafe(F.col("there_doc")) | ~F.col("here").eqNullSafe(F.col("there"))).select("query_id", "rank", "here", "there")
