"""Files as they arrive, through validation, sections, chunks and the duplicate check, into tables that only grow.

A store is a folder with four tables, each partitioned by `batch`:

    chunks    source, section_no, chunk_index, kind, content, content_key, chunk_id
    papers    source, path, status (indexed, duplicate), owner, chunk_count
    refused   path, source, reason
    ledger    one row for each finished batch: its counts, written last

A batch overwrites its own partitions and nothing else, and does nothing once the ledger has it, so a batch that is
delivered again, in part or whole, changes nothing. A source that comes again takes the place of its older self:
what counts is a source's latest batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import chunk_id, content_key
from quillspark.operators.ingest import batch_duplicates, chunk_recursive, library_owner, sections_markdown, sections_text
from quillspark.operators.retrieval import written
from quillspark.sources.files import FORMATS, file_reason, storage_key

FILES = "path string, modificationTime timestamp, length long, content binary"
SCHEMAS = {
    "chunks": "source string, section_no int, chunk_index int, kind string, content string, content_key string, chunk_id string, batch long",
    "papers": "source string, path string, status string, owner string, chunk_count long, batch long",
    "refused": "path string, source string, reason string, batch long",
    "ledger": "files long, refused long, duplicates long, indexed long, chunks long, batch long",
}
# Formats that are text, by their kind of section.
MARKDOWN, TEXT = [e for e, kind, _, magic in FORMATS if kind == "section" and not magic], [e for e, kind, _, magic in FORMATS if kind == "block" and not magic]


def table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store; empty before its first batch."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{store}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def current_papers(spark: SparkSession, store: str) -> DataFrame:
    """The latest row of each source."""
    return table(spark, store, "papers").groupBy("source").agg(F.max_by(F.struct("path", "status", "owner", "chunk_count", "batch"), "batch").alias("p")).select("source", "p.*")


def current_chunks(spark: SparkSession, store: str) -> DataFrame:
    """Chunks of each indexed source as its latest batch left them."""
    live = current_papers(spark, store).filter("status = 'indexed'").select("source", "batch")
    return table(spark, store, "chunks").join(live, ["source", "batch"], "left_semi")


def _put(df: DataFrame, store: str, name: str, batch: int) -> DataFrame:
    """df in the place of the batch's rows of a table; what is then there."""
    columns = [f.split()[0] for f in SCHEMAS[name].split(", ")[:-1]]
    path = f"{store}/{name}/batch={batch}"
    df.select(*columns).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(SCHEMAS[name].rpartition(", ")[0]).parquet(path)


def ingest_batch(files: DataFrame, batch: int, store: str) -> None:
    """One batch of files (FILES). Of files of one name within a batch the latest modified counts."""
    spark = files.sparkSession
    if table(spark, store, "ledger").filter(F.col("batch") == batch).take(1):
        return
    named = files.withColumn("source", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    # Only what comes more than once is put in order; the other files stay where they lie.
    several = written(named.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source"), "several")
    latest = Window.partitionBy("source").orderBy(F.desc("modificationTime"), F.desc("path"), F.desc(F.xxhash64("content")))
    last = named.join(several, "source", "left_semi").withColumn("n", F.row_number().over(latest)).filter("n = 1").drop("n")
    fresh = named.join(several, "source", "left_anti").unionByName(last)
    readable = F.col("extension").isin(MARKDOWN + TEXT)
    judged = fresh.select("path", "source", "extension", "content", file_reason(F.col("extension"), F.col("length"), F.col("content")).alias("reason"))
    checked = written(judged.withColumn("content", F.when(readable & (F.col("reason") == ""), F.col("content"))), "checked")  # only contents that are read on
    text = F.decode("content", "UTF-8")
    good = checked.filter("reason = ''")
    bad = checked.filter("reason <> ''").select("path", "source", "reason").unionByName(good.filter(~readable).select("path", "source", F.lit("no_decoder").alias("reason")))
    refused = _put(bad, store, "refused", batch)
    texts = good.filter(readable).select("source", "path", "extension", text.alias("text"))
    parts = sections_markdown(texts.filter(F.col("extension").isin(MARKDOWN)), "source", "text").select("doc", "section_no", "text")
    parts = parts.unionByName(sections_text(texts.filter(F.col("extension").isin(TEXT)), "source", "text").select("doc", "section_no", "text"))
    chunks = written(chunk_recursive(parts).withColumnRenamed("doc", "source").withColumn("content_key", content_key("content")), "chunks")
    keys = chunks.select("source", "content_key").distinct()
    inside = batch_duplicates(keys, checkpoint=lambda df: written(df, "duplicates")).select("source", "owner")
    others = table(spark, store, "papers").filter(F.col("batch") < batch).groupBy("source").agg(F.max_by(F.struct("status", "batch"), "batch").alias("p")).filter("p.status = 'indexed'").select("source", F.col("p.batch").alias("batch"))
    stored = table(spark, store, "chunks").join(others, ["source", "batch"], "left_semi").select("source", "content_key")
    held = library_owner(keys, stored).select("source", F.col("owner").alias("stored_owner"))
    counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunk_count"))
    judged = texts.select("source", "path").join(inside, "source", "left").join(held, "source", "left").join(counts, "source", "left")
    owner = F.coalesce("stored_owner", "owner")
    status = F.when(owner.isNotNull(), "duplicate").otherwise("indexed")
    judged = written(judged.select("source", "path", status.alias("status"), owner.alias("owner"), F.when(owner.isNull(), F.coalesce("chunk_count", F.lit(0))).otherwise(0).cast("long").alias("chunk_count")), "judged")
    prefix = F.when(F.lower(F.col("source")).rlike(r"\.(md|markdown)$"), "sec").otherwise("blk")
    kept = chunks.join(judged.filter("status = 'indexed'").select("source"), "source", "left_semi")
    kept = kept.withColumn("chunk_id", chunk_id(F.col("source"), prefix, F.col("section_no").cast("string"), F.col("content"), F.col("chunk_index"), F.col("content_key")))
    chunks_in = _put(kept.withColumn("section_no", F.col("section_no").cast("int")), store, "chunks", batch)
    papers_in = _put(judged, store, "papers", batch)
    counted = [refused.count(), *papers_in.agg(F.count_if(F.col("status") == "duplicate"), F.count_if(F.col("status") == "indexed")).first(), chunks_in.count()]
    _put(spark.createDataFrame([(counted[0] + counted[1] + counted[2], *counted)], SCHEMAS["ledger"].rpartition(", ")[0]), store, "ledger", batch)
    for held in (several, checked, chunks, judged):
        held.unpersist()


def ingest_stream(files: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Batches of a stream of files (FILES), each through ingest_batch; what is there at the start, then it ends."""
    return files.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, batch, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, a_batch: int = 1000) -> DataFrame:
    """Files below a folder as they arrive, at most `a_batch` a time."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", a_batch).load(folder)


def stored_name(files: DataFrame) -> DataFrame:
    """S17 for a stream of files: the key under which each one's bytes are kept."""
    return files.select("path", storage_key(F.col("content"), F.col("path")).alias("key"))
