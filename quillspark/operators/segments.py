"""A keyword index in segments that follows its documents instead of being built anew.

An index is a folder. Nothing in it is ever changed; an update adds a segment and then a snapshot that counts it in:

    postings/segment=n    doc, digest, dl, words, tfs  of the documents that were new or changed, a row each
    terms/segment=n       term, df                   of the same documents
    held/segment=n        doc, digest, dl            the same documents
    tombstones/segment=n  doc, dead                  documents of segment `dead` that changed or went away
    snapshots/snapshot=n  digest, docs, tokens       written last: without it the segment doesn't count

Readers leave out what tombstones name and correct document frequencies and totals by it, so scores equal those of
an index built from scratch. Whether documents have changed shows in a digest over all of them, not in their number.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.retrieval import Bm25Index, bm25_index, counted_documents, weighted, written

#: A new segment is built from all documents, instead of the changed ones, once tombstones name more than this share of what is stored.
REBUILD_SHARE = 0.5


def snapshot_digest(docs: DataFrame, doc: str = "doc", text: str = "text") -> str:
    """A digest of a set of documents, whatever their order: equal for equal sets, one pass of sums."""
    h = F.xxhash64(F.col(doc), F.col(text))
    other = F.xxhash64(F.lit(1), F.col(text), F.col(doc))
    n, a, b = docs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(other.cast("decimal(38,0)"))).first()
    return f"{n}-{(a or 0) & (1 << 64) - 1:016x}-{int(b or 0):x}"


def _table(spark: SparkSession, root: str, name: str, schema: str, up_to: int) -> DataFrame:
    key = "snapshot" if name == "snapshots" else "segment"
    try:
        return spark.read.schema(f"{schema}, {key} int").parquet(f"{root}/{name}").filter(F.col(key) <= up_to)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, {key} int")


def latest_snapshot(spark: SparkSession, root: str) -> dict | None:
    """The last finished snapshot: its number, digest, documents and tokens."""
    row = _table(spark, root, "snapshots", "digest string, docs long, tokens long", 1 << 30).orderBy(F.desc("snapshot")).limit(1).collect()
    return row[0].asDict() if row else None


def is_stale(docs: DataFrame, root: str) -> bool:
    """Whether the index at root is of other documents(doc, text) than these; a change that keeps their number shows too."""
    now = latest_snapshot(docs.sparkSession, root)
    return now is None or now["digest"] != snapshot_digest(docs)


def live_documents(spark: SparkSession, root: str, doc_type: str, snapshot: int) -> DataFrame:
    """doc, digest, dl, segment of the documents that a snapshot holds."""
    held = _table(spark, root, "held", f"doc {doc_type}, digest long, dl long", snapshot)
    dead = _table(spark, root, "tombstones", f"doc {doc_type}, dead int", snapshot).select("doc", F.col("dead").alias("segment"))
    return held.join(dead, ["doc", "segment"], "left_anti")


def update_index(docs: DataFrame, root: str) -> int:
    """Bring the index at root up to documents(doc, text), doc unique; returns the snapshot. Only new and changed ones are tokenized.

    What is half written by an update that didn't end is overwritten by the next one.
    """
    spark, doc_type = docs.sparkSession, dict(docs.dtypes)["doc"]
    digest, last = snapshot_digest(docs), latest_snapshot(spark, root)
    if last and last["digest"] == digest:
        return last["snapshot"]
    n = last["snapshot"] + 1 if last else 0
    given = docs.select("doc", "text", F.xxhash64("text").alias("digest"))
    stored = live_documents(spark, root, doc_type, n - 1)
    state = stored.select("doc", F.col("digest").alias("was"), "segment")
    diff = written(given.select("doc", "digest").join(state, "doc", "full_outer").filter(~F.col("digest").eqNullSafe(F.col("was"))), "diff")
    gone = diff.filter("segment IS NOT NULL").select("doc", F.col("segment").alias("dead"))
    # Where nothing is stored all are new, and their texts stay where they lie.
    fresh = given.join(diff.filter("digest IS NOT NULL").select("doc"), "doc", "left_semi") if last else given
    if last and gone.count() > REBUILD_SHARE * stored.count():
        gone, fresh = stored.select("doc", F.col("segment").alias("dead")), given
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/segment={n}")
    put(gone, "tombstones")
    put(counted_documents(fresh), "postings")
    postings = spark.read.parquet(f"{root}/postings/segment={n}")
    put(postings.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    put(postings.select("doc", "digest", "dl"), "held")
    live = live_documents(spark, root, doc_type, n).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
    live.select(F.lit(digest).alias("digest"), "docs", "tokens").write.mode("overwrite").parquet(f"{root}/snapshots/snapshot={n}")
    diff.unpersist()
    return n


def read_index(spark: SparkSession, root: str, doc_type: str, snapshot: int | None = None, words: DataFrame | None = None) -> Bm25Index:
    """The index as of a snapshot (the last): live postings, with frequencies and totals corrected by tombstones. With words(term) its terms are these alone."""
    last = latest_snapshot(spark, root)
    at = last["snapshot"] if snapshot is None else snapshot
    totals = last if at == last["snapshot"] else _table(spark, root, "snapshots", "digest string, docs long, tokens long", at).filter(F.col("snapshot") == at).first()
    dead = _table(spark, root, "tombstones", f"doc {doc_type}, dead int", at).select("doc", F.col("dead").alias("segment"))
    documents = _table(spark, root, "postings", f"doc {doc_type}, dl long, words array<string>, tfs array<long>", at)
    asked = lambda df: df if words is None else df.join(words.select("term").distinct(), "term", "left_semi")
    lost = asked(documents.join(dead, ["doc", "segment"], "left_semi").select(F.explode("words").alias("term"))).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
    df = asked(_table(spark, root, "terms", "term string, df long", at).select("term", "df")).unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    avgdl = totals["tokens"] / max(1, totals["docs"])
    live = documents.join(dead, ["doc", "segment"], "left_anti").select("doc", "dl", "words", "tfs")
    return Bm25Index(live, weighted(df, totals["docs"]), totals["docs"], avgdl if avgdl > 0 else 1.0)


#: Indexes of this session by application and the digest of their documents.
_shared: dict[tuple[str, str], Bm25Index] = {}


def shared_index(docs: DataFrame, doc: str, text: str, words: DataFrame | None = None) -> Bm25Index:
    """R1 for documents that were indexed before in this session: found by their digest, else built. With words(term) it may be of these terms alone.

    It lies in the folder that spark.checkpoint.dir names, as one segment, or is persisted where that is unset.
    """
    spark = docs.sparkSession
    key = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", "") + snapshot_digest(docs, doc, text)
    if key in _shared or words is None:
        if key not in _shared:
            _shared[key] = bm25_index(docs, doc, text)
        return _shared[key]
    some = words.select("term").distinct()
    key = key[0], f"{key[1]} {snapshot_digest(some, 'term', 'term')}"
    if key not in _shared:
        _shared[key] = bm25_index(docs, doc, text, some)
    return _shared[key]
