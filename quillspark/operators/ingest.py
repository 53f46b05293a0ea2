"""Sections, chunks, duplicates and the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import ARXIV, arxiv_id, derive_year, digit_share, normalize_typography
from quillspark.operators.retrieval import written

CHUNK_SIZE, CHUNK_OVERLAP, MIN_SECTION, BLOCK_SIZE, DUPLICATE_SHARE = 800, 150, 50, 1500, 0.5
# Separators tried in this order.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
# The end of a line before one that matches ^#{1,6}\s+.*$ by itself.
HEADING = r"\n(?=#{1,6}[\s&&[^\n]]+[^\n\r\u0085\u2028\u2029]*[\r\u0085\u2028\u2029]?(?:\n|\z))"


def sections_markdown(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """A section begins at a heading unless nothing but headings' buffers came before; blank ones go after numbering."""
    parts = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, HEADING)).alias("pos", "text")).withColumn("section_no", F.col("pos") + 1)
    return parts.filter(F.trim(F.regexp_replace("text", r"\s+", "")) != "").select("doc", "section_no", F.col("section_no").cast("string").alias("label"), "text", F.lit("section").alias("kind"))


def sections_text(docs: DataFrame, doc: str, text: str, size: int = BLOCK_SIZE) -> DataFrame:
    """S3: paragraphs gathered into blocks until the next would make a block longer than size."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def add(s, p):
        full = (F.size(s["now"]) > 0) & (s["n"] + F.length(p) > size)
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(full, F.array(p)).otherwise(F.concat(s["now"], F.array(p))).alias("now"), F.when(full, F.length(p)).otherwise(s["n"] + F.length(p)).alias("n"))

    blocks = F.aggregate(paragraphs, start, add, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
    out = docs.select(F.col(doc).alias("doc"), F.posexplode(F.transform(blocks, lambda b: F.array_join(b, "\n\n"))).alias("pos", "text"))
    return out.select("doc", (F.col("pos") + 1).alias("section_no"), (F.col("pos") + 1).cast("string").alias("label"), "text", F.lit("block").alias("kind"))


def _edge(line):
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)\d", "#"), r"\s+", " ")))


def page_edge_noise(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_no, text) -> (doc_id, edge): first or last lines that half the pages share."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    edges = pages.select("doc_id", "page_no", F.explode_outer(F.array_distinct(F.transform(F.filter(F.array(F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(-1))), lambda x: x.isNotNull()), _edge))).alias("edge"))
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")).filter("pages >= 3")
    return edges.filter("edge IS NOT NULL").groupBy("doc_id", "edge").agg(F.count(F.lit(1)).alias("n")).join(n, "doc_id").filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2))).select("doc_id", "edge")


def page_clean(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """Lines that are noise go wherever they stand; words broken at a line's end are joined; F1."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("edge", _edge(F.col("line")))
    kept = lines.join(noise, ["doc_id", "edge"], "left_anti").groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("t"))
    clean = normalize_typography(F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)(\w)-\n(\w)", "$1$2"))
    return pages.select("doc_id", "page_no").join(kept, ["doc_id", "page_no"], "left").select("doc_id", "page_no", clean.alias("text"))


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the first separator that occurs, keep it at the next piece's start, merge up to size with overlap."""
    at = next((n for n, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    raw = list(text) if sep == "" else [p if n == 0 else sep + p for n, p in enumerate(text.split(sep))]
    out: list[str] = []
    fitting: list[str] = []

    def merge() -> None:
        window: list[str] = []
        held = 0
        for p in fitting:
            if window and held + len(p) > size:
                if chunk := "".join(window).strip():
                    out.append(chunk)
                while window and (held > overlap or (held + len(p) > size and held > 0)):
                    held -= len(window.pop(0))
            window.append(p)
            held += len(p)
        if chunk := "".join(window).strip():
            out.append(chunk)
        fitting.clear()

    for p in (p for p in raw if p):
        if len(p) < size:
            fitting.append(p)
            continue
        if fitting:
            merge()
        out += split_recursive(p, size, overlap, rest) if rest else [p]
    if fitting:
        merge()
    return out


def chunk_recursive(sections: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """sections(doc, section_no, text) of MIN_SECTION characters or more -> doc, section_no, chunk_index, kind, content."""
    fine = sections.filter(F.length(F.trim("text")) >= MIN_SECTION).select("doc", "section_no", F.when(digit_share("text") > 0.25, "table").otherwise("text").alias("kind"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = [split_recursive(t, size, overlap) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(chunks, pa.list_(pa.string()))], ["doc", "section_no", "kind", "chunks"])

    types = dict(fine.dtypes)
    split = fine.mapInArrow(run, f"doc {types['doc']}, section_no {types['section_no']}, kind string, chunks array<string>")
    return split.select("doc", "section_no", "kind", F.posexplode("chunks").alias("chunk_index", "content"))


def with_chunk_ord(chunks: DataFrame) -> DataFrame:
    """Our order of chunks within a whole document, from 0."""
    return chunks.withColumn("chunk_ord", F.row_number().over(Window.partitionBy("doc").orderBy("section_no", "chunk_index")) - 1)


def containment(keys: DataFrame, other: DataFrame, least: float = 0.0) -> DataFrame:
    """Share of each source's distinct keys met in each other source: keys(source, content_key), other likewise.

    With `least` only shares of that much are looked for: such an owner has one at least of the source's rarest
    keys, so keys that very many sources hold propose no pairs.
    """
    # Keys that are costly to make are made once.
    a = written(keys.select("source", "content_key").distinct(), "keys")
    b = (a if other is keys else written(other.select("source", "content_key").distinct(), "others")).withColumnRenamed("source", "owner")
    n = a.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if least > 0:
        held = b.groupBy("content_key").agg(F.count(F.lit(1)).alias("df"))
        rarest = Window.partitionBy("source").orderBy("df", "content_key")
        known = a.join(held, "content_key").join(n, "source").withColumn("r", F.row_number().over(rarest))
        # Of the n keys so many may be missing; keys that no owner has come first among the rarest.
        known = known.withColumn("missing", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("source")))
        asks = known.filter(F.col("r") + F.col("missing") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("source", "content_key")
        pairs = asks.join(b, "content_key").filter("source <> owner").select("source", "owner").distinct()
        met = pairs.join(a, "source").join(b, ["owner", "content_key"])
    else:
        met = a.join(b, "content_key").filter("source <> owner")
    shared = met.groupBy("source", "owner").agg(F.count(F.lit(1)).alias("shared"))
    found = shared.join(n, "source").select("source", "owner", "shared", "n", (F.col("shared") / F.col("n")).alias("ratio"))
    return found.filter(F.col("ratio") >= least) if least > 0 else found


def batch_duplicates(keys: DataFrame, least: float = DUPLICATE_SHARE, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """In the order of sources, a source is a duplicate of the first kept earlier one that holds half its keys.

    Rounds: a source all of whose earlier holders are dropped is kept, one with a kept earlier holder is
    dropped; each round settles the earliest unsettled sources. Sources with the same keys have the same holders, so
    of these only the first goes through the rounds, and the others follow it: copies make no pairs with each other.
    Returns source, owner (null: kept).
    """
    keyed = F.sha2(F.to_json(F.sort_array(F.collect_set("content_key"))), 256)
    sets = checkpoint(keys.groupBy("source").agg(F.when(F.count("content_key") == F.count(F.lit(1)), keyed).otherwise(F.concat(F.lit("null, "), F.col("source").cast("string"))).alias("set")))
    firsts = sets.groupBy("set").agg(F.min("source").alias("first"))
    members = checkpoint(sets.join(firsts, "set").select("source", "first"))
    keys = keys.join(members.filter("source = first").select("source"), "source", "left_semi")
    held = checkpoint(containment(keys, keys, least).filter(F.col("owner") < F.col("source")).select("source", "owner"))
    settled = members.filter("source = first").select("source").distinct().join(held.select("source"), "source", "left_anti").select("source", F.lit(None).cast(dict(keys.dtypes)["source"]).alias("kept_by"))
    open_ = held
    while open_.take(1):
        kept, gone = settled.filter("kept_by IS NULL").select(F.col("source").alias("owner")), settled.filter("kept_by IS NOT NULL").select(F.col("source").alias("owner"))
        left = open_.join(gone, "owner", "left_anti")
        undecided = left.join(kept, "owner", "left_anti")
        first = left.join(kept, "owner", "left_semi").groupBy("source").agg(F.min("owner").alias("kept_by"))
        waits = undecided.join(first, "source").filter(F.col("owner") < F.col("kept_by")).select("source").distinct()
        dropped = first.join(waits, "source", "left_anti")
        free = open_.select("source").distinct().join(left.select("source"), "source", "left_anti").select("source", F.lit(None).cast(dict(keys.dtypes)["source"]).alias("kept_by"))
        settled = checkpoint(settled.unionByName(dropped.select("source", "kept_by")).unionByName(free))
        open_ = checkpoint(left.join(settled.select("source"), "source", "left_anti"))
    of = settled.select(F.col("source").alias("first"), "kept_by")
    return members.join(of, "first").select("source", F.coalesce("kept_by", F.when(F.col("source") != F.col("first"), F.col("first"))).alias("owner"))


def library_owner(new: DataFrame, library: DataFrame, least: float = DUPLICATE_SHARE) -> DataFrame:
    """The stored source that holds most of a new one's keys, if it holds half."""
    best = containment(new, library, least).groupBy("source").agg(F.max(F.struct("shared", F.col("owner"))).alias("b"), F.first("n").alias("n"))
    return best.filter(F.col("b.shared") / F.col("n") >= least).select("source", F.col("b.owner").alias("owner"), (F.col("b.shared") / F.col("n")).alias("ratio"))


def catalog_upsert(old: DataFrame, new: DataFrame, key: str = "source_file") -> DataFrame:
    """A new row takes the place of the old one with its key, blank fields too; of several new ones the largest by its fields."""
    both = old.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_b"), *[F.desc(c) for c in old.columns if c != key]))).filter("_n = 1").drop("_b", "_n")


def fill_blank(papers: DataFrame, form: str = ARXIV) -> DataFrame:
    """A missing year or external id is filled from the file's name and the title; what is there stays."""
    found = F.coalesce(F.nullif("external_id", F.lit("")), arxiv_id("source_file", form), arxiv_id("title", form), F.col("external_id"))
    return papers.withColumn("year", F.coalesce("year", derive_year("source_file", "title", form=form))).withColumn("external_id", found)


def catalog_prune(papers: DataFrame, keep: DataFrame, prefix: str, key: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """Rows below prefix that aren't in keep go; returns (left, deleted)."""
    gone = papers.filter(F.col(key).startswith(prefix)).join(keep, key, "left_anti")
    return papers.join(gone.select(key), key, "left_anti"), gone


def delete_documents(chunks: DataFrame, papers: DataFrame, asked: DataFrame, forced: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of the sources asked for, those not pending or in work (or all, if forced) leave both tables."""
    fine = papers.join(asked, "source_file", "left_semi")
    fine = (fine if forced else fine.filter(~F.col("status").isin(0, 3))).select("source_file")
    return chunks.join(fine.withColumnRenamed("source_file", "source"), "source", "left_anti"), papers.join(fine, "source_file", "left_anti")


def manifest_sync(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """current(file, auto_title, auto_source) with what people filled into the manifest, blank where they didn't.

    `_auto` and `_auto_source` are renewed; `misplaced` tells a file without a title whose stored `_auto` isn't what
    is derived now, as if it had been edited by hand. Files that aren't there any more leave the manifest.
    """
    # The fields that people fill.
    human = ["title", "authors", "venue", "year", "external_id"]
    told = manifest.select("file", *human, F.col("_auto").alias("_was") if "_auto" in manifest.columns else F.lit(None).cast("string").alias("_was"))
    j = current.join(told, "file", "left")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    title, was = F.trim(blank("title")), F.trim(F.coalesce("_was", F.lit("")))
    return j.select("file", title.alias("title"), *[blank(c).alias(c) for c in human[1:]], F.col("auto_title").alias("_auto"), F.col("auto_source").alias("_auto_source"), ((title == "") & (was != "") & (was != F.col("auto_title"))).alias("misplaced"))


def insert_missing(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """S25."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def apply_progress(papers: DataFrame, log: DataFrame) -> DataFrame:
    """The latest status of each paper; the error (500 characters at most) stays only on failure."""
    last = log.groupBy("id").agg(F.max(F.struct("at", "status", "error", "chunk_count")).alias("l"))
    joined = papers.join(last, "id", "left")
    status = F.coalesce("l.status", "status")
    error = F.when(F.col("l.status").isNull(), F.col("error")).when(F.col("l.status") == 2, F.substring("l.error", 1, 500))
    indexed = F.when(F.col("l.status") == 1, F.col("l.at")).otherwise(F.col("indexed_at"))
    return joined.select("id", status.alias("status"), F.coalesce("l.chunk_count", "chunk_count").alias("chunk_count"), error.alias("error"), indexed.alias("indexed_at"))
