"""Listing and lookup over the catalogue, chunks and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import ARXIV, STATUS_NAMES, derive_year


def list_papers(papers: DataFrame, year_from: int | None = None, author: str | None = None, collection: int | None = None, limit: int = 50) -> DataFrame:
    """Filter first, newest first, limit last."""
    out = papers if year_from is None else papers.filter(F.col("year") >= year_from)
    out = out if author is None else out.filter(F.col("authors").ilike(f"%{author}%"))
    out = out if collection is None else out.filter(F.col("collection_id") == collection)
    return out.orderBy(F.desc("id")).limit(limit)


def find_by_title(papers: DataFrame, keyword: str, limit: int = 5) -> DataFrame:
    """C2."""
    return papers.filter(F.contains(F.lower("title"), F.lit(keyword.lower()))).orderBy("id").limit(limit)


def papers_for_year(papers: DataFrame, year_from: int, form: str = ARXIV) -> DataFrame:
    """Sources of that year or later; an unknown year is left out."""
    return papers.withColumn("y", derive_year("source_file", "title", F.col("year"), form)).filter(F.col("y") >= year_from).select("source_file", F.col("y").alias("year"))


def allowed_sources(queries: DataFrame, *filters: DataFrame) -> DataFrame:
    """(query_id, source) of all filters; a query without any left finds nothing."""
    out = filters[0]
    for f in filters[1:]:
        out = out.join(f, ["query_id", "source"], "left_semi")
    return out.join(queries.select("query_id"), "query_id", "left_semi").distinct()


def passages_by_page(chunks: DataFrame) -> DataFrame:
    """C8."""
    return chunks.groupBy("source", "page_label").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_ord", "content"))), lambda x: x["content"]).alias("passages"))


def status_rollup(papers: DataFrame) -> DataFrame:
    """All four states, with papers and chunks."""
    spark = papers.sparkSession
    names = spark.createDataFrame(list(STATUS_NAMES.items()), "status int, name string")
    counts = papers.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_count").alias("c"))
    return names.join(counts, "status", "left").select("name", F.coalesce("n", F.lit(0)).alias("papers"), F.coalesce("c", F.lit(0)).alias("chunks"))


def paper_listing_text(papers: DataFrame, collection: int | None = None, form: str = ARXIV) -> DataFrame:
    """C4: papers(id, title, source_file, year, venue, authors, chunk_count) as lines: the year of submission, venue and authors where there are any."""
    some = papers if collection is None else papers.filter(F.col("collection_id") == collection)
    year = derive_year("source_file", "title", F.nullif("year", F.lit(0)), form)
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("| "), c))
    count = F.concat(F.lit("| "), F.coalesce("chunk_count", F.lit(0)).cast("string"), F.lit(" chunks indexed"))
    return some.select("id", F.concat_ws("  ", "title", F.concat(F.lit("("), year.cast("string"), F.lit(")")), given("venue"), given("authors"), count).alias("line"))


def conversation_index(messages: DataFrame) -> DataFrame:
    """The title is the first user message's first 50 characters."""
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return messages.groupBy("conv_id").agg(F.substring(F.min(user)["text"], 1, 50).alias("title"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("messages"))


def conversation_messages(messages: DataFrame) -> DataFrame:
    """C11: messages in order with the roles a client knows; other roles are left out."""
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai")
    rows = messages.select("conv_id", "turn", kind.alias("kind"), "text").filter("kind IS NOT NULL")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def rename_and_delete(index: DataFrame, renames: DataFrame, deletes: DataFrame) -> DataFrame:
    """C14."""
    left = index.join(deletes, "conv_id", "left_anti").join(renames.select("conv_id", F.col("title").alias("_t")), "conv_id", "left")
    return left.withColumn("title", F.coalesce("_t", "title")).drop("_t")


def key_lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """C15."""
    return rows.join(keys.select(key), key, "left_semi")


def distinct_titles(papers: DataFrame) -> DataFrame:
    """Each title once, as a line of a list."""
    return papers.filter(F.coalesce(F.trim("title"), F.lit("")) != "").select(F.concat(F.lit("- "), F.col("title")).alias("line")).distinct()


def list_collections(collections: DataFrame) -> DataFrame:
    """All, in the order of their ids."""
    return collections.orderBy("id")
