"""Functions on messages, sources and sections, over texts made of the given tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import messages as ms
from quillspark.functions import text as tx
from quillspark.operators import evaluate as ev
from quillspark.operators import ingest
from quillspark.operators import research as rs
from quillspark.plans.registry import registry

QUERIES, SQL, query = registry()


@query("SELECT event_id, props AS json FROM events")
def extracted_json(t):
    """the properties of events within text that has another brace before them."""
    return t.events.select("event_id", ms.extract_json(F.concat(F.lit("note {bad "), "props", F.lit(" end}"))).alias("json"))


@query("SELECT event_id, regexp_extract(props, '[0-9.]+')::DOUBLE AS k FROM events")
def dotted_values(t):
    """a value two levels down."""
    return t.events.select("event_id", tx.dotted_get(F.parse_json(F.concat(F.lit('{"A": '), "props", F.lit("}"))), "A.k").alias("k"))


@query("SELECT doc_id, (doc_id % 300 + 1)::INTEGER AS page, right(left(text, 200) || ' see ', 120) AS hint FROM documents")
def cited_pages(t):
    """openings of documents that cite a page twice."""
    page = (F.col("doc_id") % 300 + 1).cast("string")
    answer = F.concat(F.substring("text", 1, 200), F.lit(" see p."), page, F.lit(" and again p."), page)
    return t.documents.select("doc_id", F.explode(ms.citation_extract(answer)).alias("c")).select("doc_id", "c.page", "c.hint")


@query("SELECT doc_id, source AS title, (doc_id % 90)::VARCHAR AS page, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 50 + 25) / 100 END AS score FROM documents")
def source_blocks(t):
    """documents written as a tool's source blocks, found by vector or by words, and read again."""
    i = F.col("doc_id")
    block = ms.format_hit(i + 1, F.col("source"), F.lit("p"), (i % 90).cast("string"), F.when(i % 2 == 0, "vector").otherwise("keyword"), (i % 50 + 25) / 100, F.lit("text"), F.substring("text", 1, 80))
    s = t.documents.select("doc_id", F.explode(tx.parse_sources(block)).alias("s"))
    return s.select("doc_id", "s.title", "s.page", "s.score")


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[A-M]') THEN '# ' || x ELSE x END) AS l FROM documents), h AS (SELECT doc_id, l, list_filter(range(2, len(l) + 1), lambda i: regexp_matches(l[i], '^# ')) AS h FROM l)
SELECT doc_id, len(h) + (len(list_filter(l[1:coalesce(h[1] - 1, len(l))], lambda x: trim(x) <> '')) > 0)::INT AS sections FROM h WHERE len(h) + (len(list_filter(l[1:coalesce(h[1] - 1, len(l))], lambda x: trim(x) <> '')) > 0)::INT > 0""")
def markdown_sections(t):
    """Documents whose lines of some letters are headings."""
    marked = t.documents.select("doc_id", F.regexp_replace("text", r"(?m)^(?=[A-M])", "# ").alias("text"))
    return ingest.sections_markdown(marked, "doc_id", "text").groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("sections"))


@query("""SELECT doc_id AS query_id, source, CASE WHEN doc_id % 4 = 0 THEN label END AS page, CASE WHEN doc_id % 4 <> 0 THEN label END AS section, md5(text) AS excerpt FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE (doc_id % 10)::VARCHAR END AS label FROM documents)
WHERE doc_id % 4 < 3 AND trim(label) <> '' AND trim(text) <> ''""")
def evidence_drafts(t):
    """H2: documents as hits on pages, in sections, blocks and places of no kind."""
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "page").when(i % 4 == 1, "section").when(i % 4 == 2, "block").otherwise("other")
    hits = t.documents.select(i.alias("query_id"), "source", F.lit("c").alias("chunk_id"), F.col("text").alias("content"), F.when(i % 11 == 0, " ").otherwise((i % 10).cast("string")).alias("page_label"), kind.alias("locator_kind"), F.lit("p").alias("locator_prefix"), F.lit(1).alias("rank"), F.lit("vector").alias("origin"))
    return rs.evidence_drafts(hits).select("query_id", "source", "page", "section", F.md5(F.col("excerpt").cast("binary")).alias("excerpt"))


@query("SELECT doc_id, CASE WHEN n_chars > 900 THEN 'LOW RELEVANCE' ELSE 'MISSING FACETS' END AS reason FROM documents WHERE lang IN ('de', 'fr') AND doc_id % 5 < 3")
def retries(t):
    """A4: documents of two languages as open questions, short ones with something missing."""
    status = F.when(F.col("lang").isin("de", "fr"), "insufficient").otherwise("sufficient")
    missing = F.when(F.col("n_chars") > 900, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return ev.retry_selection(t.documents.select("doc_id", status.alias("status"), (F.col("doc_id") % 5).alias("round"), missing.alias("missing"))).select("doc_id", "reason")


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Page ' || page_id WHEN page_id % 2 = 0 THEN 'A & B ' || page_id ELSE trim(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\\.[^.]*$', '\\1'), '_+', ' ', 'g')) END AS title, CASE WHEN page_id % 5 = 0 THEN 'manual' WHEN page_id % 2 = 0 THEN 'metadata' ELSE 'filename' END AS origin FROM pages")
def page_titles(t):
    """Pages with a title given by hand, one within them, or none but their address."""
    i = F.col("page_id").cast("string")
    manual = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit(" Page "), i))
    inside = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("A &amp; B "), i)).otherwise("None")
    return t.pages.select("page_id", tx.resolved_title(manual, inside, "url").alias("t")).select("page_id", "t.title", "t.origin")
