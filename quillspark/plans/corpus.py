"""Queries on documents, pages, labels and conversations: sections, catalogue, question data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import catalog, ingest
from quillspark.operators import evaluate as ev
from quillspark.plans.registry import registry
from quillspark.plans.retrieval import _NORM
from quillspark.sources.files import file_reason

QUERIES, SQL, query = registry()


def _keys(t):
    return t.documents.select("source", tx.content_key("text").alias("content_key"))


@query(f"""WITH k AS (SELECT DISTINCT source, sha1({_NORM.format(c='text')}) AS k FROM documents), n AS (SELECT source, count(*) AS n FROM k GROUP BY 1)
SELECT a.source, b.source AS owner, count(*) AS shared, n.n, round(count(*) / n.n, 6) AS ratio FROM k a JOIN k b ON a.k = b.k AND a.source <> b.source JOIN n ON n.source = a.source GROUP BY a.source, b.source, n.n""")
def source_containment(t):
    """Contents that sources share."""
    keys = _keys(t)
    return ingest.containment(keys, keys).withColumn("ratio", F.round("ratio", 6))


@query()
def chunks(t):
    """Documents in blocks, chunked; no SQL for the recursive split."""
    made = ingest.with_chunk_ord(ingest.chunk_recursive(ingest.sections_text(t.documents, "doc_id", "text")))
    name = F.concat(F.lit("doc-"), F.col("doc").cast("string"))
    return made.select("doc", "section_no", "chunk_index", "chunk_ord", "kind", F.length("content").alias("chars"), tx.chunk_id(name, F.lit("blk"), F.col("section_no").cast("string"), F.col("content"), F.col("chunk_index")).alias("chunk_id"))


@query("SELECT doc_id, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 6) AS digit_share, length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1) > 0.25 AS is_table FROM documents")
def table_tag(t):
    """S7."""
    share = tx.digit_share("text")
    return t.documents.select("doc_id", F.round(share, 6).alias("digit_share"), (share > 0.25).alias("is_table"))


@query(r"""WITH p AS (SELECT source, doc_id, list_filter(string_split('Volume ' || source || ' page ' || doc_id || chr(10) || text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
e AS (SELECT source, doc_id, unnest(list_distinct(list_transform([l[1], l[-1]], lambda x: lower(trim(regexp_replace(regexp_replace(x, '[0-9]', '#', 'g'), '\s+', ' ', 'g')))))) AS edge FROM p WHERE len(l) > 0),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 3)
SELECT source AS doc_id, edge FROM e JOIN n USING (source) GROUP BY source, edge, n HAVING count(*) >= greatest(2, n // 2)""")
def page_edge_noise(t):
    """A source's documents as the pages of one work, each under a running head."""
    head = F.concat(F.lit("Volume "), "source", F.lit(" page "), F.col("doc_id").cast("string"), F.lit("\n"))
    return ingest.page_edge_noise(t.documents.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.concat(head, "text").alias("text")))


@query(r"""WITH u AS (SELECT page_id, url || ['', '.PDF', '.txt', '.md', '.docx', '.text'][page_id % 6 + 1] AS url, CASE WHEN page_id % 12 = 1 THEN '%PDF-' WHEN page_id % 12 = 8 THEN chr(0) WHEN page_id % 12 = 4 THEN 'PK' ELSE '' END || html AS h, CASE WHEN page_id % 30 = 3 THEN 60000000 ELSE strlen(html) END AS size FROM pages),
n AS (SELECT *, regexp_replace(regexp_replace(url, '^.*[/\\]', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS base, lower(regexp_extract(url, '\.[^./]+$')) AS ext FROM u)
SELECT page_id, left(base, least(length(base) - length(regexp_extract(base, '\.[^.]*$')), 120 - length(regexp_extract(base, '\.[^.]*$')))::INT) || regexp_extract(base, '\.[^.]*$') AS name, CASE WHEN ext NOT IN ('.pdf', '.md', '.markdown', '.docx', '.txt', '.text') THEN 'unsupported_extension' WHEN size > 52428800 THEN 'too_large'
WHEN (ext = '.pdf' AND NOT starts_with(h, '%PDF-')) OR (ext = '.docx' AND NOT starts_with(h, 'PK')) THEN 'bad_magic' WHEN ext NOT IN ('.pdf', '.docx') AND contains(left(h, 4096), chr(0)) THEN 'binary_text' ELSE '' END AS reason FROM n""")
def file_checks(t):
    """Pages as uploads named by their addresses, with extensions, leading bytes and sizes by their numbers."""
    i = F.col("page_id")
    url = F.concat("url", F.element_at(F.array(*map(F.lit, ("", ".PDF", ".txt", ".md", ".docx", ".text"))), (i % 6 + 1).cast("int")))
    head = F.when(i % 12 == 1, "%PDF-").when(i % 12 == 8, "\0").when(i % 12 == 4, "PK").otherwise("")
    ext = F.lower(F.regexp_extract(url, r"(\.[^./]+)$", 1))
    reason = file_reason(ext, F.when(i % 30 == 3, 60_000_000).otherwise(F.octet_length("html")), F.concat(head, "html").cast("binary"))
    return t.pages.select("page_id", tx.safe_name(url).alias("name"), reason.alias("reason"))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, 0 AS b FROM documents UNION ALL SELECT doc_id, 'labelled', 1 FROM labels) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY b DESC) = 1""")
def catalog_upsert(t):
    """Labelled rows replace those of the documents."""
    return ingest.catalog_upsert(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", F.lit("labelled").alias("lang")), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE source LIKE 'src1%' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def catalog_prune(t):
    """Documents of sources under a prefix that have no label are deleted."""
    rows = t.documents.select("doc_id", "source")
    named = rows.withColumn("source_file", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    keep = named.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("source_file")
    return ingest.catalog_prune(named, keep, "src1")[1].select("doc_id", "source")


@query("SELECT CASE s WHEN 0 THEN 'pending' WHEN 1 THEN 'indexed' WHEN 2 THEN 'failed' ELSE 'indexing' END AS name, count(doc_id) AS papers, coalesce(sum(n_chars), 0)::BIGINT AS chunks FROM range(4) r(s) LEFT JOIN documents ON doc_id % 4 = s GROUP BY 1")
def status_rollup(t):
    """The document number's remainder as the status."""
    return catalog.status_rollup(t.documents.select((F.col("doc_id") % 4).cast("int").alias("status"), F.col("n_chars").alias("chunk_count")))


@query("SELECT doc_id AS id, lang, source FROM documents WHERE n_chars >= 2000 ORDER BY doc_id DESC LIMIT 50")
def list_papers(t):
    """The 50 newest long documents."""
    return catalog.list_papers(t.documents.select(F.col("doc_id").alias("id"), "lang", "source", F.col("n_chars").alias("year")), year_from=2000).select("id", "lang", "source")


@query("SELECT conv_id, left(arg_min(text, turn) FILTER (role = 'user'), 50) AS title, max(turn) AS last_turn, count(*) AS messages FROM conversations GROUP BY 1")
def conversation_index(t):
    """C10."""
    return catalog.conversation_index(t.conversations)


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS kind, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations WHERE role IN ('user', 'assistant')")
def conversation_messages(t):
    """C11."""
    return catalog.conversation_messages(t.conversations)


@query(f"SELECT conv_id, turn FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY {_NORM.format(c='text')} ORDER BY conv_id, turn) = 1")
def question_dedupe(t):
    """User turns."""
    return ev.question_dedupe(t.conversations.filter("role = 'user'"), "text", "conv_id", "turn").select("conv_id", "turn")


@query(f"""WITH u AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - item_id, left(text, CASE WHEN item_id % 2 = 0 THEN 10000 ELSE length(text) * 3 // 4 END) FROM benchmark), q AS (SELECT id, {_NORM.format(c='text')} AS n FROM u), e AS (SELECT item_id AS eval_id, {_NORM.format(c='text')} AS n FROM benchmark),
qg AS (SELECT id, n, list_distinct(list_transform(range(1, length(replace(n, ' ', ''))), lambda i: substr(replace(n, ' ', ''), i, 2))) AS g FROM q), eg AS (SELECT eval_id, n, list_distinct(list_transform(range(1, length(replace(n, ' ', ''))), lambda i: substr(replace(n, ' ', ''), i, 2))) AS g FROM e),
p AS (SELECT id, eval_id, CASE WHEN qg.n = eg.n THEN 1.0::DOUBLE ELSE len(list_intersect(qg.g, eg.g))::DOUBLE / (len(qg.g) + len(eg.g) - len(list_intersect(qg.g, eg.g))) END AS s FROM qg, eg)
SELECT id, eval_id, round(s, 6) AS similarity FROM p WHERE s >= 0.6""")
def eval_leaks(t):
    """T4: user turns, and passages whole or cut by a quarter, that are like a benchmark passage."""
    q = t.conversations.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    size = F.when(F.col("item_id") % 2 == 0, 10000).otherwise(F.floor(F.length("text") * 3 / 4).cast("int"))
    q = q.unionByName(t.benchmark.select((-1 - F.col("item_id")).alias("id"), F.substring("text", F.lit(1), size).alias("text")))
    return ev.leak_pairs(q, t.benchmark.select(F.col("item_id").alias("eval_id"), "text")).withColumn("similarity", F.round("similarity", 6))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('17:' || doc_id), doc_id) <= floor(0.95 * count(*) OVER ()) THEN 'train' ELSE 'holdout' END AS split FROM documents")
def train_holdout(t):
    """T7."""
    return ev.hash_split(t.documents.select("doc_id"), "doc_id", 17)


@query("""WITH c AS (SELECT source AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, text FROM documents), a AS (SELECT title, count(*) AS c FROM c GROUP BY 1),
w AS (SELECT title, unnest([0, 1, c // 2, c // 2 + 1, c - 1]) AS n, generate_subscripts([0, 1, c // 2, c // 2 + 1, c - 1], 1) AS slot FROM a)
SELECT title, string_agg(left(text, 700), chr(10) || '---' || chr(10) ORDER BY slot) AS snippets FROM w JOIN c USING (title, n) GROUP BY 1""")
def source_snippets(t):
    """A source's documents as the chunks of one work."""
    from pyspark.sql import Window

    c = t.documents.select(F.col("source").alias("title"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("n"), F.col("doc_id").alias("doc"))
    return ev.paper_snippets(c, t.documents.select(F.col("doc_id").alias("doc"), F.col("text").alias("content")))


@query("SELECT lang, count(*) AS judged, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate, count(*) FILTER (quality = 1 AND toxic = 0) AS clean FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def eval_summary(t):
    """Labels as judgements, by language."""
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("judged"), F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))


@query("WITH e AS (SELECT min(n_chars) FILTER (quality = 1) AS y, max(n_chars) FILTER (quality = 0) AS n FROM documents JOIN labels USING (doc_id)) SELECT y AS yes_min, n AS no_max, y > n AS separable, CASE WHEN y > n THEN (y + n) / 2 END AS threshold FROM e")
def threshold_calibrate(t):
    """Does length tell good documents?"""
    rows = t.documents.join(t.labels, "doc_id").select(F.col("n_chars").alias("top1"), (F.col("quality") == 1).alias("expect"))
    return ev.threshold_calibrate(rows)


@query("SELECT count(*) AS papers, sum(n_chars)::BIGINT AS chunks FROM documents")
def corpus_fingerprint(t):
    """E10."""
    return ev.corpus_fingerprint(t.documents, "n_chars")
