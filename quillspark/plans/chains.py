"""The retrieval chain over documents that have a vector of equal number: filters, layers, ceilings, titles, evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import chain, segments, titles
from quillspark.operators import evaluate as ev
from quillspark.operators import retrieval as rt
from quillspark.plans.registry import registry
from quillspark.plans.retrieval import _BM25, _NORM, _bm25
from quillspark.sources.folders import shared_folder

QUERIES, SQL, query = registry()


def _chain_sql(forms: str, allowed: str | None) -> str:
    """CTEs up to hybrid (30 a query), outcomes and prod, for forms(query_id, text, item) and allowed(query_id, source)."""
    bm25 = _BM25.replace("FROM documents)", "FROM dv)").replace("item_id AS query_id", "query_id").replace("FROM benchmark)", "FROM forms)")
    bm25 = bm25[: bm25.rindex("bm25 AS")].rstrip().rstrip(",")
    mine = "JOIN allowed a ON a.query_id = {q} AND a.source = {s}" if allowed else ""
    return f"""
dv AS MATERIALIZED (SELECT doc_id, text, source, embedding::DOUBLE[] AS e, sha1({_NORM.format(c="text")}) AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents JOIN embeddings ON doc_id = vec_id),
forms AS ({forms}), {f"allowed AS ({allowed})," if allowed else ""} {bm25},
bm AS (SELECT s.query_id, s.doc, row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 9) DESC, s.doc) AS rank FROM scores s JOIN dv ON s.doc = dv.doc_id {mine.format(q="s.query_id", s="dv.source")} QUALIFY rank <= 20),
vs AS (SELECT f.query_id, i.doc_id AS doc, 1 - list_sum(list_transform(list_zip(q.embedding::DOUBLE[], i.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / sqrt(2) AS score FROM forms f JOIN embeddings q ON q.vec_id = f.item JOIN dv i ON true {mine.format(q="f.query_id", s="i.source")}),
vec AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM vs QUALIFY rank <= 20),
fused AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.doc, b.doc) AS doc, coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS rrf,
    CASE WHEN v.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'hybrid' WHEN v.rank IS NOT NULL THEN 'vector' ELSE 'keyword' END AS origin, v.score AS vector_score FROM vec v FULL JOIN bm b ON v.query_id = b.query_id AND v.doc = b.doc),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc) AS rank FROM fused QUALIFY rank <= 30),
folded AS (SELECT h.*, source, ord FROM hybrid h JOIN dv ON h.doc = dv.doc_id QUALIFY row_number() OVER (PARTITION BY h.query_id, k ORDER BY rank) = 1),
kept AS (SELECT query_id, doc, origin, vector_score, source, ord, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM folded QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10),
outcomes AS (SELECT f.query_id, coalesce(v.score, 0) AS vector_top1, coalesce(v.score, 0) < 0.35 OR f.query_id NOT IN (SELECT query_id FROM kept) AS rejected FROM forms f LEFT JOIN vec v ON v.query_id = f.query_id AND v.rank = 1),
hits AS (SELECT * FROM kept WHERE query_id IN (SELECT query_id FROM outcomes WHERE NOT rejected)),
near AS (SELECT query_id, source, ord + 1 AS ord, 0 AS pass, rank FROM hits UNION ALL SELECT query_id, source, ord - 1, 1, rank FROM hits),
first_ AS (SELECT query_id, source, ord, min(pass * 1000 + rank) AS first_at FROM near n WHERE EXISTS (FROM dv WHERE dv.source = n.source AND dv.ord = n.ord) AND NOT EXISTS (FROM hits h WHERE h.query_id = n.query_id AND h.source = n.source AND h.ord = n.ord) GROUP BY ALL),
context AS (SELECT query_id, source, ord, row_number() OVER (PARTITION BY query_id ORDER BY first_at, source, ord) AS place FROM first_ QUALIFY place <= 6),
prod AS (SELECT query_id, rank, doc, origin, vector_score FROM hits UNION ALL SELECT c.query_id, n + place, doc_id, 'context', NULL FROM context c JOIN dv USING (source, ord) JOIN (SELECT query_id, max(rank) AS n FROM hits GROUP BY 1) n ON n.query_id = c.query_id)
"""


def _items(t):
    """Documents with a vector as the chunks of their source, in the order of their numbers."""
    ids = t.documents.select("doc_id", "source").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), "doc_id")
    placed = ids.withColumn("chunk_ord", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    # Written, since each later use would join the texts and make their keys anew.
    return rt.written(rt.with_content_key(placed.join(t.documents.select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "doc"), "text"), "items")


def _questions(t):
    return t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("v"))


_FORMS = "SELECT item_id AS query_id, item_id AS item, text FROM benchmark JOIN embeddings ON item_id = vec_id"
_ALLOWED = "SELECT DISTINCT b.item_id AS query_id, d.source FROM benchmark b JOIN documents a ON a.doc_id = b.item_id JOIN documents d ON d.lang = a.lang AND d.doc_id % 7 = b.item_id % 7"


@query(f"WITH {_chain_sql(_FORMS, _ALLOWED)} SELECT query_id, rank, doc, origin, round(vector_score, 6) AS vector_score FROM prod")
def filtered_chain(t):
    """Each passage among sources that hold documents of a language and remainder of its own."""
    a = t.documents.select(F.col("doc_id").alias("query_id"), "lang").join(t.benchmark.select(F.col("item_id").alias("query_id")), "query_id")
    d = t.documents.select("lang", (F.col("doc_id") % 7).alias("r"), "source").distinct()
    allowed = a.withColumn("r", F.col("query_id") % 7).join(d, ["lang", "r"]).select("query_id", "source").distinct()
    items = _items(t)
    hits, _ = chain.retrieve(_questions(t), items, segments.shared_index(items, "doc", "text", rt.asked_terms(t.benchmark, "item_id", "text")), allowed)
    return hits.select("query_id", "rank", "doc", "origin", F.round("vector_score", 6).alias("vector_score"))


_BOTH = "SELECT -1 - item_id AS query_id, item_id AS item, 'anchor' AS form, substr(text, 12, 24) AS text, substr(text, 12, 24) AS anchor FROM benchmark JOIN embeddings ON item_id = vec_id UNION ALL SELECT item_id, item_id, 'question', text, substr(text, 12, 24) FROM benchmark JOIN embeddings ON item_id = vec_id"
_LAYERS = f"""{_chain_sql(_BOTH, None)},
texts AS (SELECT doc_id AS doc, {_NORM.format(c="text")} AS n FROM dv), needles AS (SELECT query_id, {_NORM.format(c="anchor")} AS needle FROM forms),
met AS (SELECT query_id, 'pool' AS layer, min(rank) AS rank FROM hybrid JOIN texts USING (doc) JOIN needles USING (query_id) WHERE contains(n, needle) GROUP BY 1 UNION ALL SELECT query_id, 'prod', min(rank) FROM prod JOIN texts USING (doc) JOIN needles USING (query_id) WHERE contains(n, needle) GROUP BY 1),
layers AS (SELECT item, form, anchor, (SELECT rank FROM met WHERE met.query_id = f.query_id AND layer = 'pool') AS pool_rank, (SELECT rank FROM met WHERE met.query_id = f.query_id AND layer = 'prod') AS prod_rank, rejected, vector_top1 FROM forms f JOIN outcomes USING (query_id))"""


def _layers(t):
    """A part of each passage as its anchor, asked for by itself and by the whole passage."""
    items, asked = _items(t), _questions(t)
    anchor = F.substring("text", 12, 24)
    forms = asked.select((-1 - F.col("query_id")).alias("query_id"), F.col("query_id").alias("item"), F.lit("anchor").alias("form"), anchor.alias("text"), anchor.alias("anchor"), "v").unionByName(asked.select("query_id", F.col("query_id").alias("item"), F.lit("question").alias("form"), "text", anchor.alias("anchor"), "v"))
    index = segments.shared_index(items, "doc", "text", rt.asked_terms(forms, "query_id", "text"))
    pool, _ = chain.fused(forms, items, index, chain.CANDIDATES * chain.OVERFETCH)
    hits, outcomes = chain.retrieve(forms, items, index)
    return chain.anchor_layers(forms.select("query_id", "item", "anchor", "form"), pool, hits, outcomes, items), items


@query(f"WITH {_LAYERS} SELECT item, form, pool_rank, prod_rank, rejected, round(vector_top1, 6) AS vector_top1 FROM layers")
def anchor_layers(t):
    """E14."""
    return _layers(t)[0].select("item", "form", "pool_rank", "prod_rank", "rejected", F.round("vector_top1", 6).alias("vector_top1"))


@query(f"""WITH {_LAYERS}, counts AS (SELECT anchor, count(*) FILTER (contains(n, {_NORM.format(c="anchor")})) AS n FROM (SELECT DISTINCT anchor FROM forms), texts GROUP BY 1),
i AS (SELECT item, min(n) AS min_chunks, count(*) FILTER (form = 'anchor' AND pool_rank IS NULL) AS missing, count(*) FILTER (form = 'anchor' AND prod_rank IS NULL AND rejected) AS blocked, count(*) FILTER (form = 'anchor' AND prod_rank IS NULL AND NOT rejected) AS unranked, count(*) FILTER (form = 'question' AND prod_rank IS NULL) AS unbridged FROM layers JOIN counts USING (anchor) GROUP BY 1)
SELECT item, min_chunks, CASE WHEN missing > 0 THEN 'RECALL-MISS' WHEN blocked > 0 THEN 'GATE-BLOCKED' WHEN unranked > 0 THEN 'RANK-MISS' WHEN unbridged > 0 THEN 'BRIDGE-GAP' ELSE 'REACHABLE' END AS verdict FROM i""")
def ceilings(t):
    """The verdict on each passage."""
    layers, items = _layers(t)
    counts = ev.probe_counts(items.select("doc", "text"), layers.select(F.col("anchor").alias("probe")), normal=True).withColumnRenamed("probe", "anchor")
    return chain.ceilings(layers, counts).select("item", "min_chunks", "verdict")


_TITLES = r"h AS (SELECT item_id AS hint_id, {ws} AS ws FROM (SELECT item_id, lower(left(text, 60)) AS h FROM benchmark)), d AS (SELECT doc_id AS id, lower(left(text, 200)) AS t FROM documents), s AS (SELECT hint_id, id, len(list_filter(ws, lambda w: contains(t, w))) AS k, len(ws) AS n FROM h, d)"


def _hints(t):
    return t.benchmark.select(F.col("item_id").alias("hint_id"), F.substring("text", 1, 60).alias("hint")), t.documents.select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("title"))


@query("WITH " + _TITLES.format(ws=r"list_filter(regexp_split_to_array(h, '[^\p{L}\p{N}_]+'), lambda w: length(w) > 2)") + " SELECT hint_id, id, round(k / n, 6) AS score FROM s WHERE k / n >= 0.3 QUALIFY row_number() OVER (PARTITION BY hint_id ORDER BY k DESC, id DESC) = 1")
def resolved_titles(t):
    """Openings of passages as hints, openings of documents as titles."""
    return titles.resolve_title(*_hints(t)).withColumn("score", F.round("score", 6))


@query("WITH " + _TITLES.format(ws="regexp_extract_all(h, '[a-z一-鿿]{3,}')") + " SELECT hint_id, id, k AS hits FROM s WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY hint_id ORDER BY k DESC, id DESC) = 1")
def cited_papers(t):
    """The same as the text before a citation."""
    return titles.citation_to_paper(*_hints(t))


@query(f"WITH {_BM25} SELECT query_id, doc, rank, round(score, 6) AS score FROM bm25")
def updated_index(t):
    """An index of documents of which some have changed since and some are new, brought up to date and asked."""
    spark = t.spark
    docs = t.documents.select(F.col("doc_id").alias("doc"), "text")
    before = docs.filter("doc % 3 <> 1").withColumn("text", F.when(F.col("doc") % 5 == 0, F.concat(F.lit("older words "), "text")).otherwise(F.col("text")))
    root = shared_folder(spark, "index")
    segments.update_index(before.unionByName(docs.limit(0)), root)
    segments.update_index(docs, root)
    index = segments.read_index(spark, root, dict(docs.dtypes)["doc"], words=rt.asked_terms(t.benchmark, "item_id", "text"))
    hits = rt.bm25_best(index, t.benchmark, "item_id", "text", digits=9)
    return hits.select("query_id", "doc", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25}, q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]')) AS q FROM benchmark) SELECT item_id AS query_id, round(max(len(list_intersect(q, list_distinct(t))) / greatest(len(q), 1)), 6) AS evidence FROM q LEFT JOIN bm25 ON query_id = item_id LEFT JOIN toks ON doc = doc_id GROUP BY 1")
def evidence_scores(t):
    """The share of a passage's words in the best of its hits."""
    hits = _bm25(t).select("query_id", "doc").join(t.documents.select(F.col("doc_id").alias("doc"), "text"), "doc").select("query_id", "text")
    scores = chain.evidence_score(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), hits, rt.lexical_overlap)
    return scores.select("query_id", F.round("evidence", 6).alias("evidence"))


@query(f"WITH {_BM25} SELECT query_id, string_agg(source || '/' || lang || '/' || printf('%.3f', round(score, 3)), ' ' ORDER BY rank) AS hits FROM bm25 JOIN documents ON doc = doc_id GROUP BY 1")
def hit_logs(t):
    """A5: titles, places and scores of each passage's hits, in order."""
    hits = _bm25(t).join(t.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("title"), F.col("lang").alias("page")), "doc").withColumn("origin", F.lit("keyword"))
    line = F.transform("hits", lambda h: F.concat_ws("/", h["title"], h["page"], F.format_string("%.3f", h["score"])))
    return chain.hit_log(hits).select("query_id", F.array_join(line, " ").alias("hits"))
