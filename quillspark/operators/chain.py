"""The whole of a retrieval: recall from both lists, over-fetch, dedupe, gate, rerank, context; and what each layer holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import norm_for_match
from quillspark.operators.evaluate import ceiling_verdict
from quillspark.operators.retrieval import AMBIGUOUS, CONTEXT_CAP, DEPTH, REJECT, Bm25Index, bm25_best, bm25_scores, content_dedupe, context_neighbors, hybrid_search, rerank, top, vector_topk, written

#: Candidates asked of the fused lists for each that is kept after equal contents are folded.
OVERFETCH, CANDIDATES = 3, 10


def fused(queries: DataFrame, items: DataFrame, index: Bm25Index, limit: int, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, vector list) of queries(query_id, text, v) over items(doc, v, source).

    allowed(query_id, source) keeps items out of the vector scan before, and out of the keyword list after scoring,
    whose statistics are the whole corpus's. Keyword scores that differ by rounding alone are ties.
    """
    vector = written(vector_topk(queries.select("query_id", "v"), items.select("doc", "v", "source"), allowed=allowed), "vector")
    if allowed is None:
        keyword = bm25_best(index, queries, "query_id", "text", digits=9)
    else:
        scores = bm25_scores(index, queries, "query_id", "text").join(items.select("doc", "source"), "doc").join(allowed, ["query_id", "source"], "left_semi").drop("source")
        keyword = top(scores, DEPTH, F.round("score", 9).desc(), F.asc("doc"))
    return written(hybrid_search(vector, keyword, limit), "pool"), vector


def retrieve(queries: DataFrame, items: DataFrame, index: Bm25Index, allowed: DataFrame | None = None, candidates: int = CANDIDATES, top_n: int = CANDIDATES, score: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, outcomes) of queries(query_id, text, v) over items(doc, v, source, chunk_ord, content_key, text).

    Three times the candidates are fused, so that folding equal contents leaves enough. Queries that the gate rejects
    keep no hits. `score` of a query's and a passage's text orders the rest, on what the gate lets through; context
    chunks follow the hits. hits: query_id, rank, doc, origin, vector_score; outcomes: query_id, vector_top1,
    rejected, ambiguous.
    """
    pool, vector = fused(queries, items, index, candidates * OVERFETCH, allowed)
    kept = written(content_dedupe(pool.join(items.select("doc", "content_key"), "doc"), candidates), "kept")
    first = vector.filter("rank = 1").select("query_id", F.col("score").alias("top1"))
    some = kept.select("query_id").distinct().withColumn("some", F.lit(True))
    t = F.coalesce("top1", F.lit(0.0))
    rejected = (t < REJECT) | F.col("some").isNull()
    outcomes = queries.select("query_id").join(first, "query_id", "left").join(some, "query_id", "left").select("query_id", t.alias("vector_top1"), rejected.alias("rejected"), (~rejected & (t < AMBIGUOUS)).alias("ambiguous"))
    passed = kept.join(outcomes.filter("NOT rejected").select("query_id"), "query_id", "left_semi")
    places = items.select("doc", "source", "chunk_ord")
    if score is None:
        ordered = passed.filter(F.col("rank") <= top_n)
    else:
        both = passed.join(items.select("doc", "text"), "doc").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
        ordered = rerank(both, top_n, score(F.col("asked"), F.col("text")))
    hits = ordered.join(places, "doc").select("query_id", "rank", "doc", "origin", "vector_score", "source", "chunk_ord")
    n = hits.groupBy("query_id").agg(F.max("rank").alias("n"))
    near = context_neighbors(hits, places, CONTEXT_CAP).withColumnRenamed("rank", "place").join(places, ["source", "chunk_ord"]).join(n, "query_id")
    context = near.select("query_id", (F.col("n") + F.col("place")).cast("int").alias("rank"), "doc", "origin", F.lit(None).cast("double").alias("vector_score"))
    return hits.drop("source", "chunk_ord").unionByName(context), outcomes


def evidence_score(questions: DataFrame, hits: DataFrame, score: Callable[[Column, Column], Column] | None) -> DataFrame:
    """questions(query_id, question), hits(query_id, text), context too: the best pair score of the original question; null without hits.

    Other than a rerank it has no fallback: without a scorer it raises.
    """
    if score is None:
        raise ValueError("evidence_score needs a pair scorer")
    best = hits.join(questions, "query_id").groupBy("query_id").agg(F.max(score(F.col("question"), F.col("text"))).alias("evidence"))
    return questions.select("query_id").join(best, "query_id", "left")


def hit_log(hits: DataFrame) -> DataFrame:
    """A5: hits(query_id, rank, title, page, score, origin) as each query's ordered list, scores to three places."""
    entry = F.struct("rank", "title", "page", F.round("score", 3).alias("score"), "origin")
    return hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda h: h.dropFields("rank")).alias("hits"))


def anchor_layers(anchors: DataFrame, pool: DataFrame, hits: DataFrame, outcomes: DataFrame, texts: DataFrame) -> DataFrame:
    """In which place each layer has a passage with the anchor, for each form of a query.

    anchors(item, anchor, form, query_id): form `anchor` or `question`, query_id the query of that form. pool and
    hits(query_id, rank, doc): the fused candidates, and what the whole chain returns. Only texts(doc, text) of hits
    are searched. Returns item, anchor, form, pool_rank, prod_rank, rejected, vector_top1.
    """
    layers = pool.select("query_id", "doc", F.lit("pool").alias("layer"), "rank").unionByName(hits.select("query_id", "doc", F.lit("prod").alias("layer"), "rank"))
    asked = anchors.select("query_id", "item", "anchor", "form", norm_for_match("anchor").alias("needle"))
    layers = written(layers, "layers")  # so that its size is known, and texts stay where they lie
    held = written(texts.join(layers.select("doc").distinct(), "doc", "left_semi").select("doc", "text"), "texts")
    met = layers.join(held.select("doc", norm_for_match("text").alias("norm")), "doc").join(asked, "query_id").filter(F.contains("norm", "needle"))
    at = lambda layer: F.min(F.when(F.col("layer") == layer, F.col("rank"))).alias(f"{layer}_rank")
    ranks = met.groupBy("item", "anchor", "form").agg(at("pool"), at("prod"))
    return anchors.join(ranks, ["item", "anchor", "form"], "left").join(outcomes.select("query_id", "rejected", "vector_top1"), "query_id", "left").select("item", "anchor", "form", "pool_rank", "prod_rank", F.coalesce("rejected", F.lit(True)).alias("rejected"), F.coalesce("vector_top1", F.lit(0.0)).alias("vector_top1"))


def ceilings(layers: DataFrame, counts: DataFrame) -> DataFrame:
    """Of anchor_layers and counts(anchor, n), chunks that hold an anchor: an item's verdict, its scarcest anchor and how many fail where."""
    own, asked = F.col("form") == "anchor", F.col("form") == "question"
    lost = F.col("prod_rank").isNull()
    by = layers.join(counts, "anchor", "left").groupBy("item").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("min_chunks"),
        F.count_if(own & F.col("pool_rank").isNull()).alias("missing"),
        F.count_if(own & lost & F.col("rejected")).alias("blocked"),
        F.count_if(own & lost & ~F.col("rejected")).alias("unranked"),
        F.count_if(asked & lost).alias("unbridged"),
    )
    some = lambda c: F.col(c) > 0
    return by.select("*", ceiling_verdict(some("missing"), some("blocked"), some("unranked"), some("unbridged")).alias("verdict"))


def ceiling_tally(items: DataFrame) -> DataFrame:
    """One row over ceilings(): items, reachable in each layer, verdicts, brittle (three chunks or fewer) and unique ones."""
    none = lambda *names: F.count_if(sum((F.col(n) for n in names), F.lit(0)) == 0)
    verdicts = ("REACHABLE", "BRIDGE-GAP", "RANK-MISS", "GATE-BLOCKED", "RECALL-MISS")
    return items.agg(
        F.count(F.lit(1)).alias("items"), none("missing").alias("in_pool"), none("missing", "blocked", "unranked").alias("in_production"), none("unbridged").alias("by_question"),
        *[F.count_if(F.col("verdict") == v).alias(v.lower().replace("-", "_")) for v in verdicts],
        F.count_if(F.col("min_chunks") <= 3).alias("brittle"), F.count_if(F.col("min_chunks") == 1).alias("unique"),
    )
