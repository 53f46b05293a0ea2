from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalog, chain
from quillspark.operators import evaluate as ev
from quillspark.operators import retrieval as rt
from quillspark.sources import builds

WORDS = ["apple", "river", "stone", "cloud", "tiger", "maple", "ocean", "candle", "violin", "rocket"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for n in range(60):
        text = " ".join(rng.choices(WORDS, k=6)) + f" w{n % 50}"
        rows.append((n, [rng.uniform(-0.1, 0.1) for _ in range(3)], f"s{n % 4}", n // 4, text if n < 50 else rows[n - 50][4]))
    items = spark.createDataFrame(rows, "doc long, v array<double>, source string, chunk_ord int, text string")
    return rows, rt.with_content_key(items, "text"), rt.bm25_index(items, "doc", "text")


def test_filtered_vectors_equal_all_pairs(spark, corpus):
    rows, items, _ = corpus
    queries = [(q, rows[q][1]) for q in range(0, 60, 7)]
    allowed = [(q, f"s{(q + k) % 4}") for q, _ in queries for k in range(q % 3)] + [(7, "none")]
    got = rt.vector_topk(spark.createDataFrame(queries, "query_id long, v array<double>"), items, 5, 4, spark.createDataFrame(allowed, "query_id long, source string"))
    want = []
    for q, v in queries:
        mine = {s for i, s in allowed if i == q}
        scored = sorted((-(1 - sum((a - b) ** 2 for a, b in zip(v, r[1], strict=True)) / 2**0.5), r[0]) for r in rows if r[2] in mine)
        want += [(q, n + 1, d, round(-s, 9)) for n, (s, d) in enumerate(scored[:5])]
    assert sorted((r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_chain(spark, corpus):
    rows, items, index = corpus
    queries = spark.createDataFrame([(1, "apple w3", rows[3][1]), (2, "zebra", [9.0, 9.0, 9.0]), (3, "river w7", rows[7][1])], "query_id long, text string, v array<double>")
    hits, outcomes = chain.retrieve(queries, items, index, candidates=5, top_n=4)
    told = {r.query_id: (r.rejected, r.ambiguous) for r in outcomes.collect()}
    assert told == {1: (False, False), 2: (True, False), 3: (False, False)}
    found = hits.join(items.select("doc", "content_key", "source", "chunk_ord"), "doc").collect()
    for q in (1, 3):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        first = [r for r in mine if r.origin != "context"]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(first) == 4 and len({r.content_key for r in first}) == 4
        assert 0 < len(mine) - len(first) <= 6 and all(r.vector_score is None for r in mine[4:])
        held = {(r.source, r.chunk_ord) for r in first}
        assert all((r.source, r.chunk_ord + 1) in held or (r.source, r.chunk_ord - 1) in held for r in mine[4:])
    assert not [r for r in found if r.query_id == 2]
    allowed = spark.createDataFrame([(1, "s1"), (3, "s2"), (3, "s3")], "query_id long, source string")
    own, _ = chain.retrieve(queries, items, index, allowed)
    sources = own.join(items.select("doc", "source"), "doc").select("query_id", "source").distinct().collect()
    assert {tuple(r) for r in sources} == {(1, "s1"), (3, "s2"), (3, "s3")}
    by_score, _ = chain.retrieve(queries, items, index, top_n=3, score=rt.lexical_overlap)
    assert by_score.filter("query_id = 1 AND rank = 1").join(items, "doc").select(F.contains("text", F.lit("w3"))).first()[0]


def test_overfetch_loses_no_hit_to_copies(spark):
    rows = [(n, [0.0, n / 1000], "s", n, f"same river text {n // 3}") for n in range(120)]
    items = rt.with_content_key(spark.createDataFrame(rows, "doc long, v array<double>, source string, chunk_ord int, text string"), "text")
    index = rt.bm25_index(items, "doc", "text")
    queries = spark.createDataFrame([(1, "nothing", [0.0, 0.0])], "query_id long, text string, v array<double>")
    pool, _ = chain.fused(queries, items, index, 30)
    hits, _ = chain.retrieve(queries, items, index, candidates=3, top_n=3)
    assert pool.count() == 20 and hits.filter("origin <> 'context'").count() == 3


def test_layers_and_ceilings(spark):
    anchors = [(i, a, f, q) for i, a, q in (("i1", "alpha", 1), ("i1", "beta", 2), ("i2", "gamma", 3), ("i3", "delta", 4), ("i4", "alpha", 1)) for f, q in (("anchor", q), ("question", 10 + q))]
    asked = spark.createDataFrame(anchors, "item string, anchor string, form string, query_id int")
    texts = spark.createDataFrame([(1, "x ALPHA y"), (2, "beta"), (3, "gamma 1"), (4, "nothing")], "doc int, text string")
    pool = spark.createDataFrame([(1, 2, 4), (1, 5, 1), (11, 1, 1), (2, 3, 2), (3, 9, 3), (13, 9, 3)], "query_id int, rank int, doc int")
    hits = spark.createDataFrame([(1, 1, 1), (11, 2, 1), (2, 1, 2), (12, 1, 2)], "query_id int, rank int, doc int")
    outcomes = spark.createDataFrame([(q, q == 3, 0.5) for q in (1, 2, 3, 4, 11, 12, 13, 14)], "query_id int, rejected boolean, vector_top1 double")
    layers = chain.anchor_layers(asked, pool, hits, outcomes, texts)
    got = {(r.item, r.anchor, r.form): (r.pool_rank, r.prod_rank, r.rejected) for r in layers.collect()}
    assert got["i1", "alpha", "anchor"] == (5, 1, False) and got["i1", "beta", "question"] == (None, 1, False) and got["i2", "gamma", "anchor"] == (9, None, True) and got["i3", "delta", "anchor"] == (None, None, False)
    items = chain.ceilings(layers, spark.createDataFrame([("alpha", 1), ("beta", 7), ("gamma", 3)], "anchor string, n long"))
    assert {r.item: (r.verdict, r.min_chunks) for r in items.collect()} == {"i1": ("REACHABLE", 1), "i2": ("GATE-BLOCKED", 3), "i3": ("RECALL-MISS", 0), "i4": ("REACHABLE", 1)}
    t = chain.ceiling_tally(items).first()
    assert (t["items"], t.in_pool, t.in_production, t.by_question, t.reachable, t.gate_blocked, t.recall_miss, t.brittle, t.unique) == (4, 3, 2, 2, 2, 1, 1, 4, 2)


def test_evidence_score(spark):
    q = spark.createDataFrame([(1, "river stone"), (2, "x")], "query_id int, question string")
    h = spark.createDataFrame([(1, "a river"), (1, "stone river bed")], "query_id int, text string")
    assert {r.query_id: r.evidence for r in chain.evidence_score(q, h, rt.lexical_overlap).collect()} == {1: 1.0, 2: None}
    with pytest.raises(ValueError):
        chain.evidence_score(q, h, None)
    log = chain.hit_log(spark.createDataFrame([(1, 2, "t", "3", 0.12345, "hybrid"), (1, 1, "u", "1", None, "keyword")], "query_id int, rank int, title string, page string, score double, origin string")).first()
    assert [tuple(x) for x in log.hits] == [("u", "1", None, "keyword"), ("t", "3", 0.123, "hybrid")]


RECORD = "type string, judged boolean, retrieval_hit boolean, evidence_hit boolean, verdict_correct boolean, concepts_covered int, concepts_total int, citation_ok boolean, violations int, scope_qualified boolean, parse_warnings int, tool_calls int, context_chars int, seconds double"


def test_eval_summary(spark):
    rows = [("A", True, True, True, False, 2, 3, True, 0, None, 0, 2, 101, 1.5), ("A", True, False, True, True, 1, 0, None, 0, None, 0, 3, 200, 2.0), ("A", False, True, True, True, 9, 1, True, 0, None, 1, None, 300, None), ("B", True, None, None, True, None, None, None, 2, True, None, 1, None, 4.0), ("C", False, None, None, True, None, None, None, None, None, None, 1, 0, 1.0)]
    got = {r.type: r.asDict() for r in ev.eval_summary(spark.createDataFrame(rows, RECORD)).collect()}
    assert set(got) == {"A", "B", None}
    a, b, all_ = got["A"], got["B"], got[None]
    assert (a["judged"], a["retrieval_recall"], a["evidence_recall"], a["verdict_accuracy"], a["avg_concept_coverage"], a["citation_ok_rate"]) == (2, 0.5, 1.0, 0.5, 0.833, 0.5)
    assert (b["over_claim_rate"], b["scope_qualified_rate"], b["retrieval_recall"]) == (1.0, 1.0, None)
    assert (all_["total"], all_["judged"], all_["not_judged"], all_["parse_warnings"], all_["metric_reliable"], all_["avg_tool_calls"], all_["avg_context_chars"], all_["avg_seconds"]) == (5, 3, 2, 1, False, 1.4, 120, 1.7)
    assert ev.eval_summary(spark.createDataFrame([], RECORD)).filter("total > 0").count() == 0


def test_runs_and_pages(spark):
    runs = spark.createDataFrame([("a", "1", "r1", 30, True), ("a", "2", "r2", 2, False), ("b", "1", "r3", 30, None)], "agent string, stamp string, run string, total int, metric_reliable boolean")
    assert {r.agent: (r.totals, r.consistent, r.unreliable) for r in ev.run_sizes(runs).collect()} == {"a": ([2, 30], False, ["2"]), "b": ([30], True, [])}
    assert [r.run for r in ev.last_runs(runs, 1).orderBy("run").collect()] == ["r2", "r3"]
    items = spark.createDataFrame([(1, "P", 3, None), (2, "P", 3, [4, 5, 4]), (3, "P", None, None), (4, None, 1, None), (5, "P", 7, [])], "item int, paper string, pdf_page int, pdf_pages array<int>")
    assert {r.item: r.pages for r in ev.expected_pages(items).collect()} == {1: ["3"], 2: ["4", "5"], 5: ["7"]}
    m = lambda *v: spark.createDataFrame(list(zip("abc", v, strict=True)), "metric string, value double")
    assert {r.metric: r.arrow for r in ev.metric_deltas(m(0.5, 0.5, 0.5), m(0.5 + 1e-12, 0.6, 0.4)).collect()} == {"a": "same", "b": "up", "c": "down"}
    v, c = spark.createDataFrame([(72, 6818)], "papers int, chunks int"), spark.createDataFrame([(80, 7000)], "papers int, chunks int")
    assert (ev.mark_verified(v, c, False).first().papers, ev.mark_verified(v, c, True).first().papers) == (72, 80)
    papers = spark.createDataFrame([(1, "A"), (2, "A"), (3, " "), (4, "B")], "id int, title string")
    assert sorted(r.line for r in catalog.distinct_titles(papers).collect()) == ["- A", "- B"] and [r.id for r in catalog.list_collections(papers).collect()] == [1, 2, 3, 4]


def test_builds(spark, tmp_path):
    samples = spark.createDataFrame([([("user", f"q{n} é"), ("assistant", "a")], f"s{n % 2}", "holdout" if n == 9 else "train") for n in range(10)], "messages array<struct<role:string,content:string>>, source string, split string").repartition(3)
    builds.write_training_set(samples, str(tmp_path / "set"), spark.createDataFrame([("blank", 2)], "reason string, count long"))
    manifest = json.loads((tmp_path / "set/train/manifest.json").read_text())
    assert manifest["rows"] == 9 and manifest["tally"] == {"s0": 5, "s1": 4} and json.loads((tmp_path / "set/train/build_stats.json").read_text())["rejected"] == {"blank": 2}
    lines = [json.loads(r.line) for r in builds.read_build(spark, str(tmp_path / "set/train")).collect()]
    assert len(lines) == 9 and set(lines[0]) == {"messages"} and (tmp_path / "set/train/dataset_info.json").exists() and not (tmp_path / "set/holdout/dataset_info.json").exists()
    broken = samples.select(F.when(F.col("split") == "holdout", F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("string").alias("line"))
    with pytest.raises(Exception):
        builds.write_build(broken, str(tmp_path / "broken"))
    assert not (tmp_path / "broken/manifest.json").exists() and not [p for p in (tmp_path / "broken").rglob("*.jsonl")]
    builds.write_build(samples.select(F.lit("x").alias("line")).limit(0), str(tmp_path / "none"))
    assert builds.read_build(spark, str(tmp_path / "none")).count() == 0


def test_report(spark, tmp_path):
    summary = spark.createDataFrame([("A.recall", "0.955"), ("process.seconds", None)], "metric string, value string")
    records = spark.createDataFrame([(f"A{n:02}", "A", "a|b") for n in range(30)], "item string, type string, verdict string")
    builds.write_report(summary, records, ["type", "verdict"], str(tmp_path / "r"))
    manifest = json.loads((tmp_path / "r/markdown/manifest.json").read_text())
    lines = [line for name in sorted(manifest["files"]) for line in (tmp_path / "r/markdown" / name).read_text().splitlines()]
    assert len(lines) == 6 + 2 + 5 + 30 and "| A.recall | 0.955 |" in lines and "| A07 | A | a\\|b |" in lines
    got = [r.line for r in builds.report_lines(summary, records, ["type", "verdict"]).orderBy("part", "key").collect()]
    assert got[:3] == ["# Report", "", "## Summary"] and got[6] == "| A.recall | 0.955 |" and got[-1] == "| A29 | A | a\\|b |"
