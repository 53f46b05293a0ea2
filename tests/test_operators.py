from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import catalog, ingest, research
from quillspark.operators import evaluate as ev
from quillspark.operators import retrieval as rt
from quillspark.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_rrf_of_two_first_places(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 2)], "query_id int, doc string, rank int")
    assert dict(rows(rt.rrf_fuse(df).select("doc", "rrf"))) == {"a": pytest.approx(2 / 61), "b": pytest.approx(1 / 62)}


def test_bm25_prunes_all_terms_of_a_tiny_corpus(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(4)], "d int, t string")
    assert rt.bm25_index(docs, "d", "t").terms.filter("kept").count() == 0


def test_gate(spark):
    hits = spark.createDataFrame([(1, 0.4), (2, 0.6), (3, 0.1)], "query_id int, vector_score double")
    queries = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id int")
    assert [r[2:] for r in rows(rt.gate(hits, queries), "query_id")] == [(False, True), (False, False), (True, False), (True, False)]


def test_context(spark):
    chunks = spark.createDataFrame([("s", i) for i in range(5)], "source string, chunk_ord int")
    hits = spark.createDataFrame([(1, "s", 2, 1), (1, "s", 3, 2)], "query_id int, source string, chunk_ord int, rank int")
    assert [r[2] for r in rows(rt.context_neighbors(hits, chunks), "rank")] == [4, 1]


def test_sections(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n## B\ny"), (2, "")], "d int, t string")
    assert [(r[0], r[1], r[3]) for r in rows(ingest.sections_markdown(docs, "d", "t"), "doc", "section_no")] == [(1, 1, "# A\nx"), (1, 2, "## B\ny")]
    text = spark.createDataFrame([(1, "a" * 1000 + "\n\n" + "b" * 600 + "\n \n" + "c" * 100)], "d int, t string")
    assert [len(r[3]) for r in rows(ingest.sections_text(text, "d", "t"), "section_no")] == [1000, 702]


def test_chunks_fit_and_cover():
    text = ". ".join(f"sentence number {i} of some length" for i in range(200))
    chunks = ingest.split_recursive(text)
    assert max(map(len, chunks)) <= 800 and all(f"number {i} " in " ".join(chunks) for i in range(200))
    assert ingest.split_recursive("x" * 2000) and max(map(len, ingest.split_recursive("x" * 2000))) <= 800


def test_page_noise(spark):
    pages = spark.createDataFrame([(1, i, f"Journal {i}\nbody {'x' * i}-\nend\npage {i}") for i in range(4)], "doc_id int, page_no int, text string")
    noise = ingest.page_edge_noise(pages)
    assert {r[1] for r in rows(noise)} == {"journal #", "page #"}
    assert rows(ingest.page_clean(pages, noise), "page_no")[1][2] == "body xend"


def test_duplicates_follow_the_first_kept(spark):
    keys = [("a", k) for k in "1234"] + [("b", k) for k in "1256"] + [("c", k) for k in "5678"] + [("d", "9")]
    df = spark.createDataFrame(keys, "source string, content_key string")
    got = dict(rows(ingest.batch_duplicates(df, checkpoint=lambda x: spark.createDataFrame(x.collect(), x.schema))))
    assert got == {"a": None, "b": "a", "c": None, "d": None}  # b is dropped, so c, half of which is in b, stays


def test_rank_metrics(spark):
    m = ev.rank_metrics(spark.createDataFrame([(1, 1), (2, 4), (3, None)], "item int, rank int")).first()
    assert (m.n, m.hits, m.recall_1, m.recall_5, m.mean_rank) == (3, 2, pytest.approx(1 / 3), pytest.approx(2 / 3), 2.5)
    assert m.mrr == pytest.approx(1.25 / 3)


def test_leaks(spark):
    q = spark.createDataFrame([(1, "How does it work?"), (2, "how  does it work?"), (3, "unrelated text here"), (4, "How does it work so?")], "id int, text string")
    e = spark.createDataFrame([(9, "how does it work?")], "eval_id int, text string")
    assert [r[0] for r in rows(ev.leak_pairs(q, e), "id")] == [1, 2, 4]


def test_assess(spark):
    df = spark.createDataFrame([(-1.0, [], 1, "open"), (-5.0, [], 3, "open"), (0.0, ["x"], 3, "open"), (None, [], 1, "open"), (9.0, [], 1, "absent")], "s double, m array<string>, r int, st string")
    got = [r[0] for r in df.select(ev.assess_subquestion(F.col("s"), F.col("m"), F.col("r"), F.col("st"))).collect()]
    assert got == ["sufficient", "absent", "sufficient", "insufficient", "absent"]


def test_observation_goldens(spark):
    df = spark.createDataFrame([("e", "control", "mAP", 87.61), ("e", "treatment", "mAP", 88.21)], "x string, g string, m string, v double")
    r = research.observation_stats(df, "x", "g", "m", "v", "control", "treatment").first()
    assert (round(r["mean"], 2), round(r["delta"], 2)) == (87.91, 0.60)


def test_seal_detects_tampering(spark):
    sealed = research.seal(spark.createDataFrame([("q1", "text"), ("q2", None)], "research_question_id string, report string"))
    assert all(r[1] for r in rows(research.verify(sealed)))
    assert dict(rows(research.verify(sealed.withColumn("report", F.lit("other"))))) == {"q1": False, "q2": False}


def test_lineage_leaves_cycles_without_level(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, parent string")
    assert dict(rows(research.lineage_levels(spark, nodes))) == {"a": 0, "b": 1, "x": None, "y": None, "z": None}


def test_pending_and_backfill(spark):
    df = spark.createDataFrame([(None,), ("",), ("PROPOSED",), ("CONFIRMED",)], "s string")
    assert [r[0] for r in df.select(research.pending_review(F.col("s"))).collect()] == [True, True, True, False]
    assert research.schema_backfill(df, {"n": ("int", 3)}).select("n").distinct().collect()[0][0] == 3
    expected = spark.createDataFrame([("a", "s", "int", None), ("a", "t", "string", 9), ("b", "x", "int", None), ("a", "v", "string", 300), ("a", "w", "string", 9)], "table string, column string, type string, length int")
    bounded = lambda name, n: T.StructField(name, T.StringType(), True, {"__CHAR_VARCHAR_TYPE_STRING": f"varchar({n})"})
    tables = {"a": spark.createDataFrame([], T.StructType([T.StructField("s", T.StringType()), bounded("v", 200), bounded("w", 9)]))}
    found = sorted(map(str, map(tuple, research.schema_audit(expected, research.schema_rows(tables)).collect())))
    assert found == sorted(map(str, [("a", "s", "is string"), ("a", "t", "missing column"), ("b", None, "missing table"), ("a", "v", "holds 200 of 300 characters")]))
    assert research.schema_audit(research.schema_rows(tables), research.schema_rows(tables)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"a\x00b")
    (tmp_path / "d.exe").write_bytes(b"x")
    df = files.scan_files(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r.reason for r in df.withColumn("reason", files.file_reason(F.col("extension"), F.col("length"), F.col("content"))).collect()}
    assert got == {"a.pdf": "", "b.pdf": "bad_magic", "c.txt": "binary_text"}


def test_streams(spark, tmp_path):
    from quillspark.streaming import jobs

    spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "x"), (1, 2, "user", "y")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(tmp_path / "in"))
    q = jobs.conversation_stream(stream).writeStream.format("memory").queryName("conv").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert rows(spark.table("conv")) == [(1, "hello", 2)]


def test_runs_from_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("experiment_id,run_id,seed,metrics.mAP,config.group,artifact_paths\ne,r,1,87.5,control,a;b\n")
    r = files.read_runs(spark, str(tmp_path / "r.csv"), "csv").first()
    assert (r.metrics, r.config, r.artifact_paths) == ({"mAP": 87.5}, {"group": "control"}, ["a", "b"])


def test_messages(spark):
    from quillspark.functions import messages as ms

    df = spark.createDataFrame([('x {"b": {"a": "}"}} y', "see p.3 and p.3, 第 12 页")], "j string, a string")
    r = df.select(ms.extract_json("j").alias("j"), ms.citation_extract("a").alias("c")).first()
    assert r.j == '{"b": {"a": "}"}}' and [(c.page, c.hint) for c in r.c] == [(3, "see "), (12, "see p.3 and p.3, ")]
    plan = spark.createDataFrame([([("q", "person search")],), ([],), ([("q", "行人")],), ([("q", " ")],)], "p array<struct<question:string,query:string>>")
    assert [x[0] for x in plan.select(ms.plan_reject_reason(F.col("p"))).collect()] == ["", "no_sub_questions", "non_english_query", "blank_query"]


def test_research_rules(spark):
    h = spark.createDataFrame([("h1", "SUPPORTED"), ("h2", "REFUTED"), ("h3", "TESTABLE")], "id string, status string")
    links = spark.createDataFrame([("h1", "SUPPORT", "CONFIRMED"), ("h2", "CONTRADICT", "PROPOSED")], "id string, relation string, review_status string")
    assert rows(research.hypothesis_basis(h, links)) == [("h2", "REFUTED")]
    a = spark.createDataFrame([("experiment", "e1", "RUN", "REJECTED"), ("conclusion", "c1", "OK", "APPROVED")], "entity_type string, entity_id string, action string, status string")
    e = spark.createDataFrame([("experiment", "e1", "PLANNED"), ("conclusion", "c1", "APPROVED")], "entity_type string, entity_id string, status string")
    assert rows(research.approval_effects(a, e)) == [("experiment", "e1", "RUN", "CANCELLED", "PLANNED")]
    assert rows(research.required_fields(h, {"tested": F.col("status") != "TESTABLE"}).select("id", "violations")) == [("h3", ["tested"])]
    sets = {"run": spark.createDataFrame([("r1", "e9")], "id string, experiment string"), "experiment": spark.createDataFrame([("e1",)], "id string")}
    assert rows(research.archive_scope(sets, [("run", "experiment", "experiment", "id")])) == [("run", "experiment", "e9")]


def test_report(spark):
    h = spark.createDataFrame([("q", "h1", "First", "SUPPORTED")], "question string, id string, title string, status string")
    ev_ = spark.createDataFrame([("h1", "SUPPORT", "it works", "p", "3", "CONFIRMED"), ("h1", "CONTRADICT", "no", "p", "4", "PROPOSED")], "id string, relation string, statement string, prefix string, label string, review_status string")
    c = spark.createDataFrame([("q", "c1", "done", "APPROVED")], "question string, id string, text string, status string")
    assert rows(research.research_report(h, ev_, c))[0][1] == "## First [SUPPORTED]\n### SUPPORT\n- it works (p.3)\n## Conclusions\n- done"


def test_repeatability_and_export(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "item int, doc string, rank int")
    b = spark.createDataFrame([(1, "x", 1), (1, "z", 2)], "item int, doc string, rank int")
    assert rows(ev.run_repeatability(a, b)) == [(1, False, 0.5)] and rows(ev.run_repeatability(a, a)) == [(1, True, 1.0)]
    import uuid

    chunks = spark.createDataFrame([(f"CH-{n}", [float(n), n % 3 - 1.0]) for n in range(20)], "chunk_id string, embedding array<float>")
    assert files.export_vectors(chunks, str(tmp_path / "v")) == 20
    assert {r.chunk_id: r.point_id for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {f"CH-{n}": str(uuid.uuid5(uuid.NAMESPACE_URL, f"CH-{n}")) for n in range(20)}
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [9.5, 1.0])], "query_id long, v array<double>")
    assert files.export_differences(chunks, str(tmp_path / "v"), queries).count() == 0
    chunks.withColumn("embedding", F.when(F.col("chunk_id") == "CH-3", F.array(F.lit(90.0), F.lit(0.0))).otherwise(F.col("embedding"))).write.parquet(str(tmp_path / "w"))
    assert {r.query_id for r in files.export_differences(chunks, str(tmp_path / "w"), queries).collect()} == {1}


def test_manifest_and_retry(spark):
    manifest = spark.createDataFrame([("a", " By hand ", "X", None, 2020, None, "old"), ("b", "", None, None, None, None, "edited"), ("gone", "t", None, None, None, None, None)], "file string, title string, authors string, venue string, year int, external_id string, _auto string")
    current = spark.createDataFrame([("a", "Auto A", "filename"), ("b", "Auto B", "metadata"), ("c", "Auto C", "filename")], "file string, auto_title string, auto_source string")
    got = {r.file: r for r in ingest.manifest_sync(manifest, current).collect()}
    assert set(got) == {"a", "b", "c"} and (got["a"].title, got["a"].year, got["a"].authors, got["a"]["_auto"], got["a"].misplaced) == ("By hand", "2020", "X", "Auto A", False)
    assert got["b"].misplaced and not got["c"].misplaced and got["c"].title == ""
    asked = spark.createDataFrame([(1, "insufficient", 1, ["x"]), (2, "insufficient", 3, []), (3, "absent", 1, []), (4, "insufficient", 2, [])], "id int, status string, round int, missing array<string>")
    assert {r.id: r.reason for r in ev.retry_selection(asked).collect()} == {1: "MISSING FACETS", 4: "LOW RELEVANCE"}


def test_listing(spark):
    papers = spark.createDataFrame([(1, "A", "2301.00001.pdf", None, "V", "B, C", 3, 1), (2, "T 1999", "x", None, None, "", None, 2)], "id int, title string, source_file string, year int, venue string, authors string, chunk_count int, collection_id int")
    assert rows(catalog.paper_listing_text(papers), "id") == [(1, "A  (2023)  | V  | B, C  | 3 chunks indexed"), (2, "T 1999  (1999)  | 0 chunks indexed")]
    assert rows(catalog.paper_listing_text(papers, 2)) == [(2, "T 1999  (1999)  | 0 chunks indexed")]
