from __future__ import annotations

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import canonical as cn
from quillspark.operators import archive as ar
from quillspark.operators import research as rs


def sets(spark, questions=("q1", "q2"), bad=False):
    """Two questions with some of everything; ids of a question begin with it."""
    rows = {n: [] for n in ar.SETS}
    for q in questions:
        i = lambda x, q=q: f"{q}-{x}"
        rows["research_question"].append((q, f"Why {q}?"))
        rows["hypotheses"] += [(i("h1"), q, None), (i("h2"), q, i("h1")), (i("h3"), q, i("h2"))]
        rows["evidence"] += [(i("e1"), q, "LITERATURE"), (i("e2"), q, "HUMAN_NOTE")]
        rows["search_attempts"].append((i("s1"), q))
        rows["evidence_relations"].append((i("r1"), i("h1"), i("e1")))
        rows["search_hits"].append((i("s1"), 1, i("e1")))
        rows["experiments"].append((i("x1"), q))
        rows["experiment_hypotheses"].append((i("x1"), i("h1")))
        rows["runs"] += [(i("u1"), i("x1"), 0.5), (i("u2"), i("x1"), 0.75)]
        rows["observations"].append((i("o1"), i("x1")))
        rows["observation_runs"].append((i("o1"), i("u1")))
        rows["observation_hypotheses"].append((i("o1"), i("h2")))
        rows["conclusions"].append((i("c1"), q))
        rows["conclusion_evidence"].append((i("c1"), i("e1"), "SUPPORTING"))
        rows["conclusion_observations"].append((i("c1"), i("o1")))
        rows["approvals"].append((i("a1"), i("c1")))
        rows["events"] += [(i("v1"), i("h1"), None), (i("v2"), i("a1"), i("a1")), *[(i("v3"), "elsewhere", i("a1"))] * bad]
        rows["workflow"].append((q, "DONE"))
    if bad:
        rows["evidence_relations"].append(("q1-r9", "q1-h1", "q2-e1"))
        rows["hypotheses"] += [("q1-h8", "q1", "q1-h9"), ("q1-h9", "q1", "q1-h8"), ("q1-h7", "q1", "q2-h1")]
        rows["workflow"].append(("q1", "AGAIN"))
    schemas = {
        "research_question": "id string, title string", "hypotheses": "id string, research_question_id string, parent_hypothesis_id string", "evidence": "id string, research_question_id string, evidence_type string",
        "search_attempts": "id string, research_question_id string", "evidence_relations": "id string, hypothesis_id string, evidence_id string", "search_hits": "search_attempt_id string, rank int, evidence_id string",
        "experiments": "id string, research_question_id string", "experiment_hypotheses": "experiment_id string, hypothesis_id string", "runs": "id string, experiment_id string, map double", "observations": "id string, experiment_id string",
        "observation_runs": "observation_id string, run_id string", "observation_hypotheses": "observation_id string, hypothesis_id string", "conclusions": "id string, research_question_id string",
        "conclusion_evidence": "conclusion_id string, evidence_id string, role string", "conclusion_observations": "conclusion_id string, observation_id string", "approvals": "id string, entity_id string",
        "events": "id string, entity_id string, approval_request_id string", "workflow": "research_question_id string, stage string",
    }
    return {n: spark.createDataFrame(rows[n], schemas[n]) for n in ar.SETS}


def test_export_verify_restore(spark, tmp_path):
    path, store = str(tmp_path / "archive"), str(tmp_path / "store")
    only = spark.createDataFrame([("q1",)], "question string")
    manifest = {(r.question, r.set): r.records for r in ar.export(sets(spark), path, only).collect()}
    assert {q for q, _ in manifest} == {"q1"} and manifest["q1", "events"] == 2 and manifest["q1", "runs"] == 2
    assert ar.verify(spark, path).count() == 0
    assert {(r.metric, r.value) for r in spark.read.parquet(f"{path}/evaluation").collect()} == {("supported_conclusions", 1.0)}
    edges = {(r["from"], r["to"], r["type"]) for r in spark.read.parquet(f"{path}/conclusion_provenance").collect()}
    assert edges == {("q1-c1", "q1-e1", "SUPPORTING"), ("q1-c1", "q1-o1", "OBSERVATION"), ("q1-o1", "q1-x1", "EXPERIMENT"), ("q1-x1", "q1-u1", "RUN")}
    version, problems = ar.restore(spark, path, store)
    assert version == 0 and problems.count() == 0
    assert ar.published(spark, store)["hypotheses"].count() == 3
    assert [r.problem for r in ar.restore(spark, path, store)[1].collect()] == ["question exists"]
    second = str(tmp_path / "second")
    some = {n: df for n, df in sets(spark).items() if n in ("research_question", "hypotheses", "experiments", "runs")}
    ar.export(some, second, spark.createDataFrame([("q2",)], "question string"))
    assert ar.restore(spark, second, store)[0] == 1
    assert ar.published(spark, store)["runs"].count() == 4
    # The state comes out of the store as it went in.
    whole = ar.roots(ar.set_hashes(ar.scoped(some)), ar.STATE).filter("question = 'q2'")
    again = ar.roots(ar.set_hashes({n: df for n, df in ar.published(spark, store).items() if n in some}), ar.STATE).filter("question = 'q2'")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect()))


def test_a_changed_archive_is_refused_and_leaves_nothing(spark, tmp_path):
    path, store = str(tmp_path / "archive"), str(tmp_path / "store")
    ar.export(sets(spark), path)
    runs = spark.read.parquet(f"{path}/runs").withColumn("map", F.when(F.col("id") == "q2-u2", 0.9).otherwise(F.col("map")))
    spark.createDataFrame(runs.collect(), runs.schema).write.mode("overwrite").parquet(f"{path}/runs")
    assert {(r.question, r.set) for r in ar.verify(spark, path).collect()} == {("q2", "runs"), ("q2", "*"), ("q2", "state")}
    spark.createDataFrame([("q2", "supported_conclusions", 0.1)], "question string, metric string, value double").write.mode("overwrite").parquet(f"{path}/evaluation")
    assert {(r.question, r.set) for r in ar.verify(spark, path).collect()} >= {("q1", "evaluation"), ("q2", "evaluation"), ("q1", "*")}
    version, problems = ar.restore(spark, path, store)
    assert version is None and {r.problem for r in problems.collect()} == {"not as sealed"} and ar.published(spark, store) == {}


def test_scope(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert ar.scope_violations(ar.scoped(sets(spark))).count() == 0
    ar.export(sets(spark, bad=True), path)
    found = {(r.question, r.set, r.field, r.value) for r in ar.scope_violations(ar.read(spark, path)).collect()}
    assert found == {("q1", "events", "entity_id", "elsewhere"), ("q2", "events", "entity_id", "elsewhere"), ("q1", "evidence_relations", "evidence_id", "q2-e1"), ("q1", "hypotheses", "parent_hypothesis_id", "q2-h1"), ("q1", "workflow", "records", "2")}
    version, problems = ar.restore(spark, path, str(tmp_path / "store"))
    assert version is None
    stuck = {r.detail for r in problems.collect() if r.problem.startswith("lineage")}
    assert stuck == {"q1-h7", "q1-h8", "q1-h9"}


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


def turned(x):
    if isinstance(x, dict):
        return {k: turned(x[k]) for k in reversed(list(x))}
    return [turned(v) for v in x] if isinstance(x, list) else x


@given(JSON)
@settings(max_examples=200, deadline=None)
def test_canonical_form_of_reordered_values(value):
    want = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert cn.canonical(json.dumps(turned(value), indent=1)) == want == cn.canonical(json.dumps(value, ensure_ascii=True))


def test_hashes(spark):
    texts = ['{"b": {"d": [1, 2.50], "c": "é"}, "a": 1e2}', '{"a": 100.0, "b": {"c": "\\u00e9", "d": [1, 2.5]}}', '{"a": 100, "b": {"c": "é", "d": [1, 2.5]}}', "no json", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(cn.json_hash(F.col("t"))).collect()]
    assert got[0] == got[1] == hashlib.sha256('{"a":100.0,"b":{"c":"é","d":[1,2.5]}}'.encode()).hexdigest() and got[2] != got[0] and got[3:] == [None, None]
    maps = spark.sql("SELECT map('b', named_struct('y', 1, 'x', 2), 'a', null) AS m UNION ALL SELECT map('a', null, 'b', named_struct('y', 1, 'x', 2))")
    assert len({r[0] for r in maps.select(cn.canonical_hash(F.col("m"))).collect()}) == 1


def test_run_imports(spark):
    good = '{"experiment_id": "e1", "run_id": "r1", "seed": 3, "metrics": {"b": 1, "a": {"z": 1, "y": [true]}}, "artifact_paths": ["p"]}'
    table = "experiment_id,seed,metrics.mAP,metrics.note,config.lr,config.x.y,environment.gpu,artifact_paths\ne1,7,87.5,\"[1, 2]\",1e-3,text,,a; b ;\n"
    rows = [(1, good, "json"), (2, table, ".CSV"), (3, table + "e2,1,2,3,4,5,6,7\n", "csv"), (4, "experiment_id,other\ne,1\n", "csv"), (5, '{"experiment_id": "e1", "metrics": {}}', "json"), (6, "[1]", "json"), (7, "", "json"), (8, None, "csv"), (9, "a: 1", "yaml"), (10, "{", "json")]
    got = {r.n: r.i for r in spark.createDataFrame(rows, "n int, t string, k string").select("n", cn.run_import(F.col("t"), F.col("k")).alias("i")).collect()}
    assert (got[1].experiment_id, got[1].run_id, got[1].seed, got[1].metrics, got[1].artifact_paths, got[1].problem) == ("e1", "r1", 3, '{"a":{"y":[true],"z":1},"b":1}', ["p"], None)
    assert got[1].payload_hash == hashlib.sha256(cn.canonical(good).encode()).hexdigest()
    assert (got[2].metrics, got[2].config, got[2].environment, got[2].seed, got[2].artifact_paths) == ('{"mAP":87.5,"note":[1,2]}', '{"lr":0.001,"x.y":"text"}', "{}", 7, ["a", "b"])
    assert all(got[n].problem and got[n].payload_hash is None for n in range(3, 11)) and "exactly one" in got[3].problem and "column" in got[4].problem


def test_confirmed_imports(spark):
    h, g = "a" * 64, "b" * 64
    imports = spark.createDataFrame([(1, "e1", h, "ok"), (2, "e1", h, "ok"), (3, "e2", h, "ok"), (4, "e1", g, "ok2"), (5, "e1", g, "no"), (6, "e1", None, "ok")], "import_id int, experiment_id string, payload_hash string, approval_id string")
    action = "CONFIRM_RUN_IMPORT:"
    approvals = spark.createDataFrame([("ok", "e1", action + h[:32], h, "APPROVED"), ("ok2", "e1", action + g[:32], g, "PENDING"), ("no", "e1", action + h[:32], g, "APPROVED")], "approval_id string, entity_id string, action string, approved_hash string, status string")
    runs = spark.createDataFrame([("c" * 64,)], "import_hash string")
    assert {r.import_id: r.reason for r in rs.confirmed_imports(imports, approvals, runs).collect()} == {1: "", 2: "payload exists", 3: "no matching approval", 4: "no matching approval", 5: "no matching approval", 6: "no matching approval"}
    assert {r.import_id: r.reason for r in rs.confirmed_imports(imports, approvals, spark.createDataFrame([(h,)], "import_hash string")).filter("import_id = 1").collect()} == {1: "payload exists"}


def test_event_log(spark):
    a = spark.createDataFrame([(1, "OPEN", "x", 1), (2, "OPEN", "y", 1), (3, "OPEN", None, 1), (4, "OPEN", "z", None)], "id int, status string, title string, n int")
    b = spark.createDataFrame([(1, "ACTIVE", "x2", 1), (2, "OPEN", "y2", 1), (4, "OPEN", "z", None), (5, "OPEN", "new", 2)], "id int, status string, title string, n int")
    by = spark.createDataFrame([(1, "ana", "ap-1")], "id int, actor string, approval_request_id string")
    got = {r.entity_id: r for r in rs.event_log(a, b, "Question", "id", by=by).collect()}
    assert {k: v.event_type for k, v in got.items()} == {"1": "STATUS_CHANGED", "2": "UPDATED", "3": "DELETED", "5": "CREATED"}
    assert (got["1"].actor, got["1"].approval_request_id, got["2"].actor) == ("ana", "ap-1", "system")
    assert json.loads(got["1"].before)["status"] == "OPEN" and got["5"].before == "{}" and got["3"].after == "{}" and json.loads(got["3"].before)["title"] is None


def test_conclusion_support(spark):
    c = spark.createDataFrame([(n,) for n in "abcd"], "id string")
    links = spark.createDataFrame([("a", "e1", "SUPPORTING"), ("b", "e2", "SUPPORTING"), ("c", "e1", "CONTRADICTING"), ("d", "e2", "SUPPORTING")], "id string, evidence_id string, role string")
    e = spark.createDataFrame([("e1", "LITERATURE"), ("e2", "HUMAN_NOTE")], "evidence_id string, evidence_type string")
    o = spark.createDataFrame([("d", "o1")], "id string, observation_id string")
    assert sorted(map(tuple, rs.conclusion_support(c, links, e, o).collect())) == [("b", "only notes and hypotheses"), ("c", "no support")]


def test_descriptions(spark):
    made = ar.scoped(sets(spark))
    h = made["hypotheses"].withColumns({"title": F.col("id"), "status": F.lit("SUPPORTED")})
    c = made["conclusions"].withColumns({"text": F.lit("done"), "status": F.lit("APPROVED")})
    e = made["evidence"].withColumns({"statement": F.lit("it works"), "locator_prefix": F.lit("p"), "locator_label": F.lit("3")})
    r = made["evidence_relations"].withColumns({"relation": F.lit("SUPPORT"), "review_status": F.lit("CONFIRMED")})
    a = made["search_attempts"].withColumns({"hypothesis_id": F.lit("h"), "intent": F.when(F.col("question") == "q1", "PRIMARY").otherwise("CONTRADICTION")})
    got = ar.descriptions(made | {"hypotheses": h, "conclusions": c, "evidence": e, "evidence_relations": r, "search_attempts": a})
    reports = {x.question: x.report for x in got["report"].collect()}
    assert reports["q1"].startswith("## q1-h1 [SUPPORTED]\n### SUPPORT\n- it works (p.3)") and reports["q2"].endswith("## Conclusions\n- done")
    assert {(x.question, x.metric, x.value) for x in got["evaluation"].collect()} == {("q1", "supported_conclusions", 1.0), ("q2", "supported_conclusions", 1.0), ("q1", "contradiction_coverage", 0.0)}
