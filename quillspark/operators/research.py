"""Audits of research records: status moves, scope, provenance, integrity, statistics, archives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Allowed moves of each machine.
TRANSITIONS = {
    "question": {"OPEN": ["ACTIVE", "ARCHIVED"], "ACTIVE": ["ANSWERED", "ARCHIVED"], "ANSWERED": ["ACTIVE", "ARCHIVED"], "ARCHIVED": ["OPEN"]},
    "hypothesis": {
        "PROPOSED": ["TESTABLE", "INCONCLUSIVE"], "TESTABLE": ["UNDER_TEST", "WEAKENED", "REFUTED", "INCONCLUSIVE"],
        "UNDER_TEST": ["SUPPORTED", "PARTIALLY_SUPPORTED", "WEAKENED", "REFUTED", "INCONCLUSIVE"], "SUPPORTED": ["PARTIALLY_SUPPORTED", "WEAKENED", "REFUTED", "UNDER_TEST"],
        "PARTIALLY_SUPPORTED": ["SUPPORTED", "WEAKENED", "REFUTED", "UNDER_TEST", "INCONCLUSIVE"], "WEAKENED": ["PARTIALLY_SUPPORTED", "REFUTED", "UNDER_TEST", "INCONCLUSIVE"],
        "REFUTED": ["WEAKENED", "UNDER_TEST"], "INCONCLUSIVE": ["TESTABLE", "UNDER_TEST", "WEAKENED", "REFUTED"],
    },
    "experiment": {"DRAFT": ["PLANNED", "CANCELLED"], "PLANNED": ["APPROVED", "DRAFT", "CANCELLED"], "APPROVED": ["RUNNING", "CANCELLED"], "RUNNING": ["COMPLETED", "FAILED", "CANCELLED"], "COMPLETED": [], "FAILED": ["PLANNED", "CANCELLED"], "CANCELLED": ["DRAFT"]},
    "run": {"PENDING": ["RUNNING", "CANCELLED"], "RUNNING": ["COMPLETED", "FAILED", "CANCELLED"], "COMPLETED": [], "FAILED": ["PENDING"], "CANCELLED": []},
    "conclusion": {"DRAFT": ["PENDING_APPROVAL"], "PENDING_APPROVAL": ["APPROVED", "REJECTED", "DRAFT"], "APPROVED": ["DRAFT"], "REJECTED": ["DRAFT"]},
}
INITIAL = {"question": "OPEN", "hypothesis": "PROPOSED", "experiment": "DRAFT", "run": "PENDING", "conclusion": "DRAFT"}


def transitions(spark: SparkSession) -> DataFrame:
    rows = [(m, a, b) for m, g in TRANSITIONS.items() for a, bs in g.items() for b in bs]
    return spark.createDataFrame(rows, "machine string, from_status string, to_status string")


def status_changes(events: DataFrame, entity: str, status: str, *order: str) -> DataFrame:
    """In a log, each change of an entity's status with the status before it (null at first)."""
    before = F.lag(status).over(Window.partitionBy(entity).orderBy(*order))
    rows = events.withColumn("from_status", before)
    return rows.filter(F.col("from_status").isNull() | (F.col("from_status") != F.col(status))).withColumnRenamed(status, "to_status")


def event_log(before: DataFrame, after: DataFrame, entity_type: str, key: str, status: str = "status", by: DataFrame | None = None, actor: str = "system") -> DataFrame:
    """One event for each record that two snapshots differ in: entity_type, entity_id, event_type, actor, before, after, approval_request_id.

    before and after hold the record's columns as JSON, empty objects where it isn't there. A change of `status` is told
    as such, whatever else changed. by(key, actor, approval_request_id) names who made a change and what allowed it,
    at most one row a record; others have the given actor. Records that are equal in all columns give no event.
    """
    columns = sorted(c for c in after.columns if c != key)
    packed = lambda df, name: df.select(F.col(key), F.struct(*columns).alias(name))
    changed = packed(before, "b").join(packed(after, "a"), key, "full_outer").filter(~F.col("b").eqNullSafe(F.col("a")))
    moved = ~F.col(f"b.{status}").eqNullSafe(F.col(f"a.{status}"))
    kind = F.when(F.col("b").isNull(), "CREATED").when(F.col("a").isNull(), "DELETED").when(moved, "STATUS_CHANGED").otherwise("UPDATED")
    who, approval = F.lit(None).cast("string"), F.lit(None).cast("string")
    if by is not None:
        changed = changed.join(by.select(key, F.col("actor").alias("_who"), F.col("approval_request_id").alias("_approval")), key, "left")
        who, approval = F.col("_who"), F.col("_approval")
    json = lambda c: F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("{}"))
    return changed.select(F.lit(entity_type).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), kind.alias("event_type"), F.coalesce(who, F.lit(actor)).alias("actor"), json("b").alias("before"), json("a").alias("after"), approval.alias("approval_request_id"))


def transition_audit(changes: DataFrame, allowed: DataFrame, initial: Column) -> DataFrame:
    """Changes whose move isn't allowed, and first rows not in the initial state."""
    first = changes.filter(F.col("from_status").isNull() & (F.col("to_status") != initial)).withColumn("reason", F.lit("initial"))
    moved = changes.filter(F.col("from_status").isNotNull()).join(F.broadcast(allowed), ["from_status", "to_status"], "left_anti").withColumn("reason", F.lit("transition"))
    return first.unionByName(moved)


def ratio(flag: Column) -> Column:
    """Share of true rows, 1 if there are none, to four places."""
    return F.round(F.coalesce(F.avg(flag.cast("double")), F.lit(1.0)), 4)


def evidence_traceability(evidence: DataFrame) -> DataFrame:
    """H6, H7: evidence in use, once each: traceability and citation integrity of each question."""
    has = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    literature = F.col("evidence_type") == "LITERATURE"
    traced = F.when(literature, has("source_id") & has("chunk_id") & (has("page") | has("section")) & has("excerpt")).otherwise(has("source_id"))
    cited = F.when(literature, F.when(F.col("locator_kind") == "page", has("page")).otherwise(has("section")))
    return evidence.dropDuplicates(["id"]).groupBy("research_question_id").agg(ratio(traced).alias("traceability"), ratio(cited).alias("citation_integrity"))


def missing_links(rows: DataFrame, key: str, *links: DataFrame) -> DataFrame:
    """Rows whose key occurs in none of the link tables."""
    for link in links:
        rows = rows.join(link.select(F.col(link.columns[0]).alias(key)).distinct(), key, "left_anti")
    return rows


def contradiction_coverage(attempts: DataFrame) -> DataFrame:
    """H9: attempts(question, hypothesis, intent): of hypotheses with a primary search, the share with a contradicting one."""
    by = attempts.groupBy("question", "hypothesis").agg(F.collect_set("intent").alias("i")).filter(F.array_contains("i", "PRIMARY"))
    return by.groupBy("question").agg(ratio(F.array_contains("i", "CONTRADICTION")).alias("coverage"))


def invalid_status(rows: DataFrame, domain: DataFrame) -> DataFrame:
    """(entity, id, status) not in (entity, status)."""
    return rows.join(F.broadcast(domain), ["entity", "status"], "left_anti")


def cross_scope(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """links(a, b) whose ends, left(a, scope) and right(b, scope), lie in different scopes."""
    return links.join(left.withColumnRenamed("scope", "scope_a"), "a").join(right.withColumnRenamed("scope", "scope_b"), "b").filter("scope_a <> scope_b")


def record_fingerprint(sets: dict[str, DataFrame], scope: str) -> DataFrame:
    """SHA-256 of each scope's records: the JSON of every row is hashed, hashes are ordered and hashed by set, then together.

    A set's row hashes are first hashed in 256 groups by their first digits, so no scope's rows meet in one list.
    """
    parts = []
    for name, df in sorted(sets.items()):
        rows = df.select(F.col(scope).alias("scope"), F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
        low = rows.groupBy("scope", F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
        parts.append(low.groupBy("scope").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("b", "h"))), ""), 256).alias("h")).select("scope", F.lit(name).alias("part"), "h"))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("scope").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("part", F.lit(":"), "h"))), "\n"), 256).alias("fingerprint"))


def seal(archive: DataFrame) -> DataFrame:
    """archive_sha256 over all other columns."""
    return archive.withColumn("archive_sha256", F.sha2(F.to_json(F.struct(*sorted(c for c in archive.columns)), {"ignoreNullFields": "false"}), 256))


def verify(archive: DataFrame) -> DataFrame:
    """H16."""
    again = seal(archive.drop("archive_sha256")).withColumnRenamed("archive_sha256", "_again").select("research_question_id", "_again")
    return archive.select("research_question_id", "archive_sha256").join(again, "research_question_id").select("research_question_id", (F.col("archive_sha256") == F.col("_again")).alias("intact"))


def lineage_levels(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """nodes(id, parent) -> (id, level), level null if a cycle or a missing parent keeps it from a root."""
    nodes.createOrReplaceTempView("_lineage_nodes")
    found = spark.sql("""
        WITH RECURSIVE l(id, level) AS (
            SELECT id, 0 FROM _lineage_nodes WHERE parent IS NULL
            UNION ALL SELECT n.id, l.level + 1 FROM _lineage_nodes n JOIN l ON n.parent = l.id
        ) SELECT id, level FROM l""")
    return nodes.select("id").join(found, "id", "left")


def observation_stats(values: DataFrame, scope: str, group: str, metric: str, value: str, control: str, treatment: str) -> DataFrame:
    """Mean of each metric by group, and treatment less control."""
    g = values.groupBy(scope, metric).agg(F.avg(value).alias("mean"), F.avg(F.when(F.col(group) == control, F.col(value))).alias("control"), F.avg(F.when(F.col(group) == treatment, F.col(value))).alias("treatment"))
    return g.withColumn("delta", F.col("treatment") - F.col("control"))


def pending_review(status: Column) -> Column:
    """H26."""
    return F.coalesce(F.nullif(status, F.lit("")), F.lit("PROPOSED")) == "PROPOSED"


def approval_conflicts(requests: DataFrame) -> DataFrame:
    """Keys with more than one pending payload."""
    p = requests.filter("status = 'PENDING'").groupBy("entity_type", "entity_id", "action").agg(F.count(F.lit(1)).alias("pending"), F.count_distinct("payload").alias("payloads"))
    return p.filter("payloads > 1")


def approvals_missing(changes: DataFrame, approvals: DataFrame) -> DataFrame:
    """changes(entity_id, action) without an approved approval."""
    return changes.join(approvals.filter("status = 'APPROVED'"), ["entity_id", "action"], "left_anti")


def workflow_gates(counts: DataFrame) -> DataFrame:
    """Counts of each question -> the stages whose precondition holds."""
    # The count that each stage needs.
    gates = {"SEARCH_SUPPORTING_EVIDENCE": "registered_hypotheses", "SEARCH_CONTRADICTING_EVIDENCE": "primary_searches", "ASSESS_EVIDENCE": "contradiction_searches", "HUMAN_APPROVAL": "planned_experiments", "WAIT_FOR_RESULT": "approved_experiments", "BUILD_OBSERVATION": "completed_runs", "UPDATE_HYPOTHESIS": "observations", "GENERATE_RESEARCH_REPORT": "approved_conclusions"}
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), (F.coalesce(F.col(c), F.lit(0)) > 0).alias("open")) for s, c in gates.items()]))
    return counts.select("question", stages.alias("g")).select("question", "g.stage", "g.open")


def search_specs(hypotheses: DataFrame, contradiction: bool = True, limitation: bool = True) -> DataFrame:
    """H1: hypotheses(question_id, hypothesis_id, title, description, statement) -> one search a channel, with its query; the last two may be left out."""
    # Intents, the relation that each looks for, and what its query adds.
    channels = [
        ("PRIMARY", "SUPPORT", ""),
        ("CONTRADICTION", "CONTRADICT", ". Contrary evidence: failure limitation instability false negative overfitting negative transfer counterexample no improvement"),
        ("LIMITATION", "LIMITATION", ". Scope and limitations: limitations boundary conditions sensitivity dataset bias confounder generalization reproducibility"),
    ]
    wanted = [c for c, take in zip(channels, (True, contradiction, limitation), strict=True) if take]
    spec = F.explode(F.array(*[F.struct(F.lit(a).alias("intent"), F.lit(b).alias("relation"), F.lit(c).alias("more")) for a, b, c in wanted])).alias("s")
    base = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("description", F.lit("")), F.lit(". Hypothesis: "), F.coalesce("statement", F.lit("")))
    return hypotheses.select("question_id", "hypothesis_id", base.alias("base"), spec).select("question_id", "hypothesis_id", "s.intent", "s.relation", F.concat("base", "s.more").alias("text"))


def new_rows(rows: DataFrame, stored: DataFrame, *key: str) -> DataFrame:
    """One row a key, and none that is stored."""
    return rows.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti")


def conclusion_support(conclusions: DataFrame, evidence_links: DataFrame, evidence: DataFrame, observation_links: DataFrame) -> DataFrame:
    """conclusions(id) that nothing supports, or only models' hypotheses and people's notes: (id, reason).

    evidence_links(id, evidence_id, role), of which those of role SUPPORTING count; evidence(evidence_id, evidence_type);
    observation_links(id, observation_id).
    """
    # Kinds of evidence that can carry a conclusion.
    strong = F.col("evidence_type").isin("LITERATURE", "EXPERIMENTAL", "DERIVED_ANALYSIS")
    e = evidence_links.filter("role = 'SUPPORTING'").join(evidence.select("evidence_id", "evidence_type"), "evidence_id").groupBy("id").agg(F.count(F.lit(1)).alias("e"), F.count_if(strong).alias("strong"))
    o = observation_links.groupBy("id").agg(F.count(F.lit(1)).alias("o"))
    j = conclusions.select("id").join(e, "id", "left").join(o, "id", "left").na.fill(0, ["e", "strong", "o"])
    reason = F.when(F.col("e") + F.col("o") == 0, "no support").when((F.col("o") == 0) & (F.col("strong") == 0), "only notes and hypotheses")
    return j.select("id", reason.alias("reason")).filter("reason IS NOT NULL")


def confirmed_imports(imports: DataFrame, approvals: DataFrame, runs: DataFrame) -> DataFrame:
    """imports(import_id, experiment_id, payload_hash, approval_id) with the reason why one isn't taken, empty if it is.

    approvals(approval_id, entity_id, action, approved_hash, status): its own must be approved, for its experiment and
    its very payload. runs(import_hash): a payload that is there isn't taken again; of equal payloads the first is.
    """
    wanted = F.concat(F.lit("CONFIRM_RUN_IMPORT:"), F.substring("payload_hash", 1, 32))
    held = approvals.select("approval_id", F.col("entity_id").alias("_entity"), "action", "approved_hash", F.col("status").alias("_status"))
    there = runs.select(F.col("import_hash").alias("payload_hash")).distinct().withColumn("_there", F.lit(True))
    j = imports.join(held, "approval_id", "left").join(there, "payload_hash", "left")
    fits = (F.col("_entity") == F.col("experiment_id")) & (F.col("action") == wanted) & (F.col("approved_hash") == F.col("payload_hash")) & (F.col("_status") == "APPROVED")
    first = F.row_number().over(Window.partitionBy("payload_hash", F.coalesce(fits, F.lit(False))).orderBy("import_id"))
    reason = F.when(F.col("payload_hash").isNull() | ~F.coalesce(fits, F.lit(False)), "no matching approval").when(F.col("_there") | (F.col("_first") > 1), "payload exists").otherwise("")
    return j.withColumn("_first", first).select("import_id", "experiment_id", "payload_hash", reason.alias("reason"))


def completable(experiments: DataFrame, runs: DataFrame, observations: DataFrame) -> DataFrame:
    """H33."""
    r = runs.groupBy("experiment_id").agg(F.bool_and(F.col("status") == "COMPLETED").alias("all_done"))
    ready = experiments.filter("status = 'RUNNING'").join(r.filter("all_done"), "experiment_id", "left_semi")
    return ready.join(observations, "experiment_id", "left_semi")


def provenance_edges(conclusion_evidence: DataFrame, conclusion_observation: DataFrame, observations: DataFrame, observation_run: DataFrame) -> DataFrame:
    """(root, from, to, type), of fixed depth."""
    ce = conclusion_evidence.select(F.col("conclusion_id").alias("root"), F.col("conclusion_id").alias("from"), F.col("evidence_id").alias("to"), F.col("role").alias("type"))
    co = conclusion_observation.select(F.col("conclusion_id").alias("root"), F.col("conclusion_id").alias("from"), F.col("observation_id").alias("to"), F.lit("OBSERVATION").alias("type"))
    oe = conclusion_observation.join(observations, "observation_id").select(F.col("conclusion_id").alias("root"), F.col("observation_id").alias("from"), F.col("experiment_id").alias("to"), F.lit("EXPERIMENT").alias("type"))
    er = conclusion_observation.join(observations, "observation_id").join(observation_run, "observation_id").select(F.col("conclusion_id").alias("root"), F.col("experiment_id").alias("from"), F.col("run_id").alias("to"), F.lit("RUN").alias("type"))
    return ce.unionByName(co).unionByName(oe).unionByName(er)


def provenance_nodes(edges: DataFrame) -> DataFrame:
    """H13."""
    return edges.select("root", F.explode(F.array("from", "to")).alias("id")).distinct()


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, length) of tables: length is that of a bounded text, else null."""
    rows = []
    for name, df in sorted(tables.items()):
        for field in df.schema:
            kind = (field.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING", field.dataType.simpleString())
            bound = re.fullmatch(r"(?:var)?char\((\d+)\)", kind)
            rows.append((name, field.name, "string" if bound else kind, int(bound[1]) if bound else None))
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, column string, type string, length int")


def schema_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What of expected(table, column, type, length) the actual tables don't hold: (table, column, problem); nothing if they are compatible.

    Only texts are compared in length, where both are bounded.
    """
    there = actual.select("table").distinct()
    missing_tables = expected.select("table").distinct().join(there, "table", "left_anti").select("table", F.lit(None).cast("string").alias("column"), F.lit("missing table").alias("problem"))
    held = actual.select("table", "column", F.col("type").alias("_type"), F.col("length").alias("_length"), F.lit(True).alias("_there"))
    j = expected.join(there, "table", "left_semi").join(held, ["table", "column"], "left")
    short = F.col("length") > F.col("_length")
    problem = F.when(F.col("_there").isNull(), "missing column").when(F.col("type") != F.col("_type"), F.concat(F.lit("is "), "_type")).when(short, F.concat(F.lit("holds "), F.col("_length").cast("string"), F.lit(" of "), F.col("length").cast("string"), F.lit(" characters")))
    return missing_tables.unionByName(j.select("table", "column", problem.alias("problem")).filter("problem IS NOT NULL"))


def schema_backfill(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add columns (type, default) that are missing, and fill nulls where a default is declared."""
    for c, (kind, default) in defaults.items():
        value = F.lit(default).cast(kind)
        df = df.withColumn(c, value if c not in df.columns else F.coalesce(F.col(c), value))
    return df


def evidence_drafts(hits: DataFrame) -> DataFrame:
    """H2: hits with a place and a text become evidence; pages and other places go to columns of their own."""
    fine = hits.filter(F.col("locator_kind").isin("page", "section", "block") & (F.trim(F.coalesce("page_label", F.lit(""))) != "") & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    is_page = F.col("locator_kind") == "page"
    return fine.select("query_id", "source", "chunk_id", F.col("content").alias("excerpt"), F.when(is_page, F.col("page_label")).alias("page"), F.when(~is_page, F.col("page_label")).alias("section"), "locator_kind", "locator_prefix", F.create_map(F.lit("rank"), F.col("rank").cast("string"), F.lit("origin"), F.col("origin")).alias("provenance"))


def search_attempts(outcomes: DataFrame, hits: DataFrame) -> DataFrame:
    """H5: a row for each search with its gate and the number of hits."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return outcomes.join(n, "query_id", "left").select(*outcomes.columns, F.coalesce("hits", F.lit(0)).alias("hits"))


def required_fields(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rules name -> condition that must hold; rows that break any, with the names."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in sorted(rules.items())]))
    return rows.withColumn("violations", broken).filter(F.size("violations") > 0)


def hypothesis_basis(hypotheses: DataFrame, links: DataFrame) -> DataFrame:
    """hypotheses(id, status) whose status lacks confirmed links(id, relation, review_status) of its kind."""
    confirmed = links.filter("review_status = 'CONFIRMED'").groupBy("id").agg(F.count_if(F.col("relation") == "SUPPORT").alias("s"), F.count_if(F.col("relation") == "CONTRADICT").alias("c"))
    j = hypotheses.join(confirmed, "id", "left").na.fill(0, ["s", "c"])
    return j.filter((F.col("status").isin("SUPPORTED", "PARTIALLY_SUPPORTED") & (F.col("s") == 0)) | (F.col("status").isin("WEAKENED", "REFUTED") & (F.col("c") == 0))).select("id", "status")


def approval_effects(approvals: DataFrame, entities: DataFrame) -> DataFrame:
    """Decided approvals(entity_type, entity_id, action, status) whose entity(entity_type, entity_id, status) isn't where it should be."""
    # Target status by entity type and decision.
    targets = {("experiment", "APPROVED"): "APPROVED", ("experiment", "REJECTED"): "CANCELLED", ("conclusion", "APPROVED"): "APPROVED", ("conclusion", "REJECTED"): "REJECTED", ("hypothesis", "APPROVED"): "TESTABLE"}
    wanted = F.create_map(*[F.lit(x) for (a, b), c in targets.items() for x in (f"{a}:{b}", c)])
    j = approvals.withColumn("expected", F.try_element_at(wanted, F.concat_ws(":", "entity_type", "status"))).withColumnRenamed("status", "decision").join(entities, ["entity_type", "entity_id"])
    return j.filter(F.col("expected").isNotNull() & (F.col("expected") != F.col("status"))).select("entity_type", "entity_id", "action", "expected", "status")


def proposal_source_check(proposals: DataFrame, relations: DataFrame) -> DataFrame:
    """proposals(id, question, kind, sources): sources that no confirmed relation(question, relation, source) of the kind backs."""
    asked = proposals.select("id", "question", F.col("kind").alias("relation"), F.explode("sources").alias("source"))
    return asked.join(relations.filter("review_status = 'CONFIRMED'"), ["question", "relation", "source"], "left_anti").select("id", "source")


def archive_scope(sets: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """Keys (set, column, other set, its column): all references that lead nowhere: (set, column, value)."""
    out = None
    for name, column, other, key in keys:
        rows = sets[name].filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"))
        lost = rows.join(sets[other].select(F.col(key).cast("string").alias("value")), "value", "left_anti").distinct().select(F.lit(name).alias("set"), F.lit(column).alias("column"), "value")
        out = lost if out is None else out.unionByName(lost)
    return out


def research_report(hypotheses: DataFrame, evidence: DataFrame, conclusions: DataFrame) -> DataFrame:
    """A section for each hypothesis(question, id, title, status): confirmed evidence(id, relation, statement, prefix, label) by relation, then approved conclusions(question, id, text)."""
    line = F.concat(F.lit("- "), F.col("statement"), F.lit(" ("), F.col("prefix"), F.lit("."), F.col("label"), F.lit(")"))
    by = evidence.filter("review_status = 'CONFIRMED'").groupBy("id").agg(*[F.array_join(F.sort_array(F.collect_list(F.when(F.col("relation") == r, line))), "\n").alias(r) for r in ("SUPPORT", "CONTRADICT", "LIMITATION")])
    parts = [F.when(F.length(F.coalesce(r, F.lit(""))) > 0, F.concat(F.lit(f"### {r}\n"), F.col(r))) for r in ("SUPPORT", "CONTRADICT", "LIMITATION")]
    sections = hypotheses.join(by, "id", "left").select("question", "id", F.concat_ws("\n", F.concat(F.lit("## "), F.col("title"), F.lit(" ["), F.col("status"), F.lit("]")), *parts).alias("s"))
    body = sections.groupBy("question").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "s"))), lambda x: x["s"]), "\n").alias("body"))
    done = conclusions.filter("status = 'APPROVED'").groupBy("question").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("done"))
    return body.join(done, "question", "left").select("question", F.concat_ws("\n", "body", F.lit("## Conclusions"), F.coalesce("done", F.lit("(none approved)"))).alias("report"))


def state_projection(questions: DataFrame, sets: dict[str, DataFrame], scope: str) -> DataFrame:
    """Each question with its record sets as ordered arrays of structs."""
    out = questions
    for name, df in sorted(sets.items()):
        out = out.join(df.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != scope]))).alias(name)), scope, "left")
    return out


def evidence_by_hypothesis(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """H36."""
    return relations.join(evidence, "evidence_id")


def experiment_detail(experiments: DataFrame, tested: DataFrame, runs: DataFrame) -> DataFrame:
    """H37."""
    h = tested.groupBy("experiment_id").agg(F.sort_array(F.collect_set("hypothesis_id")).alias("hypotheses"))
    r = runs.groupBy("experiment_id").agg(F.sort_array(F.collect_list("run_id")).alias("runs"))
    return experiments.join(h, "experiment_id", "left").join(r, "experiment_id", "left")


def question_listing(questions: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The newest questions, and how many there are."""
    return questions.orderBy(F.desc("updated_at"), "id").limit(limit), questions.count()
