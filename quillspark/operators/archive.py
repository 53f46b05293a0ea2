"""Archives of research questions, sealed by a hash tree, checked, and restored all or not at all.

An archive is a folder with a table for each of 18 record sets, `question` saying whose each record is, and a
manifest of hashes. Many questions go in one archive; nothing of a question is gathered in one place. Hashes are of
256 groups of records, then of a set, then of a question, so no list grows with the number of records.

A store is a folder of versions of the same 18 tables; `published` names the finished ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import research as rs
from quillspark.operators.retrieval import written

# Record sets in the order in which a restore needs them, with the columns that identify a record.
SETS = {
    "research_question": ["id"], "hypotheses": ["id"], "evidence": ["id"], "search_attempts": ["id"], "evidence_relations": ["id"], "search_hits": ["search_attempt_id", "rank"],
    "experiments": ["id"], "experiment_hypotheses": ["experiment_id", "hypothesis_id"], "runs": ["id"], "observations": ["id"], "observation_runs": ["observation_id", "run_id"],
    "observation_hypotheses": ["observation_id", "hypothesis_id"], "conclusions": ["id"], "conclusion_evidence": ["conclusion_id", "evidence_id", "role"],
    "conclusion_observations": ["conclusion_id", "observation_id"], "approvals": ["id"], "events": ["id"], "workflow": ["research_question_id"],
}
# Sets that name their question, those that belong to a record which does, and all references between sets.
DIRECT = ("hypotheses", "evidence", "search_attempts", "experiments", "conclusions", "workflow")
PARENTS = {
    "evidence_relations": ("hypothesis_id", "hypotheses"), "search_hits": ("search_attempt_id", "search_attempts"), "experiment_hypotheses": ("experiment_id", "experiments"), "runs": ("experiment_id", "experiments"),
    "observations": ("experiment_id", "experiments"), "observation_runs": ("observation_id", "observations"), "observation_hypotheses": ("observation_id", "observations"),
    "conclusion_evidence": ("conclusion_id", "conclusions"), "conclusion_observations": ("conclusion_id", "conclusions"),
}
REFERENCES = [
    ("evidence_relations", "hypothesis_id", "hypotheses"), ("evidence_relations", "evidence_id", "evidence"), ("search_hits", "search_attempt_id", "search_attempts"), ("search_hits", "evidence_id", "evidence"),
    ("experiment_hypotheses", "experiment_id", "experiments"), ("experiment_hypotheses", "hypothesis_id", "hypotheses"), ("runs", "experiment_id", "experiments"), ("observations", "experiment_id", "experiments"),
    ("observation_runs", "observation_id", "observations"), ("observation_runs", "run_id", "runs"), ("observation_hypotheses", "observation_id", "observations"), ("observation_hypotheses", "hypothesis_id", "hypotheses"),
    ("conclusion_evidence", "conclusion_id", "conclusions"), ("conclusion_evidence", "evidence_id", "evidence"), ("conclusion_observations", "conclusion_id", "conclusions"), ("conclusion_observations", "observation_id", "observations"),
]
# Sets whose records approvals and events are about, and those that the state's fingerprint covers.
ENTITIES = ("research_question", "hypotheses", "evidence", "search_attempts", "experiments", "runs", "observations", "conclusions", "evidence_relations")
STATE = ("research_question", "hypotheses", "evidence", "experiments", "runs", "observations", "conclusions")
#: What an archive says about its records besides them: sealed with them, not restored.
DESCRIPTIONS = ("evaluation", "conclusion_provenance", "report")

Sets = dict[str, DataFrame]
VIOLATION = "question string, set string, field string, value string"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ids(sets: Sets, names: tuple[str, ...]) -> DataFrame:
    """(question, entity_id) of all records of these sets, whose question is known."""
    return _union([sets[n].select("question", F.col("id").cast("string").alias("entity_id")) for n in names if n in sets])


def scoped(sets: Sets) -> Sets:
    """Each record set with the question that a record belongs to, from its own column, its parent's or its entity's.

    Approvals and events of the same record but different sets of ids belong where their entity does; events of an
    approval where the approval does. Records that belong nowhere are left out.
    """
    out: Sets = {"research_question": sets["research_question"].withColumn("question", F.col("id").cast("string"))}
    for name in DIRECT:
        if name in sets:
            out[name] = sets[name].withColumn("question", F.col("research_question_id").cast("string"))
    for name, (key, parent) in PARENTS.items():
        if name in sets and parent in out:
            out[name] = sets[name].join(out[parent].select(F.col("id").alias(key), "question"), key)
    if "approvals" in sets:
        out["approvals"] = sets["approvals"].withColumn("entity_id", F.col("entity_id").cast("string")).join(_ids(out, ENTITIES).distinct(), "entity_id")
    if "events" in sets:
        about = _ids(out, (*ENTITIES, "approvals")).distinct()
        of = sets["events"].withColumn("entity_id", F.col("entity_id").cast("string"))
        by_entity = of.join(about, "entity_id")
        if "approvals" in out:
            by_entity = by_entity.unionByName(of.join(out["approvals"].select(F.col("id").alias("approval_request_id"), "question"), "approval_request_id"))
        out["events"] = by_entity.dropDuplicates(["id", "question"])
    return {n: out[n] for n in SETS if n in out}


def descriptions(sets: Sets) -> Sets:
    """Of scoped sets: each question's measures (metric, value), its conclusions' provenance, and its report, each as far as the sets have the columns."""
    out: Sets = {}
    have = lambda name, *columns: name in sets and set(columns) <= set(sets[name].columns)
    links = all(n in sets for n in ("conclusions", "conclusion_evidence", "conclusion_observations", "observations", "observation_runs"))
    if links:
        named = {n: sets[n].drop("question") for n in ("conclusion_evidence", "conclusion_observations", "observation_runs")}
        edges = rs.provenance_edges(named["conclusion_evidence"], named["conclusion_observations"], sets["observations"].select(F.col("id").alias("observation_id"), "experiment_id"), named["observation_runs"])
        out["conclusion_provenance"] = edges.join(sets["conclusions"].select(F.col("id").alias("root"), "question"), "root")
        linked = named["conclusion_evidence"].select(F.col("conclusion_id").alias("id")).union(named["conclusion_observations"].select("conclusion_id")).distinct().withColumn("linked", F.lit(True))
        supported = sets["conclusions"].select("id", "question").join(linked, "id", "left")
        measures = supported.groupBy("question").agg(rs.ratio(F.col("linked").isNotNull()).alias("value")).select("question", F.lit("supported_conclusions").alias("metric"), "value")
        if have("search_attempts", "hypothesis_id", "intent"):
            met = rs.contradiction_coverage(sets["search_attempts"].select("question", F.col("hypothesis_id").alias("hypothesis"), "intent"))
            measures = measures.unionByName(met.select("question", F.lit("contradiction_coverage").alias("metric"), F.col("coverage").alias("value")))
        if have("evidence", "evidence_type", "source_id", "chunk_id", "page", "section", "excerpt", "locator_kind"):
            traced = rs.evidence_traceability(sets["evidence"].join(named["conclusion_evidence"].select(F.col("evidence_id").alias("id")), "id", "left_semi"))
            measures = measures.unionByName(traced.select(F.col("research_question_id").cast("string").alias("question"), F.explode(F.create_map(F.lit("evidence_traceability"), "traceability", F.lit("citation_integrity"), "citation_integrity")).alias("metric", "value")))
        out["evaluation"] = measures
    if have("hypotheses", "title", "status") and have("conclusions", "text", "status") and have("evidence", "statement", "locator_prefix", "locator_label") and have("evidence_relations", "relation", "review_status"):
        said = sets["evidence_relations"].select(F.col("hypothesis_id").alias("id"), "evidence_id", "relation", "review_status").join(sets["evidence"].select(F.col("id").alias("evidence_id"), "statement", F.col("locator_prefix").alias("prefix"), F.col("locator_label").alias("label")), "evidence_id")
        out["report"] = rs.research_report(sets["hypotheses"].select("question", "id", "title", "status"), said, sets["conclusions"].select("question", "id", "text", "status"))
    return out


def set_hashes(sets: Sets) -> DataFrame:
    """(question, set, records, hash) by the hash tree: records in 256 groups, groups in a set."""

    def of(name: str) -> DataFrame:
        df = sets[name]
        fields = sorted(c for c in df.columns if c != "question")
        h = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
        rows = df.select("question", h.alias("h"))
        groups = rows.groupBy("question", F.substring("h", 1, 2).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
        whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: F.concat(x["g"], x["h"])), ""), 256)
        return groups.groupBy("question").agg(F.sum("n").alias("records"), whole.alias("hash")).select("question", F.lit(name).alias("set"), "records", "hash")

    return _union([of(n) for n in sets])


def roots(hashes: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """(question, hash) over a question's sets: the whole archive's seal, or the state's fingerprint (H11) over STATE."""
    some = hashes if names is None else hashes.filter(F.col("set").isin(*names))
    return some.groupBy("question").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("set", "hash"))), lambda x: F.concat(x["set"], F.lit(":"), x["hash"])), "\n"), 256).alias("hash"))


def export(sets: Sets, path: str, questions: DataFrame | None = None) -> DataFrame:
    """Write the archive of questions(question), or of all, with its descriptions; returns its manifest (question, set, records, hash).

    A row of set `*` holds the seal over a question's sets, a row `state` its fingerprint.
    """
    found = scoped(sets)
    if questions is not None:
        found = {n: df.join(questions.select("question"), "question", "left_semi") for n, df in found.items()}
    for name, df in (found | descriptions(found)).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = sets["research_question"].sparkSession
    manifest(read(spark, path)).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> Sets:
    """The record sets of an archive or of a version of a store."""
    out: Sets = {}
    for name in (*SETS, *DESCRIPTIONS):
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def manifest(sets: Sets) -> DataFrame:
    hashes = written(set_hashes(sets), "hashes")
    one = lambda name, df: df.select("question", F.lit(name).alias("set"), F.lit(None).cast("long").alias("records"), "hash")
    return _union([hashes, one("*", roots(hashes)), one("state", roots(hashes, STATE))])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """What of an archive differs from its manifest: (question, set, sealed, found), null where one side has nothing."""
    sealed = spark.read.parquet(f"{path}/manifest").select("question", "set", F.col("hash").alias("sealed"))
    found = manifest(read(spark, path)).select("question", "set", F.col("hash").alias("found"))
    return sealed.join(found, ["question", "set"], "full_outer").filter(~F.col("sealed").eqNullSafe(F.col("found")))


def scope_violations(sets: Sets) -> DataFrame:
    """(question, set, field, value) of all that leads out of a question: sets that name another, references to records
    of another or of none, parents, approvals and events, and a second workflow. Sets have their `question`."""
    empty = sets["research_question"].sparkSession.createDataFrame([], VIOLATION)
    told = lambda df, name, field: df.select("question", F.lit(name).alias("set"), F.lit(field).alias("field"), F.col(field).cast("string").alias("value"))
    parts = [empty]
    for name in DIRECT:
        if name in sets:
            parts.append(told(sets[name].filter(~F.col("research_question_id").cast("string").eqNullSafe(F.col("question"))), name, "research_question_id"))
    if "workflow" in sets:
        many = sets["workflow"].groupBy("question").agg(F.count(F.lit(1)).alias("records")).filter("records > 1")
        parts.append(told(many, "workflow", "records"))

    def lost(name: str, field: str, others: DataFrame, optional: bool) -> DataFrame:
        rows = sets[name].select("question", F.col(field).cast("string").alias(field))
        rows = rows.filter(F.coalesce(F.col(field), F.lit("")) != "") if optional else rows
        return told(rows.join(others.select("question", F.col("id").cast("string").alias(field)).distinct(), ["question", field], "left_anti"), name, field)

    for name, field, other in REFERENCES:
        if name in sets:
            parts.append(lost(name, field, sets[other] if other in sets else empty.select("question", F.col("value").alias("id")), False))
    if "hypotheses" in sets and "parent_hypothesis_id" in sets["hypotheses"].columns:
        parts.append(lost("hypotheses", "parent_hypothesis_id", sets["hypotheses"], True))
    if "approvals" in sets:
        parts.append(lost("approvals", "entity_id", _ids(sets, ENTITIES).withColumnRenamed("entity_id", "id"), False))
    if "events" in sets:
        parts.append(lost("events", "entity_id", _ids(sets, (*ENTITIES, "approvals")).withColumnRenamed("entity_id", "id"), False))
        if "approval_request_id" in sets["events"].columns:
            parts.append(lost("events", "approval_request_id", sets.get("approvals", empty.select("question", F.col("value").alias("id"))), True))
    return _union(parts)


def published(spark: SparkSession, store: str) -> Sets:
    """The record sets of a store: all its published versions together."""
    try:
        versions = [r["version"] for r in spark.read.schema("version int, questions long").parquet(f"{store}/published").orderBy("version").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    out: Sets = {}
    for version in versions:
        for name, df in read(spark, f"{store}/version={version}").items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    return out


def restore(spark: SparkSession, path: str, store: str) -> tuple[int | None, DataFrame]:
    """Put an archive's questions into a store as one new version, published at the end or not at all.

    Returns the version and what speaks against it: (problem, question, detail). Refused are an archive that isn't as
    it was sealed, questions that the store has, references out of scope, hypotheses in a circle or without their
    parent, and a state that doesn't come out as it was. A version that wasn't published is overwritten by the next.
    """
    sets, there = read(spark, path), published(spark, store)
    row = lambda df, problem, detail: df.select(F.lit(problem).alias("problem"), "question", detail.cast("string").alias("detail"))
    against = [row(verify(spark, path), "not as sealed", F.col("set")), row(scope_violations(sets), "out of scope", F.concat_ws(".", "set", "field"))]
    if "research_question" in there:
        against.append(row(sets["research_question"].join(there["research_question"].select("question"), "question", "left_semi"), "question exists", F.col("id")))
    if "hypotheses" in sets and "parent_hypothesis_id" in sets["hypotheses"].columns:
        nodes = sets["hypotheses"].select(F.concat_ws("\x1f", "question", "id").alias("id"), F.when(F.coalesce("parent_hypothesis_id", F.lit("")) != "", F.concat_ws("\x1f", "question", "parent_hypothesis_id")).alias("parent"))
        stuck = rs.lineage_levels(spark, nodes).filter("level IS NULL").select(F.split("id", "\x1f")[0].alias("question"), F.split("id", "\x1f")[1].alias("id"))
        against.append(row(stuck, "lineage is cyclic or incomplete", F.col("id")))
    problems = written(_union(against), "problems")
    if problems.take(1):
        return None, problems
    versions = spark.read.parquet(f"{store}/published").agg(F.max("version")).first()[0] if there else None
    version = 0 if versions is None else versions + 1
    for name in SETS:  # a record comes after those it refers to
        if name in sets:
            sets[name].write.mode("overwrite").parquet(f"{store}/version={version}/{name}")
    sealed = spark.read.parquet(f"{path}/manifest").filter("set = 'state'").select("question", "hash")
    now = roots(set_hashes(read(spark, f"{store}/version={version}")), STATE)
    problems = written(row(sealed.join(now, ["question", "hash"], "left_anti"), "state differs", F.col("hash")), "problems")
    if problems.take(1):
        return None, problems
    spark.createDataFrame([(version, sets["research_question"].count())], "version int, questions long").coalesce(1).write.mode("append").parquet(f"{store}/published")
    return version, problems
