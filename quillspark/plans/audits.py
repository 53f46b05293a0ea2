"""Audits over the business tables, which have the shape of research records: customer, order, line, part."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import evaluate as ev
from quillspark.operators import research as rs
from quillspark.plans.registry import registry

QUERIES, SQL, query = registry()


@query("""WITH c AS (SELECT user_id AS entity, event_id, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events)
SELECT entity, event_id, f AS from_status, t AS to_status, CASE WHEN f IS NULL THEN 'initial' ELSE 'transition' END AS reason FROM c WHERE (f IS NULL AND t <> 'click') OR (f IS NOT NULL AND f <> t AND NOT f < t)""")
def transition_audit(t):
    """Event types as states that may only move up in alphabetical order, from click."""
    events = t.events.select(F.col("user_id").alias("entity"), "event_id", "event_type", "ts")
    kinds = events.select("event_type").distinct()
    allowed = kinds.select(F.col("event_type").alias("from_status")).join(kinds.select(F.col("event_type").alias("to_status")), F.col("from_status") < F.col("to_status"))
    bad = rs.transition_audit(rs.status_changes(events, "entity", "event_type", "ts", "event_id"), allowed, F.lit("click"))
    return bad.select("entity", "event_id", "from_status", "to_status", "reason")


@query("SELECT l_linestatus AS experiment, round(avg(l_extendedprice), 4) AS mean, round(avg(l_extendedprice) FILTER (l_returnflag = 'N'), 4) AS control, round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 4) AS treatment, round(avg(l_extendedprice) FILTER (l_returnflag = 'R') - avg(l_extendedprice) FILTER (l_returnflag = 'N'), 4) AS delta FROM lineitem GROUP BY 1")
def observation_stats(t):
    """Price by return flag."""
    rows = t.lineitem.select(F.col("l_linestatus").alias("experiment"), F.lit("price").alias("metric"), "l_returnflag", "l_extendedprice")
    s = rs.observation_stats(rows, "experiment", "l_returnflag", "metric", "l_extendedprice", "N", "R")
    return s.select("experiment", *[F.round(c, 4).alias(c) for c in ("mean", "control", "treatment", "delta")])


@query("SELECT o_orderkey AS a, l_suppkey AS b, c_nationkey AS scope_a, s_nationkey AS scope_b FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey")
def cross_scope(t):
    """Orders whose supplier is of another nation than their customer."""
    links = t.lineitem.select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    left = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("a"), F.col("c_nationkey").alias("scope"))
    right = t.supplier.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("scope"))
    return rs.cross_scope(links, left, right).select("a", "b", "scope_a", "scope_b")


_EDGES = """SELECT o_custkey AS root, o_custkey AS "from", o_orderkey AS "to", o_orderpriority AS type FROM orders
UNION ALL SELECT l_orderkey, l_orderkey, l_partkey, 'OBSERVATION' FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, p_size, 'EXPERIMENT' FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT l_orderkey, p_size, l2, 'RUN' FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT s_suppkey AS o, s_nationkey AS l2 FROM supplier) ON l_partkey = o"""


def _edges(t):
    evidence = t.orders.select(F.col("o_custkey").alias("conclusion_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("role"))
    observation = t.lineitem.select(F.col("l_orderkey").alias("conclusion_id"), F.col("l_partkey").alias("observation_id"))
    experiments = t.part.select(F.col("p_partkey").alias("observation_id"), F.col("p_size").cast("long").alias("experiment_id"))
    runs = t.supplier.select(F.col("s_suppkey").alias("observation_id"), F.col("s_nationkey").cast("long").alias("run_id"))
    return rs.provenance_edges(evidence, observation, experiments, runs)


@query(f'SELECT root, "from", "to", type FROM ({_EDGES})')
def provenance_edges(t):
    """Orders and lines as evidence and observations."""
    return _edges(t)


@query(f'SELECT DISTINCT root, unnest(["from", "to"]) AS id FROM ({_EDGES})')
def provenance_nodes(t):
    """H13."""
    return rs.provenance_nodes(_edges(t))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unsupported(t):
    """H8: customers without an urgent order."""
    return rs.missing_links(t.customer.select("c_custkey"), "c_custkey", t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("""WITH i AS (SELECT user_id % 50 AS question, user_id AS hypothesis, list(DISTINCT event_type) AS k FROM events GROUP BY ALL)
SELECT question, round(avg(list_contains(k, 'purchase')::INT), 4) AS coverage FROM i WHERE list_contains(k, 'click') GROUP BY 1""")
def contradiction_coverage(t):
    """H9: users who click, and of those the ones who buy."""
    intent = F.when(F.col("event_type") == "click", "PRIMARY").when(F.col("event_type") == "purchase", "CONTRADICTION").otherwise("MANUAL")
    return rs.contradiction_coverage(t.events.select((F.col("user_id") % 50).alias("question"), F.col("user_id").alias("hypothesis"), intent.alias("intent")))


@query("SELECT 'order' AS entity, o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def invalid_status(t):
    """Orders in no known status."""
    domain = t.spark.createDataFrame([("order", "O"), ("order", "F")], "entity string, status string")
    rows = t.orders.select(F.lit("order").alias("entity"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return rs.invalid_status(rows, domain).select("entity", "id", "status")


@query("SELECT 'r' || r_regionkey AS id, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer")
def lineage_levels(t):
    """Regions, nations and customers."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = t.region.select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")).unionByName(t.nation.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"))).unionByName(t.customer.select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent")))
    return rs.lineage_levels(t.spark, nodes)


@query("SELECT lang AS research_question_id, round(avg(CASE WHEN source = 'src0' THEN 1 ELSE (text <> '')::INT END), 4) AS traceability, round(avg(CASE WHEN source = 'src0' THEN (lang <> '')::INT END), 4) AS citation_integrity FROM documents GROUP BY 1")
def evidence_traceability(t):
    """H6, H7: documents of the largest source as literature."""
    rows = t.documents.select("doc_id", F.col("doc_id").alias("id"), F.col("lang").alias("research_question_id"), F.when(F.col("source") == "src0", "LITERATURE").otherwise("HUMAN_NOTE").alias("evidence_type"), F.when(F.col("source") == "src0", F.col("source")).when(F.col("text") != "", F.col("source")).alias("source_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("page"), F.lit(None).cast("string").alias("section"), F.col("source").alias("excerpt"), F.lit("page").alias("locator_kind"))
    return rs.evidence_traceability(rows)


@query()
def state_fingerprint(t):
    """Customers with their orders; no SQL, since the hashed JSON is Spark's."""
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return rs.record_fingerprint({"customer": t.customer, "orders": orders}, "c_custkey")


@query("SELECT event_type AS agent, 'value' AS metric, count(*) AS runs, round(avg(value), 6) AS mean, min(value) AS worst, max(value) AS best, max(value) > min(value) AS jitter FROM events WHERE value IS NOT NULL GROUP BY 1")
def compare_runs(t):
    """Event values as a metric of runs."""
    rows = t.events.select(F.col("event_type").alias("agent"), F.col("event_id").alias("run"), F.lit("value").alias("metric"), "value")
    return ev.compare_runs(rows, {"value": "max"}).withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_totalprice > 200000) AS h FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT c_custkey AS question, unnest(['SEARCH_SUPPORTING_EVIDENCE', 'SEARCH_CONTRADICTING_EVIDENCE', 'ASSESS_EVIDENCE', 'HUMAN_APPROVAL', 'WAIT_FOR_RESULT', 'BUILD_OBSERVATION', 'UPDATE_HYPOTHESIS', 'GENERATE_RESEARCH_REPORT']) AS stage, unnest([o > 0, f > 0, h > 0, o > 0, f > 0, h > 0, o > 0, f > 0]) AS open FROM c""")
def workflow_gates(t):
    """Counts of a customer's orders as counts of a question's records."""
    c = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("question")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_totalprice") > 200000).alias("h"))
    names = {"registered_hypotheses": "o", "primary_searches": "f", "contradiction_searches": "h", "planned_experiments": "o", "approved_experiments": "f", "completed_runs": "h", "observations": "o", "approved_conclusions": "f"}
    return rs.workflow_gates(c.select("question", *[F.col(v).alias(k) for k, v in names.items()]))


@query("SELECT o_custkey AS entity_id, o_orderpriority AS action FROM orders WHERE (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F')")
def approvals_missing(t):
    """Orders of a customer and priority of which none is finished."""
    rows = t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("action"), F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("PENDING").alias("status"))
    return rs.approvals_missing(rows.select("entity_id", "action"), rows)
