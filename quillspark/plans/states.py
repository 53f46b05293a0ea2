"""Stores, archives, imports and run summaries over rows of the business tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import canonical as cn
from quillspark.operators import archive, catalog
from quillspark.operators import evaluate as ev
from quillspark.operators import research as rs
from quillspark.plans.registry import registry
from quillspark.sources.builds import read_build, write_build
from quillspark.sources.folders import shared_folder
from quillspark.streaming import ingest

QUERIES, SQL, query = registry()

_EXTENSIONS = [".txt", ".md", ".text", ".exe", ".pdf"]


@query("WITH f AS (SELECT CASE doc_id % 5 WHEN 3 THEN 'unsupported_extension' WHEN 4 THEN 'bad_magic' ELSE 'read' END AS outcome FROM documents) SELECT outcome, count(*) AS files FROM f GROUP BY 1")
def ingest_ledger(t):
    """Documents as files of five kinds, through the stream and into a store; what became of them, by its ledger and its tables."""
    files, store = shared_folder(t.spark, "files"), shared_folder(t.spark, "store")
    extension = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = t.documents.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), extension).alias("path"), F.timestamp_seconds(F.lit(0)).alias("modificationTime"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    rows.write.parquet(files)
    stream = t.spark.readStream.schema(ingest.FILES).option("maxFilesPerTrigger", 64).parquet(files)
    ingest.ingest_stream(stream, store, shared_folder(t.spark, "checkpoint")).awaitTermination()
    done = ingest.table(t.spark, store, "ledger").select("batch")
    refused = ingest.table(t.spark, store, "refused").join(done, "batch", "left_semi").select(F.col("reason").alias("outcome"))
    read = ingest.table(t.spark, store, "papers").join(done, "batch", "left_semi").select(F.lit("read").alias("outcome"))
    return refused.unionByName(read).groupBy("outcome").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS hash FROM events")
def canonical_props(t):
    """the properties of events, written without spaces and with their one key."""
    return t.events.select("event_id", cn.json_hash(F.col("props")).alias("hash"))


@query("WITH i AS (SELECT event_id, event_id % 3 AS k, props, user_id, event_type FROM events) SELECT event_id, CASE k WHEN 0 THEN 'e' || user_id ELSE event_type END AS experiment_id, CASE k WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN '{\"k\":' || user_id || ',\"note\":\"' || event_type || '\"}' END AS metrics, k = 2 AS refused FROM i WHERE k < 2 UNION ALL SELECT event_id, NULL, NULL, true FROM i WHERE k = 2")
def run_imports(t):
    """Events as run imports in JSON, in CSV, and in a CSV of two rows, which is refused."""
    e = t.events
    json = F.format_string('{"metrics": %s, "experiment_id": "e%s"}', "props", F.col("user_id").cast("string"))
    table = F.concat(F.lit("experiment_id,metrics.note,metrics.k\n"), F.concat_ws(",", "event_type", "event_type", F.col("user_id").cast("string")), F.lit("\n"))
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, json).when(kind == 1, table).otherwise(F.concat(table, F.lit("x,y,1\n")))
    parsed = e.select("event_id", cn.run_import(text, F.when(kind == 0, "json").otherwise("csv")).alias("i"))
    return parsed.select("event_id", "i.experiment_id", "i.metrics", F.col("i.problem").isNotNull().alias("refused"))


@query("""WITH a AS (SELECT c_custkey, 'CONFIRM_RUN_IMPORT:' || left(sha256('1-URGENT' || c_custkey), 32) AS action, sha256('1-URGENT' || c_custkey) AS h, CASE WHEN c_acctbal > 0 THEN 'APPROVED' ELSE 'PENDING' END AS status FROM customer),
i AS (SELECT o_orderkey AS import_id, o_custkey, sha256(o_orderpriority || o_custkey) AS h FROM orders WHERE o_orderstatus <> 'F'), r AS (SELECT DISTINCT sha256(o_orderpriority || o_custkey) AS h FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000),
m AS (SELECT import_id, i.h, coalesce(a.h = i.h AND status = 'APPROVED', false) AS fits FROM i LEFT JOIN a ON c_custkey = o_custkey)
SELECT import_id, CASE WHEN NOT fits THEN 'no matching approval' WHEN h IN (SELECT h FROM r) OR row_number() OVER (PARTITION BY h, fits ORDER BY import_id) > 1 THEN 'payload exists' ELSE '' END AS reason FROM m""")
def confirmed_imports(t):
    """Open orders as imports whose payload is their priority, customers as approvals of urgent ones, large finished orders as runs."""
    h = lambda c: F.sha2(F.concat(c, F.col("o_custkey").cast("string")), 256)
    orders = t.orders.withColumn("payload_hash", h(F.col("o_orderpriority")))
    imports = orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("import_id"), F.col("o_custkey").cast("string").alias("experiment_id"), "payload_hash", F.col("o_custkey").alias("approval_id"))
    own = F.sha2(F.concat(F.lit("1-URGENT"), F.col("c_custkey").cast("string")), 256)
    approvals = t.customer.select(F.col("c_custkey").alias("approval_id"), F.col("c_custkey").cast("string").alias("entity_id"), F.concat(F.lit("CONFIRM_RUN_IMPORT:"), F.substring(own, 1, 32)).alias("action"), own.alias("approved_hash"), F.when(F.col("c_acctbal") > 0, "APPROVED").otherwise("PENDING").alias("status"))
    runs = orders.filter("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("payload_hash").alias("import_hash"))
    return rs.confirmed_imports(imports, approvals, runs).select("import_id", "reason")


def _sets(t):
    """Nations as questions, suppliers as hypotheses, customers as evidence, lines as their relations, orders as search attempts of their customer's nation."""
    text = lambda c: F.col(c).cast("string")
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    of = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return {
        "research_question": t.nation.select(text("n_nationkey").alias("id"), F.col("n_name").alias("title")),
        "hypotheses": t.supplier.select(text("s_suppkey").alias("id"), text("s_nationkey").alias("research_question_id"), F.when(F.col("s_suppkey") >= 25, (F.col("s_suppkey") - 25).cast("string")).alias("parent_hypothesis_id")),
        "evidence": t.customer.select(text("c_custkey").alias("id"), text("c_nationkey").alias("research_question_id"), F.col("c_mktsegment").alias("evidence_type")),
        "evidence_relations": lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), text("l_suppkey").alias("hypothesis_id"), text("o_custkey").alias("evidence_id")),
        "search_attempts": of.select(text("o_orderkey").alias("id"), text("c_nationkey").alias("research_question_id")),
    }


_RELATIONS = "r AS (SELECT s_nationkey AS q, o_custkey, c_nationkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN customer ON c_custkey = o_custkey)"


@query(f"""WITH {_RELATIONS} SELECT q::VARCHAR AS question, 'evidence_relations' AS record_set, 'evidence_id' AS field, count(*) AS found FROM r WHERE c_nationkey IS DISTINCT FROM q GROUP BY 1
UNION ALL SELECT a.s_nationkey::VARCHAR, 'hypotheses', 'parent_hypothesis_id', count(*) FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey - 25 WHERE a.s_suppkey >= 25 AND b.s_nationkey IS DISTINCT FROM a.s_nationkey GROUP BY 1""")
def archive_violations(t):
    """Relations to customers of another nation, and parents of another."""
    found = archive.scope_violations(archive.scoped(_sets(t)))
    return found.groupBy("question", F.col("set").alias("record_set"), "field").agg(F.count(F.lit(1)).alias("found"))


@query(f"""WITH {_RELATIONS}, m AS (SELECT n_nationkey::VARCHAR AS question, 'research_question' AS record_set, 1 AS records FROM nation UNION ALL SELECT s_nationkey::VARCHAR, 'hypotheses', count(*) FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey::VARCHAR, 'evidence', count(*) FROM customer GROUP BY 1
UNION ALL SELECT q::VARCHAR, 'evidence_relations', count(*) FROM r GROUP BY 1 UNION ALL SELECT c_nationkey::VARCHAR, 'search_attempts', count(*) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT *, true AS intact FROM m""")
def archive_manifest(t):
    """An archive of all nations, written, sealed and checked: records of each set, and whether they are as sealed."""
    path = shared_folder(t.spark, "archive")
    sealed = archive.export(_sets(t), path)
    off = archive.verify(t.spark, path).select("question", "set").withColumn("off", F.lit(True))
    return sealed.filter("records IS NOT NULL").join(off, ["question", "set"], "left").select("question", F.col("set").alias("record_set"), "records", F.col("off").isNull().alias("intact"))


@query("""WITH s AS (SELECT n_nationkey::VARCHAR AS question FROM nation WHERE n_nationkey % 2 = 0), h AS (SELECT s_nationkey::VARCHAR AS question, count(*) AS n FROM supplier GROUP BY 1), e AS (SELECT c_nationkey::VARCHAR AS question, count(*) AS n FROM customer GROUP BY 1)
SELECT question, coalesce(h.n, 0) AS hypotheses, coalesce(e.n, 0) AS evidence FROM s LEFT JOIN h USING (question) LEFT JOIN e USING (question)""")
def restored_questions(t):
    """Nations of even numbers put into a store from an archive of theirs; another one's questions are there already, so it leaves nothing."""
    sets = _sets(t)
    sets = {n: sets[n] for n in ("research_question", "evidence")} | {"hypotheses": sets["hypotheses"].drop("parent_hypothesis_id")}
    path, again, store = (shared_folder(t.spark, n) for n in ("archive", "archive", "store"))
    even = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("question"))
    archive.export(sets, path, even)
    archive.restore(t.spark, path, store)
    archive.export(sets, again)
    archive.restore(t.spark, again, store)
    there = archive.published(t.spark, store)
    n = lambda name: there[name].groupBy("question").agg(F.count(F.lit(1)).alias(name))
    return there["research_question"].select("question").join(n("hypotheses"), "question", "left").join(n("evidence"), "question", "left").na.fill(0)


_SNAPSHOT = "SELECT l_orderkey, min(l_linestatus) AS status, count(*) AS lines FROM lineitem WHERE l_shipdate < '{}' GROUP BY 1"


@query(f"""WITH b AS ({_SNAPSHOT.format("1998-01-01")}), a AS ({_SNAPSHOT.format("1999-01-01")}), j AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS k, a.status AS s, b.status AS t, a.lines AS n, b.lines AS m FROM a FULL JOIN b USING (l_orderkey))
SELECT 'Order' AS entity_type, k::VARCHAR AS entity_id, CASE WHEN t IS NULL THEN 'CREATED' WHEN s IS NULL THEN 'DELETED' WHEN s <> t THEN 'STATUS_CHANGED' ELSE 'UPDATED' END AS event_type, CASE WHEN o_orderpriority = '1-URGENT' THEN 'clerk' ELSE 'system' END AS actor,
    CASE WHEN t IS NULL THEN '{{}}' ELSE '{{"lines":' || m || ',"status":"' || t || '"}}' END AS before, CASE WHEN s IS NULL THEN '{{}}' ELSE '{{"lines":' || n || ',"status":"' || s || '"}}' END AS after, CASE WHEN o_orderpriority = '1-URGENT' THEN 'c' || o_custkey END AS approval_request_id
FROM j JOIN orders ON o_orderkey = k WHERE s IS DISTINCT FROM t OR n IS DISTINCT FROM m""")
def event_log(t):
    """Orders as their shipped lines had them at two dates; urgent ones were changed by someone, with leave."""
    at = lambda day: t.lineitem.filter(F.col("l_shipdate") < F.lit(day).cast("timestamp")).groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linestatus").alias("status"), F.count(F.lit(1)).alias("lines"))
    by = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.lit("clerk").alias("actor"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("approval_request_id"))
    return rs.event_log(at("1998-01-01"), at("1999-01-01"), "Order", "id", by=by)


@query("""WITH l AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS e, count(*) FILTER (l_returnflag = 'R' AND p_size > 25) AS strong, count(*) FILTER (l_linestatus = 'O' AND l_discount < 0.02) AS o FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), j AS (SELECT o_orderkey AS id, coalesce(e, 0) AS e, coalesce(strong, 0) AS strong, coalesce(o, 0) AS o FROM orders LEFT JOIN l ON id = o_orderkey)
SELECT id, CASE WHEN e + o = 0 THEN 'no support' ELSE 'only notes and hypotheses' END AS reason FROM j WHERE e + o = 0 OR (o = 0 AND strong = 0)""")
def conclusion_support(t):
    """Orders as conclusions, lines sent back as what supports them by its part, cheap open lines as observations."""
    links = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("evidence_id"), F.when(F.col("l_returnflag") == "R", "SUPPORTING").otherwise("CONTRADICTING").alias("role"))
    kinds = t.part.select(F.col("p_partkey").alias("evidence_id"), F.when(F.col("p_size") > 25, "LITERATURE").otherwise("HUMAN_NOTE").alias("evidence_type"))
    seen = t.lineitem.filter("l_linestatus = 'O' AND l_discount < 0.02").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("observation_id"))
    return rs.conclusion_support(t.orders.select(F.col("o_orderkey").alias("id")), links, kinds, seen)


_RECORDS = "r AS (SELECT CASE lang WHEN 'en' THEN 'A' WHEN 'de' THEN 'B' ELSE 'C' END AS type, quality IS NOT NULL AS judged, quality = 1 AS hit, toxic = 0 AS clean, n_chars, toxic, contains(text, 'http') AS odd, length(source) AS calls FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"""WITH {_RECORDS}, j AS (SELECT * FROM r WHERE judged), t AS (SELECT type, count(*) AS judged, round(avg(hit::INT), 3) AS hit, round(avg(clean::INT), 3) AS clean, round(avg((hit AND clean)::INT), 3) AS ok, round(avg((n_chars % 7) / CASE WHEN n_chars % 9 = 0 THEN 1 ELSE n_chars % 9 END), 3) AS cover, round(avg((n_chars > 1500)::INT), 3) AS cited, round(avg((toxic > 0)::INT), 3) AS over, round(avg((NOT hit)::INT), 3) AS scoped FROM j GROUP BY 1)
SELECT type, (SELECT count(*) FROM r WHERE r.type = t.type) AS total, judged, CASE type WHEN 'A' THEN hit END AS retrieval_recall, CASE type WHEN 'A' THEN clean END AS evidence_recall, ok AS verdict_accuracy, CASE type WHEN 'A' THEN cover END AS avg_concept_coverage, CASE type WHEN 'A' THEN cited END AS citation_ok_rate, CASE type WHEN 'B' THEN over END AS over_claim_rate, CASE type WHEN 'B' THEN scoped END AS scope_qualified_rate,
    NULL::BIGINT AS not_judged, NULL::BIGINT AS parse_warnings, NULL::BOOLEAN AS metric_reliable, NULL::DOUBLE AS avg_tool_calls, NULL::BIGINT AS avg_context_chars, NULL::DOUBLE AS avg_seconds FROM t
UNION ALL SELECT NULL, count(*), count(*) FILTER (judged), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FILTER (NOT judged), sum(odd::INT)::BIGINT, bool_and(judged) AND sum(odd::INT) = 0, round(avg(calls), 2), floor(avg(n_chars))::BIGINT, round(avg(n_chars / 1000), 1) FROM r""")
def eval_types(t):
    """Documents as answers of three types by language, labels as their judgements."""
    d = t.documents.join(t.labels, "doc_id", "left")
    n = F.col("n_chars")
    records = d.select(
        F.when(F.col("lang") == "en", "A").when(F.col("lang") == "de", "B").otherwise("C").alias("type"), F.col("quality").isNotNull().alias("judged"), (F.col("quality") == 1).alias("retrieval_hit"), (F.col("toxic") == 0).alias("evidence_hit"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("verdict_correct"),
        (n % 7).alias("concepts_covered"), (n % 9).alias("concepts_total"), (n > 1500).alias("citation_ok"), F.col("toxic").alias("violations"), (F.col("quality") == 0).alias("scope_qualified"), F.contains("text", F.lit("http")).cast("int").alias("parse_warnings"), F.length("source").alias("tool_calls"), n.alias("context_chars"), (n / 1000).alias("seconds"),
    )
    return ev.eval_summary(records)


@query("WITH r AS (SELECT event_type AS agent, user_id AS stamp, count(*) AS total, min(value) > 0.2 AS fine FROM events GROUP BY ALL) SELECT agent, string_agg(DISTINCT total, ',' ORDER BY total) AS totals, count(DISTINCT total) <= 1 AS consistent, coalesce(string_agg(stamp, ',' ORDER BY stamp) FILTER (NOT fine), '') AS unreliable FROM r GROUP BY 1")
def run_sizes(t):
    """An event type's users as its runs, with as many questions as they have events; one with a value near 0 can't be relied on."""
    runs = t.events.groupBy(F.col("event_type").alias("agent"), F.col("user_id").alias("stamp")).agg(F.count(F.lit(1)).alias("total"), (F.min("value") > 0.2).alias("metric_reliable"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return ev.run_sizes(runs).select("agent", text("totals"), "consistent", text("unreliable"))


@query("WITH m AS (SELECT event_type || '.' || k AS metric, v, after FROM (SELECT event_type, 'mean' AS k, avg(value) AS v, user_id % 2 AS after FROM events GROUP BY ALL UNION ALL SELECT event_type, 'runs', count(*), user_id % 2 FROM events GROUP BY ALL)) SELECT metric, round(b.v, 6) AS before, round(a.v, 6) AS after, round(a.v - b.v, 6) AS delta, CASE WHEN abs(a.v - b.v) <= 1e-9 THEN 'same' WHEN a.v > b.v THEN 'up' ELSE 'down' END AS arrow FROM (FROM m WHERE after = 0) b JOIN (FROM m WHERE after = 1) a USING (metric)")
def metric_deltas(t):
    """Metrics of the events of even users, and of odd ones."""
    g = t.events.groupBy("event_type", (F.col("user_id") % 2).alias("after")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).cast("double").alias("runs"))
    m = g.unpivot(["event_type", "after"], ["mean", "runs"], "k", "value").select(F.concat_ws(".", "event_type", "k").alias("metric"), "after", "value")
    out = ev.metric_deltas(m.filter("after = 0"), m.filter("after = 1"))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")], "arrow")


@query("SELECT o_orderkey AS item, o_orderpriority AS paper, coalesce(string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber), nullif(o_custkey % 9, 0)::VARCHAR) AS pages FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_custkey HAVING coalesce(string_agg(DISTINCT l_linenumber, ','), nullif(o_custkey % 9, 0)::VARCHAR) IS NOT NULL")
def expected_pages(t):
    """Orders as questions whose pages are their lines' numbers, or where there are none one of their own."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_linenumber")).alias("pdf_pages"))
    items = t.orders.join(lines, "o_orderkey", "left").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("paper"), (F.col("o_custkey") % 9).cast("int").alias("pdf_page"), "pdf_pages")
    return ev.expected_pages(items).select("item", "paper", F.array_join("pages", ",").alias("pages"))


@query("SELECT DISTINCT '- ' || p_name AS line FROM part")
def distinct_titles(t):
    """C12."""
    return catalog.distinct_titles(t.part.select(F.col("p_name").alias("title")))


@query("SELECT r_regionkey AS id, r_name AS name FROM region ORDER BY r_regionkey")
def list_collections(t):
    """C13."""
    return catalog.list_collections(t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@query("WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS s FROM documents) SELECT source AS item, string_agg(doc_id, ',' ORDER BY r) FILTER (r <= 20) = string_agg(doc_id, ',' ORDER BY s) FILTER (s <= 20) AS same, round(count(*) FILTER (r <= 20 AND s <= 20) / greatest(count(*) FILTER (r <= 20), count(*) FILTER (s <= 20)), 6) AS overlap FROM a GROUP BY 1")
def run_repeatability(t):
    """A source's first twenty documents by number, and by length."""
    by = lambda *order: t.documents.select(F.col("source").alias("item"), F.col("doc_id").alias("doc"), F.row_number().over(Window.partitionBy("source").orderBy(*order)).alias("rank")).filter("rank <= 20")
    return ev.run_repeatability(by("doc_id"), by("n_chars", "doc_id")).withColumn("overlap", F.round("overlap", 6))


@query("WITH d AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'APPROVED' ELSE 'REJECTED' END AS decision, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'CANCELLED' ELSE 'PLANNED' END AS status FROM orders) SELECT 'experiment' AS entity_type, o_orderkey AS entity_id, 'RUN' AS action, CASE decision WHEN 'APPROVED' THEN 'APPROVED' ELSE 'CANCELLED' END AS expected, status FROM d WHERE status <> CASE decision WHEN 'APPROVED' THEN 'APPROVED' ELSE 'CANCELLED' END")
def approval_effects(t):
    """Large orders as approved experiments, small ones as refused; those that aren't where they should be."""
    o = t.orders.select(F.lit("experiment").alias("entity_type"), F.col("o_orderkey").alias("entity_id"), F.lit("RUN").alias("action"), F.when(F.col("o_totalprice") > 200000, "APPROVED").otherwise("REJECTED").alias("decision"), F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "CANCELLED").otherwise("PLANNED").alias("status"))
    return rs.approval_effects(o.select("entity_type", "entity_id", "action", F.col("decision").alias("status")), o.select("entity_type", "entity_id", "status"))


@query("SELECT DISTINCT o_orderkey AS id, l_partkey AS source FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT EXISTS (FROM lineitem b JOIN orders c ON b.l_orderkey = c.o_orderkey WHERE c.o_custkey = orders.o_custkey AND b.l_partkey = lineitem.l_partkey AND b.l_linestatus = 'F' AND b.l_returnflag = orders.o_orderstatus)")
def proposal_sources(t):
    """Orders as proposals of their customer, their parts as sources; finished lines of the customer whose flag is the order's status back them."""
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), "l_orderkey")
    proposals = lines.groupBy(F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("question"), F.col("o_orderstatus").alias("kind")).agg(F.collect_set("l_partkey").alias("sources"))
    relations = lines.select(F.col("o_custkey").alias("question"), F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("source"), F.when(F.col("l_linestatus") == "F", "CONFIRMED").otherwise("PROPOSED").alias("review_status"))
    return rs.proposal_source_check(proposals, relations)


@query("SELECT md5(line) AS line, count(*) AS n FROM (SELECT '{\"conv_id\":' || conv_id || ',\"turn\":' || turn || ',\"role\":\"' || role || '\"}' AS line FROM conversations) GROUP BY 1")
def written_build(t):
    """Turns as lines of JSON, written by tasks, committed once, and read by what the manifest names."""
    path = shared_folder(t.spark, "build")
    write_build(t.conversations.select(F.to_json(F.struct("conv_id", "turn", "role")).alias("line"), "role"), path, tally="role")
    return read_build(t.spark, path).groupBy(F.md5(F.col("line").cast("binary")).alias("line")).agg(F.count(F.lit(1)).alias("n"))
