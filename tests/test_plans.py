"""Registered queries against their SQL on small tables of odd shapes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluate, ingest
from quillspark.plans import ORACLE_SQL, QUERIES, chains
from quillspark.plans.registry import Tables

duckdb = pytest.importorskip("duckdb")


def agrees(spark, folder, name, *tables):
    """Whether a query gives what its SQL gives over folder's tables."""
    base = duckdb.connect()
    for table in tables:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = QUERIES[name](spark, str(folder))
    wanted = base.execute(ORACLE_SQL[name]).fetchall()
    columns = [c[0] for c in base.description]
    return sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("name", ["filled_papers", "papers_for_year", "paper_lines"])
def test_papers_with_long_numbers(spark, tmp_path, name):
    rows = [(n, f"src{n % 3}", "de" if n % 2 else "en") for n in [*range(40), *range(99_980, 100_060), *range(1_234_560, 1_234_600)]]
    spark.createDataFrame(rows, "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert agrees(spark, tmp_path, name, "documents")


def counted(spark, df, column):
    """df whose column is made by a function that counts its calls, and the counter."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return df.withColumn(column, F.udf(same, "string")(column)), calls


def test_keys_of_sources_are_made_once(spark):
    keys, calls = counted(spark, spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "3"), ("c", "4")], "source string, content_key string"), "content_key")
    found = sorted((r.source, r.owner, r.shared, r.n, r.ratio) for r in ingest.containment(keys, keys).collect())
    assert found == [("a", "b", 1, 2, 0.5), ("b", "a", 1, 2, 0.5)] and calls.value == 5


def test_texts_of_questions_are_prepared_once(spark):
    rows = [(1, "what is a river delta"), (2, "what is a river"), (3, "nothing alike"), (4, "x"), (5, ""), (6, "What  is a river delta")]
    questions, calls = counted(spark, spark.createDataFrame(rows, "id long, text string"), "text")
    evals = spark.createDataFrame([(1, "what is a river delta"), (2, "X"), (3, "what is a rover")], "eval_id long, text string")
    grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)} or {t}
    form = lambda t: "".join(t.lower().split())
    like = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    wanted = [(i, e.eval_id, round(s, 9)) for i, t in rows for e in evals.collect() if (s := like(form(t), form(e.text))) >= 0.6]
    assert sorted((r.id, r.eval_id, round(r.similarity, 9)) for r in evaluate.leak_pairs(questions, evals).collect()) == wanted and len(wanted) > 3
    assert calls.value == len(rows)


def test_items_of_the_chain_are_joined_with_their_texts_once(spark, tmp_path):
    spark.createDataFrame([(n, f"src{n % 2}", f"text {n}") for n in range(6)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [1.0 * n]) for n in range(1, 5)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    items = chains._items(Tables(spark, str(tmp_path)))
    assert "Join" not in items._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc, r.source, r.chunk_ord, r.text) for r in items.collect()) == [(1, "src1", 1, "text 1"), (2, "src0", 1, "text 2"), (3, "src1", 2, "text 3"), (4, "src0", 2, "text 4")]
