from __future__ import annotations

import pytest

from quillspark.operators import retrieval as rt
from quillspark.operators import segments as sg

WORDS = ["apple", "river", "stone", "cloud", "tiger", "maple", "ocean", "candle", "violin", "rocket"]


def text(n):
    return " ".join(WORDS[(n * k + k * k) % 10] for k in range(1, 4 + n % 5)) + f" w{n}"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc long, text string")


def ranks(index, queries):
    return sorted((r.query_id, r.doc, r["rank"], round(r.score, 9)) for r in rt.bm25_topk(index, queries, "query_id", "q").collect())


def test_an_updated_index_ranks_as_a_new_one(spark, tmp_path):
    root = str(tmp_path / "index")
    queries = spark.createDataFrame([(1, "apple river w3"), (2, "tiger ocean cloud"), (3, "violin rocket new")], "query_id int, q string")
    docs = [(n, text(n)) for n in range(60)]
    steps = [docs, [(n, t) for n, t in docs if n != 5] + [(60, "violin new")], [(n, "candle new apple" if n == 7 else t) for n, t in docs if n != 5] + [(60, "violin new"), (61, None)], [(n, text(n + 1)) for n in range(50)], [(1, "")]]
    for n, rows in enumerate(steps):
        given = frame(spark, rows)
        assert sg.is_stale(given, root)
        assert sg.update_index(given, root) == n and not sg.is_stale(given, root)
        index, new = sg.read_index(spark, root, "bigint"), rt.bm25_index(given, "doc", "text")
        assert (index.n, index.avgdl) == (new.n, pytest.approx(new.avgdl))
        assert ranks(index, queries) == ranks(new, queries)
        assert {r.term: (r.df, r.kept) for r in index.terms.collect()} == {r.term: (r.df, r.kept) for r in new.terms.collect()}
    assert sg.update_index(frame(spark, steps[-1]), root) == len(steps) - 1  # nothing has changed: no new snapshot
    assert ranks(sg.read_index(spark, root, "bigint", 1), queries) == ranks(rt.bm25_index(frame(spark, steps[1]), "doc", "text"), queries)


def test_a_change_that_keeps_the_number_is_noticed_and_small_updates_are_small(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = [(n, text(n)) for n in range(40)]
    sg.update_index(frame(spark, docs), root)
    docs[3] = (3, "stone stone stone")
    assert sg.is_stale(frame(spark, docs), root)
    sg.update_index(frame(spark, docs), root)
    assert spark.read.parquet(f"{root}/held/segment=1").count() == 1
    # An update that ended before its snapshot doesn't count, and the next one takes its place.
    frame(spark, [(1, "x")]).write.parquet(f"{root}/held/segment=2")
    assert sg.latest_snapshot(spark, root)["snapshot"] == 1 and sg.read_index(spark, root, "bigint").n == 40


def test_shared_index(spark):
    a, b = frame(spark, [(n, text(n)) for n in range(9)]), frame(spark, [(n, text(n)) for n in reversed(range(9))])
    assert sg.shared_index(a, "doc", "text") is sg.shared_index(b, "doc", "text")
    assert sg.shared_index(a.filter("doc > 0"), "doc", "text") is not sg.shared_index(a, "doc", "text")


@pytest.mark.parametrize("digits", [None, 9])
def test_best_documents_are_those_of_all_scores(spark, monkeypatch, digits):
    monkeypatch.setattr(rt, "CELLS", 30)
    monkeypatch.setattr(rt, "ASKED", 4)
    docs = [(n, text(n % 37) if n % 5 else "") for n in range(90)] + [(90, None), (91, "kiwi kiwi apple")]
    queries = spark.createDataFrame([(1, "apple river w3"), (2, "tiger ocean cloud w7 w7"), (3, "kiwi w9 nothing"), (4, "absent"), (5, None)], "query_id int, q string")
    monkeypatch.setattr(rt, "MAX_DF", 0.9)
    index = rt.bm25_index(frame(spark, docs), "doc", "text")
    asked = rt.bm25_index(frame(spark, docs), "doc", "text", rt.asked_terms(queries, "query_id", "q"))
    every = sorted((r.query_id, -round(r.score, 9), r.doc) for r in rt.bm25_scores(index, queries, "query_id", "q").collect())
    wanted = [x for q in range(1, 6) for x in [x for x in every if x[0] == q][:7]]
    for of in (index, asked):
        assert sorted((r.query_id, -round(r.score, 9), r.doc) for r in rt.bm25_best(of, queries, "query_id", "q", 7, digits).collect()) == wanted
    assert asked.terms.count() < index.terms.count() and (asked.n, asked.avgdl) == (index.n, index.avgdl)


def test_documents_are_counted_and_scored_without_a_shuffle(spark):
    docs = frame(spark, [(1, "b a b"), (2, None)])
    counted = rt.counted_documents(docs)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc, r.dl, sorted(zip(r.words, r.tfs, strict=True))) for r in counted.collect()) == [(1, 3, [("a", 1), ("b", 2)]), (2, 0, [])]
