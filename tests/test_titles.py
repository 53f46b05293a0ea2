from __future__ import annotations

import random
import re

import pytest

from quillspark.operators import titles as tt


def best(words, titles, hits):
    """The title with most words, newest first, by trying all."""
    found = None
    for i, t in sorted(titles, reverse=True):
        k = sum(w in t.lower() for w in words)
        if k and (found is None or k > found[1]):
            found = (i, k)
    return found


def make(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "deep", "person", "search", "re", "net", "network", "graph", "人员重识", "été", "of", "a1b", "lon_g", "searching"]
    titles = [(n, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6))).title()) for n in range(40)] + [(40, ""), (41, None)]
    hints = [(n, " ".join(rng.choices([*vocabulary, "zzz", "unknown"], k=rng.randint(0, 9)))) for n in range(60)] + [(60, None), (61, "THE the The")]
    return titles, hints


@pytest.mark.parametrize("seed,split", [(1, 100_000), (2, 3)])
def test_titles_equal_all_pairs(spark, monkeypatch, seed, split):
    monkeypatch.setattr(tt, "SPLIT", split)
    titles, hints = make(seed)
    papers, asked = spark.createDataFrame(titles, "id int, title string"), spark.createDataFrame(hints, "hint_id int, hint string")
    held = [(i, t) for i, t in titles if t]
    want, cited = {}, {}
    for n, h in hints:
        ws = [w for w in re.split(r"[^\w]+", (h or "").lower()) if len(w) > 2]
        found = best(ws, held, 0)
        if found and found[1] / len(ws) >= 0.3:
            want[n] = (found[0], round(found[1] / len(ws), 9))
        if found := best(re.findall("[a-z一-鿿]{3,}", (h or "").lower()), held, 0):
            cited[n] = found
    assert {r.hint_id: (r.id, round(r.score, 9)) for r in tt.resolve_title(asked, papers).collect()} == want
    assert {r.hint_id: (r.id, r.hits) for r in tt.citation_to_paper(asked, papers).collect()} == cited


def test_newest_only(spark):
    papers = spark.createDataFrame([(1, "Person Search Deep Dive"), (2, "Deep Nets"), (3, "Other")], "id int, title string")
    asked = spark.createDataFrame([(1, "deep person search")], "hint_id int, hint string")
    assert [(r.id, r.score) for r in tt.resolve_title(asked, papers).collect()] == [(1, 1.0)]
    assert [r.id for r in tt.resolve_title(asked, papers, newest=2).collect()] == [2]


def test_no_nested_loop(spark):
    papers = spark.createDataFrame([(1, "Person Search")], "id int, title string")
    asked = spark.createDataFrame([(1, "person")], "hint_id int, hint string")
    plan = tt.resolve_title(asked, papers)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
