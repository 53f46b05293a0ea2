"""Functions on model messages, citations and plans; the ones that need match offsets or a parser are Arrow UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import has_cjk_or_kana

# The forms of a citation of a page, characters before one, pages an answer.
_CITATION = re.compile(r"p\.(\d{1,3})|第\s*(\d{1,3})\s*页")
HINT, CITATIONS = 120, 6


def _first_object(text: str | None) -> str | None:
    if not text:
        return None
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def extract_json(text: pd.Series) -> pd.Series:
    """the first balanced object that parses, as JSON with sorted keys; null if there is none."""
    return text.map(_first_object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("hint", T.StringType())])))
def citation_extract(answer: pd.Series) -> pd.Series:
    """the first mention of each page, six at most, with up to 120 characters before it."""
    def run(text: str | None) -> list:
        found: dict[int, str] = {}
        for m in _CITATION.finditer(text or ""):
            found.setdefault(int(m[1] or m[2]), text[max(0, m.start() - HINT) : m.start()])
        return [{"page": p, "hint": h} for p, h in list(found.items())[:CITATIONS]]

    return answer.map(run)


def message_text(parts: Column) -> Column:
    """the text parts of a message's array<struct<type, text>>, joined."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")


def plan_reject_reason(questions: Column) -> Column:
    """questions is array<struct<question, query>>; an empty string passes."""
    blank = F.exists(questions, lambda q: F.trim(F.coalesce(q["query"], F.lit(""))) == "")
    foreign = F.exists(questions, lambda q: has_cjk_or_kana(F.coalesce(q["query"], F.lit(""))))
    return F.when(F.coalesce(F.size(questions), F.lit(0)) <= 0, "no_sub_questions").when(foreign, "non_english_query").when(blank, "blank_query").otherwise("")


def format_hit(number: Column, title: Column, prefix: Column, label: Column, origin: Column, score: Column, kind: Column, body: Column) -> Column:
    """one source block; origin hybrid, vector, keyword or context says how it was found."""
    relevance = F.format_string("relevance %.2f", score)
    how = F.when(origin == "hybrid", F.concat(relevance, F.lit(" + exact terms"))).when(origin == "vector", relevance).when(origin == "keyword", "matched on exact terms").otherwise("context")
    head = F.concat(F.lit("[source "), number.cast("string"), F.lit(" | "), title, F.lit(" | "), F.coalesce(prefix, F.lit("p")), F.lit("."), label, F.lit(" | "), how, F.lit("]\n"))
    return F.concat(head, F.when(kind == "table", "[experimental table] ").otherwise(""), body)
