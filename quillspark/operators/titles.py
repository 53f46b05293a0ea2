"""The title that a hint's words point to, through an inverted index on the titles' parts of three letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.retrieval import written

#: Letters of a part; titles of one part that meet in one group of a join.
GRAM, SPLIT = 3, 100_000


def grams(text: Column) -> Column:
    """Distinct parts of GRAM characters."""
    n = F.length(text) - (GRAM - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))


def titles_with(words: DataFrame, titles: DataFrame) -> DataFrame:
    """words(w) of GRAM characters or more, titles(id, t): the pairs (w, id) where t holds w.

    A title that holds a word has all its parts, so the titles of the part that fewest have are joined and then
    searched. Titles of a part that very many have are split, each piece joined by itself.
    """
    index = titles.select("id", F.explode(grams(F.col("t"))).alias("gram"))
    asked = words.select("w").distinct().select("w", F.explode(grams(F.col("w"))).alias("gram"))
    known = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(known, "gram", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("at")).filter("at.df > 0").select("w", "at.gram", "at.df")
    pieces = F.ceil(F.col("df") / SPLIT).cast("int")
    used = rarest.select("gram", pieces.alias("pieces")).distinct()
    held = index.join(used, "gram").select("id", "gram", F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece"))
    dealt = rarest.select("w", "gram", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    return held.join(dealt, ["gram", "piece"]).select("w", "id").join(titles, "id").filter(F.contains("t", "w")).select("w", "id")


def _counted(pairs: DataFrame, words: DataFrame, titles: DataFrame) -> DataFrame:
    """The best (k, id) of each hint among candidates (hint_id, id): how many of its words, repeats included, the title holds; ties to the largest id."""
    k = F.size(F.filter("ws", lambda w: F.contains(F.col("t"), w)))
    return pairs.join(words.select("hint_id", "ws"), "hint_id").join(titles, "id").groupBy("hint_id").agg(F.max(F.struct(k.alias("k"), "id")).alias("b"))


def best_titles(words: DataFrame, titles: DataFrame, least: float | None) -> DataFrame:
    """words(hint_id, ws), titles(id, t): hint_id, id, hits and n (words) of the title with most of the hint's words.

    With `least`, a title must hold that share of the words. Words that most titles hold don't propose candidates:
    of a title with so many words one at least is among the others. Without it, hints whose best title has no more
    words than were left out this way are looked up again by all their words.
    """
    each = words.select("hint_id", F.explode("ws").alias("w")).groupBy("hint_id", "w").agg(F.count(F.lit(1)).alias("times"))
    found = written(titles_with(each, titles), "title-words")
    df = found.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    size = words.select("hint_id", F.size("ws").alias("n"))
    needed = F.ceil(F.col("n") * F.lit(least) - 1e-9) if least is not None else F.floor(F.col("n") / 2) + 1
    order = Window.partitionBy("hint_id").orderBy(F.desc("df"), "w")
    ranked = each.join(df, "w").join(size, "hint_id").withColumn("up_to", F.sum("times").over(order)).withColumn("asks", F.col("up_to") >= needed)
    pairs = lambda rows: rows.select("hint_id", "w").join(found, "w").select("hint_id", "id").distinct()
    best = _counted(pairs(ranked.filter("asks")), words, titles)
    if least is None:
        left_out = ranked.groupBy("hint_id").agg(F.sum(F.when(~F.col("asks"), F.col("times")).otherwise(0)).alias("silent"))
        open_ = left_out.join(best, "hint_id", "left").filter((F.col("silent") > 0) & (F.coalesce("b.k", F.lit(0)) <= F.col("silent"))).select("hint_id")
        again = _counted(pairs(ranked.join(open_, "hint_id", "left_semi")), words, titles)
        best = best.join(open_, "hint_id", "left_anti").unionByName(again)
    return best.join(size, "hint_id").filter("b.k > 0").select("hint_id", F.col("b.id").alias("id"), F.col("b.k").alias("hits"), "n")


def resolve_title(hints: DataFrame, papers: DataFrame, least: float = 0.3, newest: int | None = None) -> DataFrame:
    """hints(hint_id, hint), papers(id, title) -> hint_id, id, score: the share of the hint's words of three letters or more that the title holds.

    Repeated words count each time; ties go to the newest; under `least` there is no answer. `newest` looks at so
    many papers only, those of the largest ids.
    """
    titles = (papers if newest is None else papers.orderBy(F.desc("id")).limit(newest)).select("id", F.lower("title").alias("t"))
    ws = F.filter(F.split(F.lower(F.coalesce("hint", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2)
    best = best_titles(hints.select("hint_id", ws.alias("ws")).filter(F.size("ws") > 0), titles, least)
    return best.select("hint_id", "id", (F.col("hits") / F.col("n")).alias("score")).filter(F.col("score") >= least)


def citation_to_paper(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """citations(hint_id, hint), the text before a citation -> hint_id, id, hits: the paper whose title holds most of its words; none at no hit.

    Words are runs of three ASCII letters or Chinese characters or more, repeats included; ties go to the newest.
    """
    titles = papers.select("id", F.lower("title").alias("t"))
    ws = F.regexp_extract_all(F.lower(F.coalesce("hint", F.lit(""))), F.lit("([a-z一-鿿]{3,})"), F.lit(1))
    return best_titles(citations.select("hint_id", ws.alias("ws")).filter(F.size("ws") > 0), titles, None).select("hint_id", "id", "hits")
