"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) with a numpy linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import first_by_hash, id_remainder, map_arrow, table

#: Bounds of the sample that the classifier is fitted on; everything else covers all rows.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 3000, 6000, 512
THRESHOLD = 0.7
#: Lengths of the beginnings of words that count.
STEMS = (3, 4, 5, 6)
#: Confirmed texts that must hold a feature before it is learnt from.
LEAST = 3
#: How many times as frequent a feature must be among confirmed texts as among all.
LIFT = 3.0
#: The least log-likelihood ratio of a feature: over the logarithm of the number of features that chance may favour.
LEAST_GAIN = 5.0
_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words, and beginnings that two or three longer words share or more ('begin*2', 'begin*3')."""
    counts = Counter(_WORD.findall(text.lower())) if text else {}
    found = set(counts)
    for size in STEMS:
        begun: dict[str, int] = {}
        for w, n in counts.items():
            if len(w) > size:
                begun[w[:size]] = begun.get(w[:size], 0) + n
        for stem, n in begun.items():
            if n >= 2:
                found.add(f"{stem}*2")
            if n >= 3:
                found.add(f"{stem}*3")
    return found


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    @cached_property
    def stems(self) -> tuple[frozenset[str], frozenset[str]]:
        """Beginnings that have a weight, and their first letters."""
        own = frozenset(f[:-2] for f in self.weights if f[-2:-1] == "*")
        return own, frozenset(x[: STEMS[0]] for x in own)

    def score(self, text: str | None) -> float:
        own, heads = self.stems
        counts = Counter(_WORD.findall(text.lower())) if text else {}
        found, begun = list(self.weights.keys() & counts.keys()), {}
        head = STEMS[0]
        for w, n in counts.items():
            if w[:head] in heads:
                for size in STEMS:
                    if len(w) > size and (stem := w[:size]) in own:
                        begun[stem] = begun.get(stem, 0) + n
        for stem, n in begun.items():
            found += [f for k in (2, 3) if n >= k and (f := f"{stem}*{k}") in self.weights]
        f = self.bias + math.fsum(self.weights[x] for x in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, f))))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, rounds: int = 600, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), logistic loss.

    Rows are arrays of the indexes of their features. When the estimate of the negative part is below 0, a
    step is made against it, as the method asks.
    """

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return at, np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)

    (pa_, pf), (ua, uf) = flat(positive), flat(unlabelled)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, rounds + 1):
        fp = np.bincount(pa_, w[pf], len(positive)) + b
        fu = np.bincount(ua, w[uf], len(unlabelled)) + b
        negative = np.logaddexp(0, fu).sum() / n_u - prior * np.logaddexp(0, fp).sum() / n_p
        sp, su = prior * sig(fp) / n_p, sig(fu) / n_u
        gp, gu = (np.full(len(positive), -prior / n_p), su) if negative >= 0 else (sp, -su)  # -prior * (1 - s) - prior * s
        grad = np.append(np.bincount(pf, gp[pa_], width) + np.bincount(uf, gu[ua], width) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(i, y, sorted(features(t))) for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.list_(pa.string()))], ["i", "y", "f"])


def train(docs: DataFrame, labels: DataFrame, held_in, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most MAX_POSITIVE confirmed rows and MAX_UNLABELLED others, taken in the order of a hash of the id.

    held_in: Column on id_col that says which rows may be learnt from. The class prior is the share of 1 among
    the labels of those rows (0.1 without any). Without a positive the model scores everything 0.
    """
    spark = docs.sparkSession
    known = labels.filter(held_in & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    n, ones = known.agg(F.count(F.lit(1)), F.sum("y")).first()
    prior = min(0.9, max(0.005, (ones or 0) / n)) if n else 0.1
    positive = [r[0] for r in first_by_hash(known.filter("y = 1").select(id_col), MAX_POSITIVE, id_col)]
    if not positive:
        return Model({}, -30.0)
    unlabelled = [r[0] for r in first_by_hash(docs.filter(held_in & F.col(id_col).isNotNull()).select(id_col), MAX_UNLABELLED, id_col)]
    ids = spark.createDataFrame([(i, 1, 0) for i in positive] + [(i, 0, 1) for i in unlabelled], "i long, p int, u int").groupBy("i").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    y = (F.col("p") + 2 * F.col("u")).alias("y")  # 1 positive, 2 unlabelled, 3 both
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(ids), "i").select("i", y, "t")
    sample = sample.groupBy("t", "y").agg(F.min("i").alias("i")).select("i", "y", "t")  # copies of a text teach once
    rows = map_arrow(sample, _feature_rows, "i long, y int, f array<string>").persist()  # a lost part is made again
    n_p, n_u = rows.agg(F.sum((F.col("y") % 2).cast("long")), F.sum((F.col("y") >= 2).cast("long"))).first()
    if not n_p or not n_u:
        rows.unpersist()
        return Model({}, -30.0)
    counted = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum((F.col("y") % 2).cast("long")).alias("p"), F.sum((F.col("y") >= 2).cast("long")).alias("u"))
    p, u = F.col("p") / n_p, (F.col("u") + 0.5) / (n_u + 1)
    gain = F.col("p") * F.log(p / u) + (n_p - F.col("p")) * F.log((1 - p + 1e-9) / (1 - u + 1e-9))  # log-likelihood ratio
    told = counted.filter((F.col("p") >= LEAST) & (p >= LIFT * u) & (gain >= LEAST_GAIN))
    vocabulary = [r["f"] for r in told.orderBy(gain.desc(), "f").limit(MAX_FEATURES).collect()]
    index = spark.createDataFrame([(f, k) for k, f in enumerate(vocabulary)], "f string, k int")
    pairs = rows.select("i", "y", F.explode("f").alias("f")).join(F.broadcast(index), "f").groupBy("i", "y").agg(F.collect_list("k").alias("k"))
    found = pairs.collect()  # at most the sample's rows by the vocabulary
    rows.unpersist()
    none = [np.zeros(0, np.int64)]
    p = [np.array(sorted(r["k"])) for r in sorted(found, key=lambda r: (r["i"], r["y"])) if r["y"] % 2]
    u = [np.array(sorted(r["k"])) for r in sorted(found, key=lambda r: (r["i"], r["y"])) if r["y"] >= 2]
    p, u = p + none * (n_p - len(p)), u + none * (n_u - len(u))
    w, b = fit_nnpu(p, u, len(vocabulary), prior)
    return Model({f: float(x) for f, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-9}, b)


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, held_out (crc32 of the id mod 3 is 1), score, predicted (score >= 0.7).

    Labels count only where the id isn't held out. A null or empty text has no features and gets the score of
    the bias; a null id is scored, with held_out false. A document with several labels is toxic if one says so.
    Rows that repeat get equal scores. Empty tables: no rows, or without labels a score near 0 for all. Other columns
    are neither read nor returned.
    """
    model = train(docs, labels, id_remainder(id_col, 3) != 1, id_col, text_col)
    held = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    return score_texts(docs, model, id_col, text_col).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def filter_texts(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns, whose whole text scores below threshold."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return map_arrow(df, run, df.schema)
