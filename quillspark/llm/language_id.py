"""Language identification by cross-parsing entropy: the fewest phrases of a language's text that spell a document."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quillspark.llm.common import by_size, id_remainder, map_arrow, materialize, table

#: Bounds of the sample that is learnt from: texts a language, characters a language, and characters of all
#: languages together, which they share evenly; so the model has a bound that doesn't depend on their number.
MAX_ROWS, MAX_CHARS, ALL_CHARS = 64, 40_000, 1_600_000
#: The least that a text gives, if it is that long.
LEAST_SLICE = 200
#: Parts of a language's rows whose first rows are found apart.
PARTS = 256
#: Long texts are parsed in blocks of this many characters side by side; where a block begins in the parse of its
#: text is guessed by reading so many characters before it, and parsed again where the guess was wrong.
BLOCK, BEFORE = 1024, 64
#: Characters that are parsed side by side.
PARSED_TOGETHER = 4_000_000
#: A text whose phrases have fewer characters than this on average is in no language that was learnt.
LEAST_PHRASE = 2.0
UNKNOWN = "und"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state, symbol -> state, of the automaton of all substrings; state 0 is the first."""
    n = 2 * len(symbols) + 1
    nxt: list[dict[int, int]] = [{} for _ in range(n)]
    link, length = [-1] * n, [0] * n
    last, used = 0, 1
    for c in symbols:
        cur, used = used, used + 1
        length[cur] = length[last] + 1
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone, used = used, used + 1
                length[clone], link[clone] = length[p] + 1, link[q]
                nxt[clone] = dict(nxt[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt[:used]


@dataclass(frozen=True)
class Machine:
    """An automaton as a double array. A state is a place; its transition by symbol c lies at place + c, if `owner` there is the place.

    `first` leads from the first state, which owns nothing, so each step from it is a miss: a phrase begins.
    `chars` is the length of the text.
    """

    owner: np.ndarray
    to: np.ndarray
    first: np.ndarray
    chars: int


def double_array(nxt: list[dict[int, int]], width: int, chars: int) -> Machine:
    """Places for states such that no two share one and no two transitions share a slot; symbols are 1 to width - 1."""
    size = 2 * sum(map(len, nxt)) + 4 * width + len(nxt) + 64
    free, taken = np.ones(size, bool), np.zeros(size, bool)
    place = np.zeros(len(nxt), np.int64)
    free[:width], taken[0] = False, True  # place 0 is the first state's
    many = sorted((s for s in range(1, len(nxt)) if len(nxt[s]) > 1), key=lambda s: -len(nxt[s]))
    start, window = 1, 2048
    for s in many:
        symbols = sorted(nxt[s])
        at = start
        while True:
            end = min(at + window, size - width)
            fits = ~taken[at:end]
            for c in symbols:
                fits &= free[at + c : end + c]
            if fits.any():
                break
            if end == size - width:  # never so in practice: grow
                free, taken, size = np.append(free, np.ones(size, bool)), np.append(taken, np.zeros(size, bool)), 2 * size
            at = end
        found = at + int(fits.argmax())
        if found > start + window // 2:
            start += window // 4
        place[s], taken[found] = found, True
        free[[found + c for c in symbols]] = False
    by_symbol: dict[int, list[int]] = {}
    for s in range(1, len(nxt)):
        if len(nxt[s]) == 1:
            by_symbol.setdefault(next(iter(nxt[s])), []).append(s)
    for c, states in by_symbol.items():
        while True:
            slots = np.flatnonzero(free)
            slots = slots[slots > c]
            slots = slots[~taken[slots - c]][: len(states)]
            if len(slots) == len(states):
                break
            free, taken, size = np.append(free, np.ones(size, bool)), np.append(taken, np.zeros(size, bool)), 2 * size
        free[slots], taken[slots - c] = False, True
        place[states] = slots - c
    last = int(np.flatnonzero(~taken)[0])
    place[[s for s in range(1, len(nxt)) if not nxt[s]]] = last  # the whole text's state, which has no transition
    top = int(max(np.flatnonzero(~free)[-1], place.max())) + width + 1
    owner, to = np.zeros(top, np.int32) - 1, np.zeros(top, np.int32)
    for s in range(1, len(nxt)):
        for c, t in nxt[s].items():
            owner[place[s] + c], to[place[s] + c] = place[s], place[t]
    first = np.zeros(width, np.int32)
    for c, t in nxt[0].items():
        first[c] = place[t]
    return Machine(owner, to, first, chars)


class CrossParser:
    """Counts phrases of whole texts against each language's automaton, all blocks of a batch side by side."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        alphabet = [c for c, _ in Counter("".join(texts.values())).most_common()]
        self.code = np.zeros(0x110000, np.uint16 if len(alphabet) < 65_535 else np.int32)  # 0: a character that no language has
        self.code[[ord(c) for c in alphabet]] = range(1, len(alphabet) + 1)
        symbol = {c: k for k, c in enumerate(alphabet, 1)}
        self.machines = [double_array(suffix_automaton([symbol[c] for c in texts[lang]]), len(alphabet) + 1, len(texts[lang])) for lang in self.languages]

    def _parse(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in each block, [language, block], and the states after it, given those before it."""
        order = np.argsort(-sizes, kind="stable")
        begins, sizes, states = begins[order], sizes[order], entry[:, order].copy()
        counts = np.zeros(states.shape, np.int32)
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # blocks longer than t
        for t in range(longest):
            n = int(alive[t])
            symbol = flat[begins[:n] + t]
            for k, m in enumerate(self.machines):
                now = states[k, :n]
                at = now + symbol
                miss = m.owner[at] != now
                counts[k, :n] += miss
                states[k, :n] = np.where(miss, m.first[symbol], m.to[at])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return counts[:, back], states[:, back]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """[text, language]: phrases of the greedy parse of each whole text; a character that the language lacks is a phrase."""
        lengths = np.array([len(t) for t in texts], np.int64)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        n = len(owner)
        if not n:
            return np.zeros((len(texts), len(self.languages)))
        flat = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        begins = np.repeat(np.cumsum(lengths) - lengths, blocks) + (np.arange(n) - np.repeat(first, blocks)) * BLOCK
        sizes = np.minimum(BLOCK, np.repeat(np.cumsum(lengths), blocks) - begins)
        inner = np.flatnonzero(np.append(False, owner[1:] == owner[:-1]))
        entry = np.zeros((len(self.languages), n), np.int32)
        _, entry[:, inner] = self._parse(flat, begins[inner] - BEFORE, np.full(len(inner), BEFORE), entry[:, inner])
        counts, after = self._parse(flat, begins, sizes, entry)
        while len(wrong := inner[(entry[:, inner] != after[:, inner - 1]).any(axis=0)]):
            entry[:, wrong] = after[:, wrong - 1]
            counts[:, wrong], after[:, wrong] = self._parse(flat, begins[wrong], sizes[wrong], entry[:, wrong])
        return np.stack([np.bincount(owner, c, len(texts)) for c in counts], axis=1)

    def costs(self, phrases: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entropy that the parse estimates: phrases a character times the bits that name a place in the language's text."""
        bits = np.array([math.log2(max(2, m.chars)) for m in self.machines])
        return phrases * bits / np.maximum(lengths, 1)[:, None]


def has_letter(text: str) -> bool:
    return any(ch.isalpha() for ch in text)


def first_rows(ids: DataFrame, limit: int | None = None) -> list[Row]:
    """ids(lang, i, h) -> lang, i, h, n: the first `limit` rows of each language by a hash of the id, repeated rows once.

    Without a limit, MAX_ROWS, or a language's share of the characters if that is less. Only the rows of a
    language's lowest hashes meet, about four times as many as asked for. Where repeats leave fewer than
    asked for, the first of all its rows are found in parts.
    """
    order = [F.xxhash64("i"), F.col("i"), F.col("h")]
    counts = dict(ids.groupBy("lang").count().collect())
    most = limit or max(1, min(MAX_ROWS, ALL_CHARS // LEAST_SLICE // max(1, len(counts))))
    bounds = [(lang, min((4 * most << 64) // n - (1 << 63), (1 << 63) - 1)) for lang, n in counts.items()]
    bound = ids.sparkSession.createDataFrame(bounds, StructType([ids.schema["lang"], StructField("bound", LongType())]))

    def first(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= most)

    low = ids.join(F.broadcast(bound), "lang").filter(F.xxhash64("i") <= F.col("bound")).drop("bound")
    found = first(low.distinct(), "lang").collect()
    got = Counter(r["lang"] for r in found)
    few = [lang for lang, n in counts.items() if got[lang] < min(n, most)]
    if few:
        parts = ids.filter(F.col("lang").isin(few)).distinct().withColumn("part", F.pmod(F.col("h"), F.lit(PARTS)))
        found = [r for r in found if r["lang"] not in few] + first(first(parts, "lang", "part").drop("part", "n"), "lang").collect()
    return found


def fit(df: DataFrame, held_in, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> CrossParser | None:
    """Automata from at most MAX_ROWS different texts a language, the first by a hash of their least id; None if no row has a language and a letter.

    Each text gives a slice at a place that its hash names, so that openings that many texts share don't
    stand for a language.
    """
    rows = df.filter(held_in & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    ids = materialize(rows.groupBy("lang", F.xxhash64("t").alias("h")).agg(F.min("i").alias("i")).select("lang", "i", "h"), "texts")  # copies of a text take one place
    found = first_rows(ids)
    texts_of = Counter(r["lang"] for r in found)
    chars = min(MAX_CHARS, ALL_CHARS // max(1, len(texts_of)))
    pick = df.sparkSession.createDataFrame([(*r, max(LEAST_SLICE, chars // texts_of[r["lang"]])) for r in found], StructType([*ids.schema, StructField("n", IntegerType()), StructField("each", IntegerType())]))
    chosen = rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(pick), ["lang", "i", "h"])
    place = F.pmod("h", F.greatest(F.length("t") - F.col("each") + 1, F.lit(1))).cast("int") + 1
    by: dict[str, list[str]] = {}
    for r in chosen.groupBy("lang", "n").agg(F.min(F.lower(F.substring("t", place, F.col("each")))).alias("t")).orderBy("lang", "n").collect():
        if has_letter(r["t"]):
            by.setdefault(r["lang"], []).append(r["t"])
    return CrossParser({lang: "\n".join(found) for lang, found in by.items()}) if by else None


def languages(parser: CrossParser | None, texts: list[str]) -> list[tuple[str, float, bool]]:
    """The language of each whole text, how far the runner-up lies behind, 0 to 1, and whether it can be one of those learnt.

    A text can't be if its phrases but the last have fewer than LEAST_PHRASE characters on average, as in
    an alphabet that wasn't learnt from.
    """
    out = [(UNKNOWN, 0.0, False)] * len(texts)
    at = [k for k, t in enumerate(texts) if has_letter(t)]
    if parser is None:
        for k in at:
            out[k] = UNKNOWN, 0.0, True  # nothing was learnt, so nothing is foreign
        return out
    for some in by_size([texts[k] for k in at], PARSED_TOGETHER):
        lowered = [texts[k].lower() for k in at[some]]
        lengths = np.array([len(t) for t in lowered])
        phrases = parser.phrases(lowered)
        costs = parser.costs(phrases, lengths)
        for k, c, n, p, size in zip(at[some], costs, costs.argmin(axis=1).tolist(), phrases, lengths.tolist(), strict=True):
            others = np.delete(c, n)
            out[k] = parser.languages[n], float(min(1.0, 1 - c[n] / others.min())) if len(others) else 1.0, bool((p.min() - 1) * LEAST_PHRASE <= size)
    return out


def predict(df: DataFrame, parser: CrossParser | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(parser)  # bounded by ALL_CHARS: some 30 bytes a character

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = languages(shared.value, [t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), run, "doc_id long, lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out (crc32 of the id mod 4 is 2), lang_pred, score.

    Learns from rows that aren't held out and have a language. `und` with score 0 where the text is null or
    has no letter, or nothing could be learnt; ties go to the language first by name. A null id is never held
    out; repeated rows get equal answers; an empty table gives no rows; other columns of df are neither read
    nor returned.
    """
    parser = fit(df, id_remainder(id_col, 4) != 2, lang_col, id_col, text_col)
    held = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    return predict(df, parser, id_col, text_col).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def filter_texts(df: DataFrame, parser: CrossParser | None, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose whole text has a letter and can be in a language that was learnt; any letter will do if none was."""
    at, shared = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = languages(shared.value, [t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array([fine for _, _, fine in found], pa.bool_()))

    return map_arrow(df, run, df.schema)
