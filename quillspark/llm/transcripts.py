"""Transcript parsing: a hidden Markov model over lines recovers roles by Viterbi, then turns are rendered anew.

A state is a role and whether the line begins a turn. Decoding is split: the lines of a transcript come in
blocks, each block's best scores between any entry and exit state form a matrix, the matrices compose in the
(max, +) semiring along the transcript, and each block is then decoded between the states found for it. So a
transcript of any length is decoded exactly, with no task holding more than a block of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches, materialize, sorted_groups, table

ROLES = ("assistant", "system", "user")
#: States: each role beginning a turn, then each role inside one.
N_STATES = 2 * len(ROLES)
CLOSE = "<|im_end|>\n"
#: Lines of a transcript that make one block.
BLOCK = 512
#: Blocks whose matrices one task composes; longer transcripts are composed in several levels.
FAN_OUT = 512
#: Speaker markers at the start of a line, by the role that they suggest.
MARKERS = {
    "user": ("user:", "human:", "q:", "### instruction:", "[user]", "<|user|>", "> "),
    "assistant": ("assistant:", "ai:", "a:", "### response:", "[assistant]", "<|assistant|>", "< "),
    "system": ("system:", "context:", "### system:", "[system]", "<|system|>", "* "),
}
_MARKER = re.compile("|".join(f"(?P<{role}>{'|'.join(re.escape(m) for m in ms)})" for role, ms in MARKERS.items()), re.IGNORECASE)
N_FEATURES = (4, 6, 2)  # marker, length, ends a sentence


def line_features(line: str) -> tuple[int, int, int]:
    m = _MARKER.match(line)
    marker = 1 + ROLES.index(m.lastgroup) if m else 0
    return marker, min(5, len(line).bit_length() // 2), int(line.rstrip()[-1:] in (".", "?", "!"))


def strip_marker(line: str) -> str:
    m = _MARKER.match(line)
    return line[m.end() :].lstrip(" ") if m else line


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # [state]
    step: np.ndarray  # [state, state]
    emit: tuple[np.ndarray, ...]  # for each feature [state, value]

    def scores(self, features: list[tuple[int, ...]]) -> np.ndarray:
        x = np.array(features, np.int64).reshape(len(features), len(self.emit))
        return sum(e[:, x[:, k]].T for k, e in enumerate(self.emit))

    def matrix(self, features: list[tuple[int, ...]]) -> np.ndarray:
        """[entry, exit]: the best score of the block's lines from each state before it to each at its end; last, from the start."""
        b = self.scores(features)
        m = np.vstack([self.step, self.start]) + b[0]
        for row in b[1:]:
            m = (m[:, :, None] + self.step[None]).max(axis=1) + row
        return m

    def decode(self, features: list[tuple[int, ...]], entry: int, exit_: int) -> list[int]:
        """The best states of the block's lines; entry -1 at a transcript's start; ties to the smaller state."""
        b = self.scores(features)
        v, back = (self.start if entry < 0 else self.step[entry]) + b[0], []
        for row in b[1:]:
            w = v[:, None] + self.step
            back.append(w.argmax(axis=0))
            v = w.max(axis=0) + row
        at, path = exit_, [exit_]
        for p in reversed(back):
            at = int(p[at])
            path.append(at)
        return path[::-1]


def _product(ms: list[np.ndarray]) -> np.ndarray:
    """The matrix of consecutive blocks together."""
    found = ms[0]
    for m in ms[1:]:
        found = (found[:, :, None] + m[None, :N_STATES]).max(axis=1)
    return found


def _exits(ms: list[np.ndarray], entry: int, exit_: int | None) -> list[int]:
    """The best state at the end of each of consecutive blocks, from entry (-1: the start) to exit_ (None: any)."""
    v, back = ms[0][entry], []
    for m in ms[1:]:
        w = v[:, None] + m[:N_STATES]
        back.append(w.argmax(axis=0))
        v = w.max(axis=0)
    found = [int(v.argmax()) if exit_ is None else exit_]
    for p in reversed(back):
        found.append(int(p[found[-1]]))
    return found[::-1]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, part), rows in sorted_groups(batches, 2):
        m = _product([np.array(x).reshape(N_STATES + 1, N_STATES) for x in rows.column("m").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["conv_id", "block", "m"])


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, _), rows in sorted_groups(batches, 2):
        ms = [np.array(x).reshape(N_STATES + 1, N_STATES) for x in rows.column("m").to_pylist()]
        entry, exit_, last = (rows.column(c)[0].as_py() for c in ("entry", "exit", "last"))
        exits, n = _exits(ms, entry, exit_), len(ms)
        columns = [conv] * n, rows.column("block").to_pylist(), [entry, *exits[:-1]], exits, [last and k == n - 1 for k in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["conv_id", "block", "entry", "exit", "last"])


def block_states(matrices: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """The states around each block on its transcript's best path: (conv_id, block, m) -> conv_id, block, entry, exit, last.

    Runs of blocks are composed into a matrix each, and these again, until no transcript has more than `fan_out`;
    then states are found from the top down. No task holds more than `fan_out` matrices of a transcript.
    """

    def sorted_parts(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "block")

    part = F.floor(F.col("block") / fan_out).alias("part")
    levels = [materialize(matrices, "matrices")]
    while (levels[-1].groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > fan_out:
        levels.append(materialize(sorted_parts(levels[-1].select("conv_id", part, "block", "m")).mapInArrow(_compose, "conv_id long, block long, m array<double>"), "matrices"))
    found = levels[-1].select("conv_id", F.lit(0).cast("long").alias("part"), "block", "m", F.lit(-1).alias("entry"), F.lit(None).cast("int").alias("exit"), F.lit(True).alias("last"))
    for below in [*reversed(levels[:-1]), None]:
        states = materialize(sorted_parts(found).mapInArrow(_descend, "conv_id long, block long, entry int, exit int, last boolean"), "states")
        if below is not None:
            found = below.select("conv_id", part, "block", "m").join(states.withColumnRenamed("block", "part"), ["conv_id", "part"])
    return states


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[str], list[tuple], pa.Table]]:
    """conv_id, block, lines, their features and all columns of each block of sorted lines."""
    for (conv, block), rows in sorted_groups(batches, 2):
        lines = rows.column("line").to_pylist()
        yield conv, block, lines, [line_features(x) for x in lines], rows


def _arranged(lines: DataFrame) -> DataFrame:
    return lines.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "n")


def fit(lines: DataFrame) -> Model:
    """Maximum likelihood with add-one smoothing from all lines with a true role: lines(conv_id, block, n, line_no, line, role); transcripts begin in block 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        for _, block, _, features, rows in _blocks(batches):
            before = -1 if block == 0 else None
            for f, role, n in zip(features, rows.column("role").to_pylist(), rows.column("line_no").to_pylist(), strict=True):
                state = ROLES.index(role) + len(ROLES) * (n > 0) if role in ROLES else None
                if state is not None:
                    if before is not None:
                        seen[-1, before, state] = seen.get((-1, before, state), 0) + 1
                    for k, x in enumerate(f):
                        seen[k, state, x] = seen.get((k, state, x), 0) + 1
                before = state
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in keys], pa.int32()) for k in range(3)] + [pa.array([seen[x] for x in keys], pa.int64())], ["kind", "a", "b", "n"])

    step, start = np.ones((N_STATES, N_STATES)), np.ones(N_STATES)
    emit = [np.ones((N_STATES, n)) for n in N_FEATURES]
    counted = _arranged(lines).mapInArrow(count, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # states by states and values at most
        if r["kind"] >= 0:
            emit[r["kind"]][r["a"], r["b"]] += r["n"]
        elif r["a"] < 0:
            start[r["b"]] += r["n"]
        else:
            step[r["a"], r["b"]] += r["n"]
    state = F.expr("CASE role " + " ".join(f"WHEN '{r}' THEN {k}" for k, r in enumerate(ROLES)) + f" END + IF(line_no > 0, {len(ROLES)}, 0)")
    ends = lines.filter(F.col("n") % BLOCK == BLOCK - 1).select("conv_id", (F.col("block") + 1).alias("block"), state.alias("a"))
    begins = lines.filter((F.col("n") % BLOCK == 0) & (F.col("block") > 0)).select("conv_id", "block", state.alias("b"))
    for r in ends.join(begins, ["conv_id", "block"]).dropna().groupBy("a", "b").count().collect():  # from one block to the next
        step[r["a"], r["b"]] += r["count"]
    never = -1e6  # a line inside a turn follows only a line of the same role's turn
    start, step = np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True))
    n = len(ROLES)
    start[n:] = never
    for s in range(N_STATES):
        for r in range(n):
            if s % n != r:
                step[s, n + r] = never
    return Model(start, step, tuple(np.log(e / e.sum(axis=1, keepdims=True)) for e in emit))


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """Turns of transcripts given as lines(conv_id, block, n, line_no, line): conv_id, block, seq, role, continues, n_lines, turn.

    `turn` is canonical: <|im_start|>role, the lines without markers, <|im_end|>. Of a turn that goes on in a
    later block each block holds its part (`continues`), and the block after a turn's end closes it; the parts
    of a transcript in the order of (block, seq), joined, are the whole canonical transcript.
    """

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, block, _, features, _ in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([block], pa.int64()), pa.array([model.matrix(features).ravel().tolist()], pa.list_(pa.float64()))], ["conv_id", "block", "m"])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, block, texts, features, rows in _blocks(batches):
            entry, exit_, last = (rows.column(c)[0].as_py() for c in ("entry", "exit", "last"))
            states = model.decode(features, entry, exit_)
            starts = [k for k, s in enumerate(states) if s < len(ROLES) or k == 0]
            out = []
            for seq, (a, b) in enumerate(zip(starts, [*starts[1:], len(states)], strict=True)):
                role, continues = ROLES[states[a] % len(ROLES)], states[a] >= len(ROLES)
                head = "" if continues else CLOSE * (seq == 0 and entry >= 0) + f"<|im_start|>{role}\n"
                body = [strip_marker(x) if k == 0 and not continues else x for k, x in enumerate(texts[a:b])]
                out.append((conv, block, seq, role, continues, b - a, head + "\n".join(body) + "\n" + CLOSE * (b < len(states) or last)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.string()), strict=True)], ["conv_id", "block", "seq", "role", "continues", "n_lines", "turn"])

    lines = lines.select("conv_id", "block", "n", "line_no", "line")
    found = _arranged(lines).mapInArrow(matrices, "conv_id long, block long, m array<double>")
    return _arranged(lines.join(block_states(found), ["conv_id", "block"])).mapInArrow(turns, "conv_id long, block long, seq int, role string, continues boolean, n_lines long, turn string")


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of conversations(conv_id, turn, role, text): lines whose speakers are told only by markers.

    A conversation's hash chooses its style of markers; one turn in eight, by its hash, has none. A null text
    is an empty line, a turn without a number is taken as turn 0, a null conversation as number -1.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6)).cast("int")
    marker: Column = F.lit("")
    for role, ms in MARKERS.items():
        marker = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, ms[:6])), style + 1)).otherwise(marker)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    text = F.concat(F.when(bare | F.col("role").isNull(), "").otherwise(F.concat(marker, F.lit(" "))), F.coalesce("text", F.lit("")))
    pos = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    turns = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("conv_id"), pos.alias("pos"), F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("copy"), "role", text.alias("text"))
    return numbered(turns.select("conv_id", "pos", "tie", "copy", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "line")))


def numbered(lines: DataFrame) -> DataFrame:
    """conv_id, block, n, pos, line_no, line, role of lines(conv_id, pos, tie, copy, line_no, line, role): each line's place n in its transcript and its block.

    Lines are split by ranges of (conv_id, pos, tie, copy, line_no), so that a transcript of any length lies in as
    many parts as it needs, also where all its turns have one number; places within parts move by the lines before.
    """
    order = ["conv_id", "pos", "tie", "copy", "line_no"]
    split = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(split.select("conv_id", F.monotonically_increasing_id().alias("at"), "pos", "line_no", "line", "role"), "lines")  # part << 33 | place in it
    part = F.shiftright("at", 33).alias("part")
    parts = placed.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select("conv_id", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("move"))
    n = (F.col("at") + F.col("move")).alias("n")
    found = placed.withColumn("part", F.shiftright("at", 33)).join(moved, ["conv_id", "part"]).select("conv_id", n, "pos", "line_no", "line", "role")
    return materialize(found.select("conv_id", F.floor(F.col("n") / BLOCK).alias("block"), "n", "pos", "line_no", "line", "role"), "numbered")


def recover(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of all conversations, their roles recovered: parse()'s columns and held_out (crc32 of the id mod 3 is 1).

    Roles are learnt only where the conversation isn't held out, and only lines and their order are read in
    decoding. Turns that repeat a number come in the order of a hash, each with its lines together; rows that
    repeat are turns of their own. A null text is an empty line, a turn without a number is taken as turn 0, rows
    without a conversation are one of number -1. A null role, or one that isn't system, user or assistant, is
    not learnt from, and its turn is read as one of these three. Lines may be of any length: a task holds a
    block of them, 512 lines, at a time. An empty table gives no rows; columns other than conv_id, turn, role and
    text, whatever their names, are neither read nor returned.
    """
    bound_batches(conversations.sparkSession)
    lines = transcript_lines(conversations)
    held = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(3)) == 1
    model = fit(lines.filter(~held))
    return parse(lines, model).withColumn("held_out", held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover(table(spark, sf_dir, "conversations"))
