"""Chat transcripts: a hidden Markov model finds who speaks in each line, then turns are rendered in one form.

A transcript is a table of lines in order. States are role x (first line of a turn, further line). A
line emits one of a few symbols: the kind of speaker marker it begins with, whether it asks, whether it is
blank or short, and how it opens; features are independent given the state. Parameters are counts over
transcripts whose roles are known, smoothed. Decoding is Viterbi over blocks of lines: each block is a
max-plus matrix, a conversation's matrices are chained to find the states at block borders, and every block is
traced back on its own, so one conversation may have any number of lines.

Defined cases: lines with a null id form one transcript; a null line is blank; equal positions are ordered by the line;
an empty transcript table gives an empty result; without training lines all counts are equal and markers that name a role still
decide; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from citegraph.functions.ranking import order_rows
from citegraph.functions.scans import previous_row, running_sum
from citegraph.session import cut_lineage

ROLES = ("user", "assistant", "system")
#: State 2r is the first line of a turn of role r, 2r + 1 a further line of it.
STATES = 2 * len(ROLES)
BLOCK = 512
#: Names that mark a speaker, by role.
NAMES = {
    "user": ("user", "human", "question", "q", "client", "customer", "instruction", "prompt", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "response", "model", "agent", "gpt", "support"),
    "system": ("system", "sys", "context", "note", "developer"),
}
_OPEN, _CLOSE = r"^\s*(?:[#>*-]+\s*|<\|?(?:im_start\|>)?|\[)?", r"\s*(?:\|?>|\]\s*:?|\*\*:?|:)\s*"
#: Symbols of each feature.
SIZES = {"marker": len(ROLES) + 2, "asks": 2, "length": 4, "opens": 3}


def _named(role: str) -> str:
    return f"(?i){_OPEN}(?:{'|'.join(NAMES[role])}){_CLOSE}"


MARKER = f"(?i){_OPEN}(?:{'|'.join(n for r in ROLES for n in NAMES[r])}){_CLOSE}"


def features(line: Column) -> dict[str, Column]:
    marker = F.lit(0)
    for k, role in enumerate(ROLES):
        marker = F.when(line.rlike(_named(role)), k + 1).otherwise(marker)
    other = line.rlike(r"^\s*[\p{L}][\p{L} ]{0,20}:\s")
    marker = F.when((marker == 0) & other, len(ROLES) + 1).otherwise(marker)
    n = F.length(F.trim(line))
    opening = F.regexp_extract(line, r"^\s*(\S)", 1)
    return {
        "marker": marker,
        "asks": line.rlike(r"\?\s*$").cast("int"),
        "length": F.when(n == 0, 0).when(n < 40, 1).when(n < 200, 2).otherwise(3),
        "opens": F.when(opening.rlike(r"\p{Lu}"), 1).when(opening.rlike(r"[-*0-9•]"), 2).otherwise(0),
    }


def symbol(line: Column) -> Column:
    """All features of a line as one number."""
    out = F.lit(0)
    for name, column in features(line).items():
        out = out * SIZES[name] + column
    return out.cast("int")


def _parts(code: int) -> list[int]:
    out = []
    for size in reversed(SIZES.values()):
        out.append(code % size)
        code //= size
    return out[::-1]


def numbered(lines: DataFrame, conv: str, position: str, line: str, *more: str) -> DataFrame:
    """(conv, at, line, code, ...): lines numbered from 0 within their transcript; `conv` is the id as text, '' for null."""
    key = F.coalesce(F.concat(F.lit("#"), F.col(conv).cast("string")), F.lit("")).alias("conv")
    plain = lines.select(key, F.coalesce(F.col(position).cast("long"), F.lit(-1)).alias("position"), F.coalesce(F.col(line).cast("string"), F.lit("")).alias("line"), *more)
    order = ["position", F.xxhash64("line")]
    out = order_rows(plain, ["conv"], order, "at").withColumn("at", F.col("at").cast("long") - 1)
    return cut_lineage(out.withColumn("code", symbol(F.col("line"))))


@dataclass
class Chain:
    """Log-probabilities: where a transcript starts, state to state, and symbol given state."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    def viterbi(self, codes: np.ndarray, entry: int, leave: int) -> np.ndarray:
        """The best states of a block, given the state before it (-1 at the start) and its last state (-1: free)."""
        best = (self.start if entry < 0 else self.step[entry]) + self.emit[:, codes[0]]
        back = []
        for c in codes[1:]:
            way = best[:, None] + self.step
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + self.emit[:, c]
        states = [int(best.argmax()) if leave < 0 else leave]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return np.array(states[::-1], np.int8)

    def matrix(self, codes: np.ndarray, first: bool) -> np.ndarray:
        """(STATES, STATES): the best score from the state before the block (any, in a first block) to its last state."""
        m = (np.tile(self.start, (STATES, 1)) if first else self.step) + self.emit[:, codes[0]][None]
        for c in codes[1:]:
            m = (m[:, :, None] + self.step[None]).max(axis=1) + self.emit[:, c][None]
        return m


def fit(lines: DataFrame, smooth: float = 0.5) -> Chain:
    """Counts over (conv, at, code, state) lines; all sums are made in Spark, over all lines given."""
    step = np.full((STATES, STATES), smooth)
    start = np.full(STATES, smooth)
    for k in range(STATES):
        if k % 2:
            start[k] = 1e-12
            step[:, k] = 1e-12
            step[k - 1, k] = step[k, k] = smooth
    before = previous_row(lines, "conv", "at", ["state"])
    for row in before.groupBy("prev_state", "state").count().collect():  # at most 7 x 6 rows
        if row["prev_state"] is None:
            start[row["state"]] += row["count"]
        else:
            step[row["prev_state"], row["state"]] += row["count"]
    counts = {name: np.full((STATES, size), smooth) for name, size in SIZES.items()}
    for k, role in enumerate(ROLES):  # a marker speaks for its role even where none was seen
        counts["marker"][2 * k, k + 1] += 10 * smooth
    codes = int(np.prod(list(SIZES.values())))
    for row in lines.groupBy("state", "code").count().collect():  # at most 6 x 120 rows
        for name, part in zip(SIZES, _parts(row["code"])):
            counts[name][row["state"], part] += row["count"]
    emit = np.zeros((STATES, codes))
    for code in range(codes):
        for name, part in zip(SIZES, _parts(code)):
            emit[:, code] += np.log(counts[name][:, part] / counts[name].sum(axis=1))
    return Chain(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), emit)


def decode(lines: DataFrame, chain: Chain) -> DataFrame:
    """(conv, at, state) of numbered lines."""
    rows = lines.select("conv", F.floor(F.col("at") / BLOCK).alias("block"), "at", "code")
    # At most BLOCK lines meet in a row.
    blocks = cut_lineage(rows.groupBy("conv", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [chain.matrix(np.asarray(c), b == 0).reshape(-1) for c, b in zip(batch.column("codes").to_pylist(), batch.column("block").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(m, pa.list_(pa.float64()))], ["conv", "block", "m"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entry and last state of each block of a conversation; one row of 36 numbers stands for BLOCK lines."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for conv, listed in zip(batch.column("conv").to_pylist(), batch.column("blocks").to_pylist()):
                ms = [np.array(x["m"]).reshape(STATES, STATES) for x in listed]
                best, ways = np.zeros(STATES), []
                for m in ms:
                    ways.append(best[:, None] + m)
                    best = ways[-1].max(axis=0)
                ends = [int(best.argmax())]
                for way in reversed(ways[1:]):
                    ends.append(int(way[:, ends[-1]].argmax()))
                ends.reverse()
                for k, x in enumerate(listed):
                    for column, value in zip(out, (conv, x["block"], ends[k - 1] if k else -1, ends[k])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(c, pa.int64()) for c in out[1:]]], ["conv", "block", "entry", "leave"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("codes", "entry", "leave")]
            states = [chain.viterbi(np.asarray(c), e, x) for c, e, x in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(states, pa.list_(pa.int8()))], ["conv", "block", "states"])

    several = blocks.where("block > 0").select("conv").distinct()
    long = blocks.join(several, "conv", "left_semi").mapInArrow(summed, "conv string, block long, m array<double>")
    ends = long.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("blocks")).mapInArrow(chained, "conv string, block long, entry long, leave long")
    ready = blocks.join(ends, ["conv", "block"], "left").select("conv", "block", "codes", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce("leave", F.lit(-1)).alias("leave"))
    states = ready.mapInArrow(traced, "conv string, block long, states array<tinyint>")
    out = states.select("conv", "block", F.posexplode("states").alias("i", "state"))
    return out.select("conv", (F.col("block") * BLOCK + F.col("i")).alias("at"), F.col("state").cast("int").alias("state"))


def turns(lines: DataFrame, chain: Chain) -> DataFrame:
    """(conv, turn, role, text, rendered) of numbered lines: markers are taken off, lines of a turn joined."""
    states = cut_lineage(lines.select("conv", "at", "line").join(decode(lines, chain), ["conv", "at"]))
    counted = running_sum(states, "conv", "at", F.when(F.col("state") % 2 == 0, 1).otherwise(0), "turn")
    bare = F.when(F.col("state") % 2 == 0, F.regexp_replace("line", MARKER, "")).otherwise(F.col("line"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / 2) + 1).cast("int"))
    grouped = counted.select("conv", F.col("turn"), role.alias("role"), "at", bare.alias("bare")).groupBy("conv", "turn").agg(
        F.first("role").alias("role"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "bare"))), lambda x: x["bare"]), "\n").alias("text")
    )
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return grouped.select("conv", (F.col("turn") - 1).alias("turn"), "role", text.alias("text")).withColumn(
        "rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    )


# ── conversations as raw transcripts ─────────────────────────────────────────

#: Marker styles of raw transcripts: (user, assistant, system).
STYLES = (("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Note: "), ("Q: ", "A: ", "Context: "), ("### Instruction:\n", "### Response:\n", "### System:\n"), ("[user] ", "[bot] ", "[system] "), ("<|user|>\n", "<|assistant|>\n", "<|system|>\n"))


def raw_lines(conversations: DataFrame) -> DataFrame:
    """Lines of transcripts written from turns (conv_id, turn, role, text), with the true role.

    Each conversation has a style of markers by its id; one turn in six has lost its marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    lost = F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(6)) == 0
    marker = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(ROLES, names):
            marker = F.when((style == k) & (F.col("role") == role) & ~lost, F.lit(name)).otherwise(marker)
    whole = F.concat(marker, F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role")).alias("role"), F.posexplode(F.split(whole, "\n")).alias("i", "line"))
    return rows.select("conv_id", (F.coalesce("turn", F.lit(0)) * (1 << 24) + F.col("i")).alias("position"), "line", "role", F.col("i").cast("long").alias("i"))


def parse_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered): transcripts of all conversations, learnt from and parsed.

    The chain is fitted on conversations whose crc32 of the id, modulo 4, is not 2.
    """
    lines = numbered(raw_lines(conversations), "conv_id", "position", "line", "role", "i")
    state = sum((F.when(F.col("role") == r, 2 * k).otherwise(0) for k, r in enumerate(ROLES)), F.lit(0)) + F.when(F.col("i") > 0, 1).otherwise(0)
    learn = (F.crc32(F.substring("conv", 2, 1 << 30).cast("binary")) % 4 != 2) & F.col("role").isin(*ROLES)
    chain = fit(cut_lineage(lines.where(learn).select("conv", "at", "code", state.cast("int").alias("state"))))
    out = turns(lines, chain)
    return out.select(F.substring("conv", 2, 1 << 30).try_cast("long").alias("conv_id"), "turn", "role", "text", "rendered")
