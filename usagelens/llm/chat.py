"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is lines; its hidden states are a role's first or further line. A line shows a speaker marker (a
class of names before a colon, or none), whether a blank line goes before it, whether it ends as a question,
and its length. Start, transition and emission rates are smoothed counts over labelled conversations, gathered
by group-bys of bounded size. Viterbi finds the best state sequence; runs that begin with a first-line state
are turns, rendered as ``<|role|>``, text, ``<|end|>``.

A transcript comes as numbered lines, and nothing but its lines tells where a turn begins. One of any length is decoded in blocks of ``BLOCK``
numbers: each block's best-path matrix between entry and exit states is found apart, the small matrices are chained per transcript, and each block
is decoded between its known ends. So no task holds a transcript as a whole, and the result is that of one pass.

A line decoded as a further one stays as it is; of a turn's first line only the marker goes. Blank lines inside a turn stay, those at its end
part it from the next one and go. A turn that goes on over a block's end comes in a row for each block, the later ones marked ``continues``.

Defined cases: null or empty lines are blank, and a transcript of blank lines has no turns; null ids are one
transcript; lines of equal number follow in the order of their text. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.common import lean, table

ROLES = ["system", "user", "assistant"]
#: Names before a colon, by role.
MARKERS = {"system": ["system", "instructions"], "user": ["user", "human", "q"], "assistant": ["assistant", "ai", "a"]}
BLOCK = 512 << 32  # numbers: those of 512 turns of ``raw_lines``
STATES = 2 * len(ROLES)  # role r: first line 2r, further line 2r + 1
_MARK = re.compile(r"^\s*(?:#+\s*|\*\*|<\|?)?([A-Za-z]{1,12})(?:\|?>|\*\*)?\s*:\s?")
_CLASS = {name: i for i, r in enumerate(ROLES) for name in MARKERS[r]}
NONE = len(ROLES)
LENGTHS = (20, 80, 200)


def marker(line: str) -> tuple[int, str]:
    """The marker's class (or NONE) and the line without it."""
    m = _MARK.match(line)
    c = _CLASS.get(m[1].lower(), NONE) if m else NONE
    return (c, line[m.end() :]) if c != NONE else (NONE, line)


def observed(lines: list[str]) -> tuple[list[tuple[str, str]], np.ndarray]:
    """The lines that aren't blank, as they are and without markers, and for each: marker, blank before, question, length class."""
    out, seen, blank = [], [], False
    for line in lines:
        if not line.strip():
            blank = True
            continue
        c, rest = marker(line)
        seen.append((c, int(blank), int(rest.rstrip().endswith("?")), sum(len(rest) > x for x in LENGTHS)))
        out.append((line, rest))
        blank = False
    return out, np.array(seen, np.int64).reshape(-1, 4)


WIDTHS = (NONE + 1, 2, 2, len(LENGTHS) + 1)
#: Counts that a transition, an emission and a start have before training: what was never seen, as one user turn after another, may still be told by its marker.
PRIOR_FOLLOW, PRIOR_EMIT, PRIOR_START = 0.5, 0.5, 1.0


class Model:
    """Log rates from counts; with no counts all are even."""

    def __init__(self, start: np.ndarray, follow: np.ndarray, emitted: list[np.ndarray]):
        first = np.full(STATES, 1e-6)
        first[::2] = start + PRIOR_START
        self.start = np.log(first / first.sum())
        self.follow = np.log((follow + PRIOR_FOLLOW) / (follow + PRIOR_FOLLOW).sum(1, keepdims=True))
        self.emitted = [np.log((e + PRIOR_EMIT) / (e + PRIOR_EMIT).sum(1, keepdims=True)) for e in emitted]

    def emissions(self, seen: np.ndarray) -> np.ndarray:
        return sum(e[:, seen[:, i]].T for i, e in enumerate(self.emitted))

    def matrix(self, seen: np.ndarray) -> np.ndarray:
        """Best log rate from each state before the lines to each state at their end."""
        best = np.where(np.eye(STATES) > 0, 0.0, -np.inf)
        for e in self.emissions(seen):
            best = (best[:, :, None] + self.follow[None]).max(1) + e
        return best

    def path(self, seen: np.ndarray, before: int | None, end: int | None) -> list[int]:
        """The best states of the lines after state ``before`` (None: at the start) that end in ``end`` (None: any)."""
        e = self.emissions(seen)
        v = (self.start if before is None else self.follow[before]) + e[0]
        back = []
        for x in e[1:]:
            m = v[:, None] + self.follow
            back.append(m.argmax(0))
            v = m.max(0) + x
        s = int(v.argmax()) if end is None else end
        out = [s]
        for b in back[::-1]:
            out.append(int(b[out[-1]]))
        return out[::-1]

    def ends(self, first: np.ndarray, blocks: list[np.ndarray]) -> list[int]:
        """Exit state of each block; ``first``: best rates at the end of the first, ``blocks``: matrices of the others."""
        v, back = first, []
        for m in blocks:
            x = v[:, None] + m
            back.append(x.argmax(0))
            v = x.max(0)
        out = [int(v.argmax())]
        for b in back[::-1]:
            out.append(int(b[out[-1]]))
        return out[::-1]


def turn_lines(text: Column, parted: Column) -> Column:
    """A turn's lines as they stand in a transcript, a blank one before them if ``parted``."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.when(parted, F.concat(F.array(F.lit("")), lines)).otherwise(lines)


def train(labelled: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role") -> Model:
    """From turns (id, turn, role, lines) whose role is known, lines as in ``turn_lines``. The driver holds the counts alone."""
    rows = labelled.select(F.col(id).alias("id"), F.col(turn).alias("turn"), F.col(role).alias("role"), "lines").where(F.col("role").isin(ROLES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow, emitted = np.zeros(STATES), [np.zeros((STATES, w)) for w in WIDTHS]
        for batch in batches:
            for r, lines in zip(batch.column("role").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                _, seen = observed([x or "" for x in lines])
                s = 2 * ROLES.index(r)
                for i, line in enumerate(seen):
                    for e, x in zip(emitted, line, strict=True):
                        e[s + (i > 0), x] += 1
                if len(seen) > 1:
                    follow[s] += 1
                    follow[s + 1] += len(seen) - 2
        flat = np.concatenate([follow, *[e.ravel() for e in emitted]])
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(flat)), pa.int32()), "c": pa.array(flat)})

    flat = np.zeros(STATES + STATES * sum(WIDTHS))
    for k, c in rows.select("role", "lines").mapInArrow(lean(count), "k int, c double").groupBy("k").agg(F.sum("c")).collect():
        flat[k] = c
    turns = rows.select("id", "turn", "role", (F.size("lines") > 1).alias("long"))
    after = turns.select(F.col("id"), (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    start, follow = np.zeros(len(ROLES)), np.zeros((STATES, STATES))
    first = turns.groupBy("id").agg(F.min_by("role", "turn").alias("role"))
    for r, c in first.groupBy("role").count().collect():
        start[ROLES.index(r)] = c
    for a, long, b, c in turns.join(after, ["id", "turn"]).groupBy("role", "long", "next").count().collect():
        follow[2 * ROLES.index(a) + int(long), 2 * ROLES.index(b)] += c
    for r in range(len(ROLES)):
        follow[2 * r, 2 * r + 1] += flat[2 * r]
        follow[2 * r + 1, 2 * r + 1] += flat[2 * r + 1]
    emitted, at = [], STATES
    for w in WIDTHS:
        emitted.append(flat[at : at + STATES * w].reshape(STATES, w))
        at += STATES * w
    return Model(start, follow, emitted)


def parsed(raw: DataFrame, model: Model, id: str = "conv_id", number: str = "number", line: str = "line") -> DataFrame:
    """(id, number, role, continues, text, rendered): the turns found in raw lines (id, number, line), by the number of their first line."""
    kind, number_kind = raw.schema[id].dataType.simpleString(), raw.schema[number].dataType.simpleString()
    rows = raw.select(F.col(id).alias("id"), F.col(number).alias("number"), F.coalesce(line, F.lit("")).alias("line"), F.coalesce(F.floor(F.col(number) / BLOCK), F.lit(0)).cast("long").alias("block"))
    # Whether the line before a block is blank: a row for each block, not for each line, is put in order.
    last = rows.groupBy("id", "block").agg((F.trim(F.max_by("line", "number")) == "").alias("blank"))
    last = last.select(F.col("id").alias("_id"), F.col("block").alias("_block"), F.coalesce(F.lag("blank").over(Window.partitionBy("id").orderBy("block")), F.lit(True)).alias("parted"))
    rows = rows.join(last, F.col("id").eqNullSafe(F.col("_id")) & (F.col("block") == F.col("_block"))).drop("_id", "_block")
    sent = raw.sparkSession.sparkContext.broadcast(model)

    def lines_of(group: pa.Table) -> tuple[list, list[tuple[str, str]], np.ndarray, list[int]]:
        got = sorted(zip(group.column("number").to_pylist(), group.column("line").to_pylist(), strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        out, seen = observed([x for _, x in got])
        if len(seen) and group.column("parted")[0].as_py():
            seen[0, 1] = 1
        return got, out, seen, [i for i, (_, x) in enumerate(got) if x.strip()]

    def matrices(group: pa.Table) -> pa.Table:
        _, _, seen, _ = lines_of(group)
        m, model = np.full((STATES, STATES), -np.inf), sent.value
        first = model.start + model.emissions(seen[:1])[0] if len(seen) else model.start
        if len(seen):
            v = first
            for e in model.emissions(seen)[1:]:
                v = (v[:, None] + model.follow).max(0) + e
            m, first = model.matrix(seen), v
        return pa.table({"id": group.column("id")[:1], "block": group.column("block")[:1], "lines": pa.array([len(seen)], pa.int32()), "first": pa.array([first.tolist()], pa.list_(pa.float64())), "matrix": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})

    def chained(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        full = [i for i, n in enumerate(group.column("lines").to_pylist()) if n]
        before, end = [None] * len(group), [None] * len(group)
        if full:
            m = [np.array(x).reshape(STATES, STATES) for x in group.column("matrix").to_pylist()]
            ends = sent.value.ends(np.array(group.column("first")[full[0]].as_py()), [m[i] for i in full[1:]])
            for j, i in enumerate(full):
                end[i], before[i] = ends[j], ends[j - 1] if j else None
        return pa.table({"id": group.column("id"), "block": group.column("block"), "before": pa.array(before, pa.int32()), "end": pa.array(end, pa.int32())})

    def decode(group: pa.Table) -> pa.Table:
        got, out, seen, kept = lines_of(group)
        before, end = group.column("before")[0].as_py(), group.column("end")[0].as_py()
        states = sent.value.path(seen, before, end) if len(seen) else []
        turns: list[list] = []  # number, role, continues, lines
        for j, ((whole, rest), s, i) in enumerate(zip(out, states, kept, strict=True)):
            if s % 2 == 0 or not turns:
                turns.append([got[i][0], ROLES[s // 2], s % 2 == 1, [rest if s % 2 == 0 else whole]])
            else:
                turns[-1][3] += [x for _, x in got[kept[j - 1] + 1 : i]] + [whole]
        texts = ["\n".join(t[3]) for t in turns]
        return pa.table({
            "id": pa.array([group.column("id")[0].as_py()] * len(turns), group.schema.field("id").type),
            "number": pa.array([t[0] for t in turns], group.schema.field("number").type),
            "role": pa.array([t[1] for t in turns], pa.string()),
            "continues": pa.array([t[2] for t in turns], pa.bool_()),
            "text": pa.array(texts, pa.string()),
            "rendered": pa.array([f"<|{t[1]}|>\n{x}\n<|end|>" for t, x in zip(turns, texts, strict=True)], pa.string()),
        })

    steps = rows.groupBy("id", "block").applyInArrow(matrices, f"id {kind}, block long, lines int, first array<double>, matrix array<double>")
    ends = steps.groupBy("id").applyInArrow(chained, f"id {kind}, block long, before int, end int").withColumnsRenamed({"id": "_id", "block": "_block"})
    placed = rows.join(ends, F.col("id").eqNullSafe(F.col("_id")) & (F.col("block") == F.col("_block"))).drop("_id", "_block")
    found = placed.groupBy("id", "block").applyInArrow(decode, f"id {kind}, number {number_kind}, role string, continues boolean, text string, rendered string")
    return found.withColumnsRenamed({"id": id, "number": number})


#: Lines that a turn may have in the numbering of ``transcripts``.
TURN_LINES = 1 << 32


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, lines): conversations as they stand in raw transcripts: a style of markers for each, a quarter of the turns without any, and half parted by a blank line."""
    style = F.pmod(F.xxhash64(F.lit(1), "conv_id"), F.lit(2)).cast("int")
    bare = F.pmod(F.xxhash64(F.lit(2), "conv_id", "turn"), F.lit(4)) == 0
    parted = F.pmod(F.xxhash64(F.lit(3), "conv_id", "turn"), F.lit(2)) == 0
    mark = F.lit("")
    for r in ROLES:
        mark = F.when(F.col("role") == r, F.element_at(F.array(*[F.lit(f"{m.capitalize()}: ") for m in MARKERS[r][:2]]), style + 1)).otherwise(mark)
    text = F.concat(F.when(bare, "").otherwise(mark), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", turn_lines(text, parted).alias("lines"))


def raw_lines(turns: DataFrame) -> DataFrame:
    """(conv_id, number, line): the transcripts' lines alone, in order."""
    return turns.select("conv_id", "turn", F.posexplode("lines").alias("at", "line")).select("conv_id", (F.col("turn") * TURN_LINES + F.col("at")).alias("number"), "line")


def held_out(id: Column) -> Column:
    """A fifth of the conversations, by the checksum of their id: none of them trains."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's raw transcript as rendered turns; the model is trained on those not held out."""
    turns = transcripts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    found = parsed(raw_lines(turns), train(turns.where(~held_out(F.col("conv_id")))))
    return found.select("conv_id", "number", "role", "continues", held_out(F.col("conv_id")).alias("held_out"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "rendered")
