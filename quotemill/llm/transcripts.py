"""Roles and turns of plain transcripts by a hidden Markov model over line features.

A transcript comes as blocks of lines in order of position. Every line is observed through its
speaker marker, a closing question mark, its length, and whether it opens a block or follows a
blank line. The hidden state is (role, begins a turn
or goes on). Viterbi recovers the states; maximal turns are then rendered in canonical form.

A transcript may be of any length, so Viterbi runs in pieces: each segment of positions is
reduced to a max-plus matrix (best score from any state before it to any state at its end), the
matrices are multiplied up a tree, the states at segment borders are read off down the tree,
and each segment is decoded between its known borders.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotemill.llm.common import ranked, saved

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role + (0 begins a turn, 1 goes on)
SEGMENT = 64  # positions of a segment, and children of a tree node
SPEAKERS = {  # fixed values: how transcripts name their speakers
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a"),
}
MARKER = re.compile(
    r"^\s*(?:[#*>\[(<|-]+\s*)?(" + "|".join(sorted((n for v in SPEAKERS.values() for n in v), key=len, reverse=True)) + r")\s*[\])>|*]*\s*[:>]\s*",
    re.I,
)
ROLE_OF = {name: role for role, names in SPEAKERS.items() for name in names}
LENGTHS = (0, 20, 80, 300)
SIZES = (len(ROLES) + 1, 2, len(LENGTHS) + 1, 2)  # values of each feature


def observe(line: str, opens: bool) -> tuple[tuple[int, int, int, int], str]:
    """The features of a line (marker, question mark, length, opens a block) and the line without its marker."""
    found = MARKER.match(line)
    marker = 1 + ROLES.index(ROLE_OF[found[1].lower()]) if found else 0
    rest = line[found.end() :] if found else line
    return (marker, int(rest.rstrip().endswith("?")), sum(len(rest) > n for n in LENGTHS), int(opens)), rest


@dataclass
class Model:
    """Log probabilities: start[state], move[state, state], emit[feature][state, value]."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    @classmethod
    def from_counts(cls, counts: dict[tuple[str, int, int], int]) -> Model:
        """Add-one estimates; a first line begins a turn, only a turn of the same role goes on.

        What a marker says is learned like the rest: lines that look like one inside a turn teach
        the model how far to trust it.
        """
        start, move = np.ones(STATES), np.ones((STATES, STATES))
        emit = [np.ones((STATES, size)) for size in SIZES]
        for (kind, a, b), n in counts.items():
            if kind == "start":
                start[a] += n
            elif kind == "move":
                move[a, b] += n
            else:
                emit[int(kind)][a, b] += n
        start[1::2] = 0
        for a in range(STATES):
            for b in range(1, STATES, 2):
                if a // 2 != b // 2:
                    move[a, b] = 0
        with np.errstate(divide="ignore"):
            return cls(
                np.log(start / start.sum()),
                np.log(move / move.sum(axis=1, keepdims=True)),
                [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit],
            )

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Emission scores, one row per line of feature values."""
        return sum(e[:, seen[:, i]].T for i, e in enumerate(self.emit))

    def step(self, before: np.ndarray, emitted: np.ndarray) -> np.ndarray:
        """Best scores per state after one more line; rows of `before` are starting states."""
        return (before[:, :, None] + self.move[None]).max(axis=1) + emitted[None]

    def matrix(self, seen: np.ndarray) -> np.ndarray:
        """Rows: the state before the lines, the last row "nothing before"; columns: the last state."""
        first, *others = self.scores(seen)
        out = np.vstack([self.move, self.start]) + first
        for emitted in others:
            out = self.step(out, emitted)
        return out

    def decode(self, seen: np.ndarray, before: int, after: int) -> list[int]:
        """The best states of the lines between the given border states (before may be STATES)."""
        emitted = self.scores(seen)
        score, back = np.vstack([self.move, self.start])[before] + emitted[0], []
        for row in emitted[1:]:
            ways = score[:, None] + self.move
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + row
        states = [after]
        for pointers in reversed(back):
            states.append(int(pointers[states[-1]]))
        return states[::-1]


def spoken(line: str, rest: str, marker: int, state: int) -> str:
    """A line without its marker, if it begins a turn of the role the marker names."""
    return rest if state == 2 * (marker - 1) else line


def lines_of(table: pa.Table) -> tuple[list[tuple[str, str]], np.ndarray, list[int], list]:
    """The lines of a group's blocks in order: (line, line without marker), features, first-of-block flags, labels."""
    order = sorted(zip(table["pos"].to_pylist(), table["text"].to_pylist(), table["role"].to_pylist()), key=lambda r: (r[0], r[1], r[2] or ""))
    rests, seen, firsts, labels = [], [], [], []
    for _, text, role in order:
        lines = text.split("\n")
        for i, line in enumerate(lines):
            features, rest = observe(line, i == 0 or not lines[i - 1].strip())
            rests.append((line, rest))
            seen.append(features)
            firsts.append(int(i == 0))
            labels.append(role)
    return rests, np.asarray(seen, np.int64).reshape(len(seen), len(SIZES)), firsts, labels


def blocks(transcripts: DataFrame) -> DataFrame:
    """(conv_id, pos, seg, text, role) with one segment number per SEGMENT positions, from 0.

    Rows without a position get some before all others, by text, so they fill segments as well.
    """
    role = F.col("role") if "role" in transcripts.columns else F.lit(None).cast("string")
    rows = transcripts.select(
        "conv_id", F.col("pos").cast("long").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), role.alias("role")
    ).dropDuplicates()
    low, unplaced = rows.agg(F.min("pos"), F.count_if(F.col("pos").isNull())).first()
    low = low or 0
    if unplaced:
        loose = saved(rows.where("pos IS NULL").drop("pos"), "turns-unplaced")
        loose = saved(ranked(loose, "conv_id", ["text", "role"], "turns-ranked"), "turns-placed")
        most = loose.agg(F.max("pos")).first()[0] + 1
        loose = loose.withColumn("pos", F.col("pos") + F.lit(low - most)).select(*rows.columns)
        rows, low = rows.where("pos IS NOT NULL").unionByName(loose), low - most
    return rows.withColumn("seg", F.floor((F.col("pos") - F.lit(low)) / SEGMENT).cast("long"))


def learn(transcripts: DataFrame, segments: int = 20_000) -> Model:
    """Count states, moves and features on labelled blocks (conv_id, pos, text, role).

    The fit reads a bounded sample: about `segments` whole segments, chosen by hash. Blocks with a
    role outside ROLES are left out. A label's turn begins with its block.
    """
    rows = saved(blocks(transcripts).where(F.col("role").isin(*ROLES)), "labelled-turns")
    total = rows.select("conv_id", "seg").distinct().count()
    scale = 1 << 20
    limit = min(scale, scale * segments // max(1, total) + 1)
    chosen = rows.where(F.pmod(F.xxhash64("conv_id", "seg"), F.lit(scale)) < limit)

    def count(table: pa.Table) -> pa.Table:
        _, seen, firsts, labels = lines_of(table)
        states = [2 * ROLES.index(role) + 1 - first for role, first in zip(labels, firsts)]
        counts: Counter = Counter(("move", a, b) for a, b in zip(states, states[1:]))
        if table["seg"][0].as_py() == 0:
            counts["start", states[0], 0] += 1
        for i in range(len(SIZES)):
            counts.update((str(i), state, int(value)) for state, value in zip(states, seen[:, i]))
        kind, a, b = zip(*counts)
        return pa.table({"kind": kind, "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "n": pa.array(counts.values(), pa.int64())})

    count.__annotations__ = {"table": pa.Table, "return": pa.Table}
    found = chosen.groupBy("conv_id", "seg").applyInArrow(count, "kind string, a int, b int, n long")
    total_counts = found.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model.from_counts({(r.kind, r.a, r.b): r.n for r in total_counts})


def _border_states(matrices: DataFrame, levels: int) -> DataFrame:
    """(conv_id, seg, before, after): the best states at the borders of every segment.

    `matrices` is (conv_id, seg, m binary). Up the tree SEGMENT neighbours become one node; the
    top node of a conversation is entered with nothing before it and left in its best state.
    """

    def shaped(table: pa.Table) -> list[tuple[int, np.ndarray]]:
        found = zip(table["seg"].to_pylist(), table["m"].to_pylist())
        return sorted(((s, np.frombuffer(m, "<f8").reshape(STATES + 1, STATES)) for s, m in found), key=lambda f: f[0])

    def multiply(table: pa.Table) -> pa.Table:
        children = shaped(table)
        out = children[0][1]
        for _, m in children[1:]:
            out = (out[:, :, None] + m[None, :STATES]).max(axis=1)
        head = table.slice(0, 1)
        return pa.table({"conv_id": head["conv_id"], "seg": [children[0][0] // SEGMENT], "m": pa.array([out.astype("<f8").tobytes()], pa.binary())})

    def split(table: pa.Table) -> pa.Table:
        children = shaped(table)
        before, after = table["before"][0].as_py(), table["after"][0].as_py()
        scores = [children[0][1][before]]
        for _, m in children[1:]:
            scores.append((scores[-1][:, None] + m[:STATES]).max(axis=0))
        ends = [int(scores[-1].argmax()) if after is None else after]
        for score, (_, m) in zip(scores[-2::-1], children[:0:-1]):
            ends.append(int((score + m[:STATES, ends[-1]]).argmax()))
        ends.reverse()
        return pa.table(
            {
                "conv_id": table["conv_id"],
                "seg": [s for s, _ in children],
                "before": pa.array([before, *ends[:-1]], pa.int32()),
                "after": pa.array(ends, pa.int32()),
            }
        )

    for f in (multiply, split):
        f.__annotations__ = {"table": pa.Table, "return": pa.Table}
    kind = matrices.schema["conv_id"].dataType.simpleString()
    parent = F.floor(F.col("seg") / SEGMENT).cast("long").alias("parent")
    tree = [matrices]
    for _ in range(levels):
        grouped = tree[-1].groupBy("conv_id", parent)
        tree.append(saved(grouped.applyInArrow(multiply, f"conv_id {kind}, seg long, m binary"), "turn-tree"))
    borders = tree[-1].select("conv_id", "seg", F.lit(STATES).alias("before"), F.lit(None).cast("int").alias("after"))
    for level in reversed(tree):
        if level is tree[-1]:
            joined = level.join(borders, ["conv_id", "seg"]).withColumn("parent", F.col("seg"))
        else:
            above = borders.withColumnRenamed("seg", "parent")
            joined = level.withColumn("parent", F.floor(F.col("seg") / SEGMENT).cast("long")).join(above, ["conv_id", "parent"])
        borders = joined.groupBy("conv_id", "parent").applyInArrow(split, f"conv_id {kind}, seg long, before int, after int")
    return borders


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """Recovered turns of the transcripts given as blocks (conv_id, pos, text).

    Returns conv_id, seg, n, role, continued, text, rendered. Ordered by (seg, n) the rendered
    pieces of a conversation joined by newlines are its canonical transcript: "<|role|>", then the
    turn's lines, the first without its marker. A turn that crosses the border of a segment comes in pieces,
    the later ones `continued` and without the role line. Blocks are ordered by (pos, text), exact
    repeats count once, a null pos comes before all others, a null text is one empty line, rows with a null conv_id
    are left out.
    """
    rows = saved(blocks(transcripts).where("conv_id IS NOT NULL").withColumn("role", F.lit(None).cast("string")), "turns")
    kind = rows.schema["conv_id"].dataType.simpleString()
    parts = (model.start, model.move, model.emit)

    def reduce(table: pa.Table) -> pa.Table:
        _, seen, _, _ = lines_of(table)
        m = Model(*parts).matrix(seen).astype("<f8").tobytes()
        return pa.table({"conv_id": table["conv_id"].slice(0, 1), "seg": table["seg"].slice(0, 1), "m": pa.array([m], pa.binary())})

    def render(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lines, seen, _, _ = lines_of(left)
        states = Model(*parts).decode(seen, right["before"][0].as_py(), right["after"][0].as_py())
        pieces: list[tuple[str, bool, list[str]]] = []
        for state, (line, rest), marker in zip(states, lines, seen[:, 0].tolist()):
            if state % 2 == 0 or not pieces:
                pieces.append((ROLES[state // 2], bool(state % 2), []))
            pieces[-1][2].append(spoken(line, rest, marker, state))
        texts = ["\n".join(p[2]) for p in pieces]
        heads = ["" if p[1] else f"<|{p[0]}|>\n" for p in pieces]
        return pa.table(
            {
                "conv_id": pa.array([key[0].as_py()] * len(pieces), left["conv_id"].type),
                "seg": pa.array([key[1].as_py()] * len(pieces), pa.int64()),
                "n": pa.array(range(len(pieces)), pa.int32()),
                "role": pa.array([p[0] for p in pieces], pa.string()),
                "continued": pa.array([p[1] for p in pieces], pa.bool_()),
                "text": pa.array(texts, pa.string()),
                "rendered": pa.array([h + t for h, t in zip(heads, texts)], pa.string()),
            }
        )

    reduce.__annotations__ = {"table": pa.Table, "return": pa.Table}
    render.__annotations__ = {"key": tuple[pa.Scalar, ...], "left": pa.Table, "right": pa.Table, "return": pa.Table}
    reduced = rows.groupBy("conv_id", "seg").applyInArrow(reduce, f"conv_id {kind}, seg long, m binary")
    matrices = saved(reduced, "turn-matrices")
    top, levels = matrices.agg(F.max("seg")).first()[0] or 0, 0
    while top:
        top, levels = top // SEGMENT, levels + 1
    borders = _border_states(matrices, levels).select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), "before", "after")
    return rows.groupBy("conv_id", "seg").cogroup(borders.groupBy("c", "s")).applyInArrow(
        render, f"conv_id {kind}, seg long, n int, role string, continued boolean, text string, rendered string"
    )


ASIDES = ("Q: and what then", "Answer: forty-two", "Context: see above", "A: as I said", "Question: is that all?")


def defaced(conversations: DataFrame) -> DataFrame:
    """Plain transcripts (conv_id, pos, text, role, said) of a conversations table, to be parsed again.

    Each turn becomes a block that begins with its speaker's name in the conversation's style;
    every fourth block, by hash, has no name. Every sixth turn ends with a line that looks like a
    speaker's name but is the turn's own. `role` and `said`, the turn's text without the name, are
    kept for learning and scoring only.
    """
    by = lambda what, n: F.pmod(F.xxhash64("conv_id", "turn", F.lit(what)), F.lit(n)).cast("int")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3)).cast("int")
    names = F.create_map(*[x for role, known in SPEAKERS.items() for x in (F.lit(role), F.array(*[F.lit(n.capitalize()) for n in known[:3]]))])
    name = F.get(names[F.col("role")], style)
    unnamed = name.isNull() | (by("name", 4) == 0)
    aside = F.get(F.array(*[F.lit("\n" + a) for a in ASIDES]), by("which", len(ASIDES)))
    said = F.concat(F.coalesce("text", F.lit("")), F.when(by("aside", 6) == 0, aside).otherwise(F.lit("")))
    return conversations.select(
        "conv_id", F.col("turn").alias("pos"), F.when(unnamed, said).otherwise(F.concat(name, F.lit(": "), said)).alias("text"), "role", said.alias("said")
    )
