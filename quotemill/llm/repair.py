"""Structure repair of conversations: the cheapest edits that give `(s?(ua)+)?`, told by an audit.

Edits walk through nodes (row, state), a state being what was put out last: nothing, system, user
or assistant. Keep and rerole lead to the next row and state, delete to the next row, insert to
the next state. Conversations are cut into segments of SEGMENT rows. Min-plus matrices of the
segments, multiplied in a tree, give the cost from each boundary to the end; inside a segment a
backward pass gives the cost at every node.

Arcs that lose nothing form a graph whose paths are the cheapest edits. Its nodes are ranked by
the least audit of 1, 2, 4, ... letters that begins at them: a rank of twice the length orders
pairs (rank here, rank where the pointer leads), and pointers are doubled in step. The ranks pick
each node's arc; the doubled pointers lead from a segment's entry to its exit and, read back, list
the nodes between. A node's arcs carry different letters, so no path depends on a later segment's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotemill.llm.common import ranked, saved

SEGMENT = 512  # rows
FAN = 64  # segments under one node of the tree
CELLS = 1 << 17  # nodes of the segments solved together
BLOB = 4 << 20  # bytes of repaired text in one row, for conversations of several segments
SPACE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
NOWHERE = 1 << 40
FOUND, BLANK, DUPLICATE, CUT_SHORT = range(4)  # faults of a row
INITIALS = "sua"  # a role's number is its initial's place here, else 3
LETTERS = " DIKR"
FOLLOWING = np.array([2, 2, 3, 2])  # the state after an inserted or reroled turn, by state
#: The state after keeping a row, by role number and state; -1 where the pattern forbids it.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
ACCEPTED = np.array([0, NOWHERE, NOWHERE, 0])
LEGAL = {(0, 1), (1, 2), (2, 1)}


def with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs [.., state, ..] (state is axis 1) when turns may be inserted first."""
    out = costs.copy()
    out[:, 2] = np.minimum(costs[:, 2], INSERT + costs[:, 3])
    out[:, 3] = np.minimum(costs[:, 3], INSERT + costs[:, 2])
    for state in (0, 1):
        out[:, state] = np.minimum(costs[:, state], INSERT + out[:, 2])
    return out


def row_arcs(codes: np.ndarray, after: np.ndarray):
    """Yield (letter, cost, next state) of a row's arcs for each state: arrays [rows, 4]."""
    role, fault = codes % 4, codes // 4
    extra = np.where(fault == CUT_SHORT, TRUNCATED, 0)[:, None]
    gone = ((fault == BLANK) | (fault == DUPLICATE))[:, None]
    states = np.broadcast_to(np.arange(4), after.shape[:2])
    yield 1, np.full(states.shape, DELETE), states
    kept = KEPT[role]
    yield 3, np.where(gone | (kept < 0), NOWHERE, KEEP + extra), np.maximum(kept, 0)
    yield 4, np.where(gone, NOWHERE, REROLE + extra + np.zeros(4, np.int64)), np.broadcast_to(FOLLOWING, states.shape)


def before_row(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs [rows, 4, ..] before a row of each segment, from those after it."""
    best = None
    for _, cost, target in row_arcs(codes, after):
        taken = np.take_along_axis(after, target.reshape(*target.shape, *[1] * (after.ndim - 2)), 1)
        total = np.minimum(NOWHERE, cost.reshape(*cost.shape, *[1] * (after.ndim - 2)) + taken)
        best = total if best is None else np.minimum(best, total)
    return with_inserts(best)


def padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes aligned at their ends, and where each begins."""
    width = max(map(len, codes), default=0)
    table, begin = np.zeros((len(codes), width), np.int64), np.zeros(len(codes), np.int64)
    for i, row in enumerate(codes):
        begin[i] = width - len(row)
        table[i, begin[i] :] = row
    return table, begin


def costs_of(table: np.ndarray, begin: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Costs before every column of `table`, then after the last one; earlier than `begin` they stay."""
    out = [after]
    for t in range(table.shape[1] - 1, -1, -1):
        active = (t >= begin).reshape(-1, *[1] * (after.ndim - 1))
        out.append(np.where(active, before_row(table[:, t], out[-1]), out[-1]))
    return out[::-1]


def matrices(codes: list[np.ndarray]) -> np.ndarray:
    """Per segment the least cost from each state before it to each state after it: [n, 4, 4]."""
    table, begin = padded(codes)
    none = np.where(np.eye(4, dtype=bool), 0, NOWHERE)[None].repeat(len(codes), 0)
    return costs_of(table, begin, none)[0]


class Ranking:
    """The cheapest edits of segments, ordered by audit."""

    def __init__(self, codes: list[np.ndarray], after: np.ndarray, last: np.ndarray):
        table, self.begin = padded(codes)
        n, width = table.shape
        costs = costs_of(table, self.begin, after)
        self.start_costs = costs[0]
        at = lambda t, states: (t * n * 4) + np.arange(n)[:, None] * 4 + states
        # Per letter, where an arc that loses nothing leads; -1 where there is none.
        arcs = np.full((5, (width + 1) * n * 4), -1, np.int64)
        for t in range(width + 1):
            here = at(t, np.arange(4)).ravel()
            inside = np.broadcast_to((t >= self.begin)[:, None], (n, 4))
            if t < width:
                for letter, cost, target in row_arcs(table[:, t], costs[t + 1]):
                    total = cost + np.take_along_axis(costs[t + 1], target, 1)
                    good = inside & (total == costs[t]) & (costs[t] < NOWHERE)
                    arcs[letter, here] = np.where(good, at(t + 1, target), -1).ravel()
            else:
                inside = np.broadcast_to(last[:, None], (n, 4))  # turns may follow the last row
            total = INSERT + costs[t][:, FOLLOWING]
            good = inside & (total == costs[t]) & (costs[t] < NOWHERE)
            arcs[2, here] = np.where(good, at(t, np.broadcast_to(FOLLOWING, (n, 4))), -1).ravel()
        self.first = at(0, 0).ravel() + self.begin * n * 4  # the node of state 0 before the first row
        self.label, self.jumps = ranked_paths(arcs)

    def exit_states(self) -> np.ndarray:
        """The state after the segment for each state before it: [n, 4]."""
        return self.jumps[-1][self.first[:, None] + np.arange(4)] % 4

    def audits(self, entries: np.ndarray) -> list[str]:
        """The least audits of the segments, entered in the given states."""
        path = (self.first + entries)[:, None]
        for jump in self.jumps[:-1]:
            path = np.concatenate([path, jump[path]], axis=1)
        letters = np.frombuffer(LETTERS.encode(), np.uint8)[self.label[path]]
        return [row.tobytes().decode().rstrip(" ") for row in letters]


def ranked_paths(arcs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(letter taken at each node, pointers of 1, 2, 4, ... steps along the least paths).

    `arcs[letter, node]` is the node reached, or -1. A node without arcs ends its paths.
    """
    nodes = np.arange(arcs.shape[1])
    label = np.argmax(arcs >= 0, axis=0)  # the least letter; 0 at an end
    pointer = np.where(label > 0, arcs[label, nodes], nodes)
    rank, jumps = label, [pointer]
    while True:
        pairs = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
        rank = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        doubled = pointer[pointer]
        if np.array_equal(doubled, pointer):
            break
        pointer = doubled
        jumps.append(pointer)
    # Arcs by (letter, rank of the node reached): the ranks now order whole audits.
    top = int(rank.max(initial=0)) + 1
    keys = np.where(arcs >= 0, np.arange(5)[:, None] * top + rank[arcs], 5 * top)
    chosen = np.where(label > 0, np.argmin(keys, axis=0), 0)
    assert np.array_equal(chosen, label), "two arcs of one node share a letter"
    return label, jumps


def solved(codes: list[list[int]], solve) -> list:
    """`solve` over parts of the segments that fill at most CELLS cells, in the given order."""
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    out: list = [None] * len(codes)
    while order:
        size = max(1, CELLS // (4 * (len(codes[order[-1]]) + 1)))
        part, order = order[-size:], order[:-size]
        for i, found in zip(part, solve(part, [np.asarray(codes[i], np.int64) for i in part])):
            out[i] = found
    return out


def tree_scan(leaves: DataFrame, most: int, combine, push, top: list[int]) -> DataFrame:
    """(conv_id, seg, state) for (conv_id, seg, value array<long>): what `push` hands each segment.

    `combine(values)` is the value of several neighbours; `push(state, values)` gives each its
    state from that of their parent; `top` is the state of the whole. `most` is the largest seg.
    """
    if most == 0:
        return leaves.select("conv_id", "seg", F.array(*[F.lit(x).cast("long") for x in top]).alias("state"))
    up = F.array_sort(F.collect_list(F.struct("seg", "value"))).alias("held")
    groups = saved(leaves.groupBy("conv_id", F.floor(F.col("seg") / FAN).cast("long").alias("parent")).agg(up), "repair-tree")

    def summed(stream):
        for batch in stream:
            values = [combine([x["value"] for x in held]) for held in batch.column("held").to_pylist()]
            columns = [batch.column("conv_id"), batch.column("parent"), pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "seg", "value"])

    def pushed(stream):
        for batch in stream:
            owners, segs, states = [], [], []
            for owner, held, state in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "held", "state"))):
                owners += [owner] * len(held)
                segs += [x["seg"] for x in held]
                states += push(state, [x["value"] for x in held])
            columns = [pa.array(owners, pa.int64()), pa.array(segs, pa.int64()), pa.array(states, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "seg", "state"])

    parents = groups.mapInArrow(summed, "conv_id long, seg long, value array<long>")
    above = tree_scan(parents, most // FAN, combine, push, top).select(F.col("conv_id").alias("c"), F.col("seg").alias("p"), "state")
    same = groups["conv_id"].eqNullSafe(F.col("c")) & (groups["parent"] == F.col("p"))
    return groups.join(above, same).select("conv_id", "held", "state").mapInArrow(pushed, "conv_id long, seg long, state array<long>")


def _product(values: list[list[int]]) -> list[int]:
    """The min-plus product of 4 x 4 matrices."""
    out = np.asarray(values[0]).reshape(4, 4)
    for value in values[1:]:
        out = np.minimum(NOWHERE, (out[:, :, None] + np.asarray(value).reshape(1, 4, 4)).min(axis=1))
    return out.ravel().tolist()


def _costs_after(state: list[int], values: list[list[int]]) -> list[list[int]]:
    """The costs after each of several neighbours, from those after the last."""
    out, now = [], np.asarray(state)
    for value in reversed(values):
        out.append(now.tolist())
        now = np.minimum(NOWHERE, (np.asarray(value).reshape(4, 4) + now[None]).min(axis=1))
    return out[::-1]


def _composed(values: list[list[int]]) -> list[int]:
    out = [0, 1, 2, 3]
    for value in values:
        out = [value[x] for x in out]
    return out


def _entered(state: list[int], values: list[list[int]]) -> list[list[int]]:
    out, now = [], state[0]
    for value in values:
        out.append([now])
        now = value[now]
    return out


@dataclass
class Repair:
    """`reports`: one row per conversation; `turns`: the repaired turns, see `repair`."""

    reports: DataFrame
    turns: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Repair conversations (conv_id long, turn long, role string, text string, all non-null but ids and turns).

    A conversation's rows are taken by turn (nulls first), then role and text; null ids form a
    conversation. reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. turns:
    conv_id, seg, place, role, text, segs (segments of the conversation), in order of (seg, place).
    Each (conv_id, seg) lies in one partition, sorted. An empty table gives empty results. A role
    other than by the initials s, u, a can be reroled or deleted, not kept. Other columns are
    ignored.
    """
    narrow_rows = saved(rows.select("conv_id", "turn", "role", "text"), "repair-rows")
    placed = saved(ranked(narrow_rows, "conv_id", ["turn", "role", "text"], "repair-placed"), "repair-ranked")
    placed = placed.withColumn("seg", F.floor(F.col("pos") / SEGMENT).cast("long"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    role = F.pmod(F.expr(f"instr('{INITIALS}', substring(role, 1, 1))") - 1, F.lit(4))  # not found: 3
    narrow = placed.select(
        "conv_id", "seg", "pos", "turn",
        F.when(F.col("role") == "", 3).otherwise(role).alias("role"),
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("said"),
    )
    narrow = saved(narrow, "repair-narrow")
    # Stored before the join, which adaptive execution can then split where one text is everywhere.
    again = narrow.groupBy("conv_id", "said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = saved(again.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first"), "repair-again")
    seen = narrow["conv_id"].eqNullSafe(F.col("c")) & (narrow["said"] == F.col("s"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(F.col("cut"), CUT_SHORT).otherwise(FOUND)
    coded = narrow.join(again, seen, "left").select("conv_id", "seg", "pos", (F.col("role") + 4 * fault).cast("int").alias("code"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x.code).alias("codes")
    segments = coded.groupBy("conv_id", "seg").agg(held)
    stats = narrow.groupBy("conv_id").agg(
        F.count("*").alias("rows"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    stats = saved(stats.select(F.col("conv_id").alias("c"), "gaps", F.ceil(F.col("rows") / SEGMENT).cast("long").alias("segs")), "repair-stats")
    segments = segments.join(stats, segments["conv_id"].eqNullSafe(F.col("c"))).drop("c")
    segments = saved(segments, "repair-segments")
    many = segments.where("segs > 1")
    most = (stats.agg(F.max("segs")).first()[0] or 1) - 1

    def matrix(stream):
        for batch in stream:
            found = solved(batch.column("codes").to_pylist(), lambda part, codes: matrices(codes).reshape(-1, 16).tolist())
            columns = [batch.column("conv_id"), batch.column("seg"), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "seg", "value"])

    end = with_inserts(ACCEPTED[None])[0].tolist()
    known = lambda df, name: df.select(F.col("conv_id").alias("c"), F.col("seg").alias("g"), F.col("state").alias(name))
    same = lambda left: left["conv_id"].eqNullSafe(F.col("c")) & (left["seg"] == F.col("g"))
    values = many.select("conv_id", "seg", "codes").mapInArrow(matrix, "conv_id long, seg long, value array<long>")
    after = known(tree_scan(values, most, _product, _costs_after, end), "after") if most else None

    def ranking(batch, part, codes):
        after = [batch["after"][i] or end for i in part]
        last = [batch["seg"][i] + 1 == batch["segs"][i] for i in part]
        return Ranking(codes, np.asarray(after, np.int64), np.asarray(last))

    def exits(stream):
        for batch in stream:
            rows = batch.to_pydict()
            found = solved(rows["codes"], lambda part, codes: ranking(rows, part, codes).exit_states().tolist())
            columns = [batch.column("conv_id"), batch.column("seg"), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "seg", "value"])

    def audit(stream):
        for batch in stream:
            rows = batch.to_pydict()
            entries = [e[0] if e else 0 for e in rows["entry"]]

            def read(part, codes):
                found = ranking(rows, part, codes)
                mine = np.asarray([entries[i] for i in part], np.int64)
                begun = found.start_costs[np.arange(len(part)), mine]
                return list(zip(found.audits(mine), begun.tolist()))

            told = solved(rows["codes"], read)
            roles = [[c % 4 for c in codes] for codes in rows["codes"]]
            out = {
                "conv_id": batch.column("conv_id"), "seg": batch.column("seg"), "segs": batch.column("segs"),
                "gaps": batch.column("gaps"), "entry": pa.array(entries, pa.int64()),
                "audit": [a for a, _ in told], "cost": pa.array([c for _, c in told], pa.int64()),
                "illegal": pa.array([sum(p not in LEGAL for p in zip(r, r[1:])) for r in roles], pa.int64()),
                "first": pa.array([r[0] for r in roles], pa.int64()), "final": pa.array([r[-1] for r in roles], pa.int64()),
            }
            for name, number in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT_SHORT)):
                out[name] = pa.array([sum(c // 4 == number for c in codes) for codes in rows["codes"]], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    schema = "conv_id long, seg long, segs long, gaps long, entry long, audit string, cost long, illegal long, first long, final long, blank long, duplicate long, truncated long"
    if after is None:
        full = segments.withColumns({"after": F.lit(None).cast("array<long>"), "entry": F.lit(None).cast("array<long>")})
    else:
        costed = saved(segments.join(after, same(segments), "left").drop("c", "g"), "repair-costed")
        maps = costed.where("segs > 1").mapInArrow(exits, "conv_id long, seg long, value array<long>")
        entry = known(tree_scan(maps, most, _composed, _entered, [0]), "entry")
        full = costed.join(entry, same(costed), "left").drop("c", "g")
    plans = saved(full.mapInArrow(audit, schema), "repair-plans")
    return Repair(_reports(plans), _turns(placed, plans))


def _reports(plans: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seg", "audit", "first", "final")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    cost = F.max(F.when(F.col("seg") == 0, F.col("cost"))).alias("cost")
    held = plans.groupBy("conv_id").agg(F.max("gaps").alias("gaps"), *sums, cost, parts.alias("parts"))
    pair = lambda a, b: F.concat(a.final.cast("string"), b.first.cast("string"))
    legal = [f"{a}{b}" for a, b in LEGAL]
    n = F.size("parts")
    seams = F.zip_with(F.slice("parts", F.lit(1), n - 1), F.slice("parts", F.lit(2), n), pair)
    between = F.size(F.filter(seams, lambda x: ~x.isin(legal))).cast("long")
    audit = F.array_join(F.transform("parts", lambda p: p.audit), "").alias("audit")
    return held.select("conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + between).alias("illegal"), "cost", audit)


def _turns(placed: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired turns: each segment's plan comes before its rows, which are read as a stream."""
    told = plans.select(
        "conv_id", "seg", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"),
        F.col("audit").alias("text"), "entry", "segs",
    )
    rows = placed.select("conv_id", "seg", "pos", "role", "text", F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("segs"))
    dealt = rows.unionByName(told).repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos")
    inserted = {2: "user", 3: "assistant"}

    def apply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "seg", "place", "role", "text", "segs"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        audit, letter, state, place, segs = "", 0, 0, 0, 0

        def inserts(owner, seg):
            nonlocal letter, state, place
            while letter < len(audit) and audit[letter] == "I":
                state = int(FOLLOWING[state])
                yield owner, seg, place, inserted[state], "", segs
                letter, place = letter + 1, place + 1

        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                out = []
                for row in batch.slice(start, 512).to_pylist():
                    owner, seg = row["conv_id"], row["seg"]
                    if row["pos"] < 0:
                        audit, letter, state, place, segs = row["text"], 0, row["entry"], 0, row["segs"]
                    else:
                        edit = audit[letter]
                        letter += 1
                        if edit == "K":
                            state = int(KEPT[INITIALS.index(row["role"][0])][state])
                            out.append((owner, seg, place, row["role"], row["text"], segs))
                            place += 1
                        elif edit == "R":
                            state = int(FOLLOWING[state])
                            out.append((owner, seg, place, inserted[state], row["text"], segs))
                            place += 1
                    out.extend(inserts(owner, seg))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

    return dealt.mapInArrow(apply, "conv_id long, seg long, place long, role string, text string, segs long")


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of `role:text` joined by newlines, for `Repair.turns`; none where nothing is left.

    A conversation of one segment is hashed where its turns are. The texts of longer ones are
    packed per segment and hashed as a stream, which has to run in one task.
    """
    schema = "conv_id long, seg long, part long, segs long, blob binary, sha256 string"
    names = ["conv_id", "seg", "part", "segs", "blob", "sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def pack(stream):
        now, held, size, part, whole = None, [], 0, 0, sha256()

        def row(blob, digest):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((now[0], now[1], part, now[2], blob, digest), kinds)], names)

        def done():
            return row(None, whole.hexdigest()) if now[2] == 1 else row(b"".join(held), None)

        for batch in stream:
            for turn in (x for start in range(0, batch.num_rows, 512) for x in batch.slice(start, 512).to_pylist()):
                key = (turn["conv_id"], turn["seg"], turn["segs"])
                if now is not None and key != now:
                    yield done()
                first = key != now
                if first:
                    now, held, size, part, whole = key, [], 0, 0, sha256()
                data = ("" if first else "\n").encode() + f"{turn['role']}:{turn['text']}".encode()
                if key[2] == 1:
                    whole.update(data)
                    continue
                held.append(data)
                size += len(data)
                if size >= BLOB:
                    yield row(b"".join(held), None)
                    held, size, part = [], 0, part + 1
        if now is not None:
            yield done()

    def fold(stream):
        now, whole = None, sha256()
        for batch in stream:
            for i in range(batch.num_rows):
                owner, part, blob = (batch.column(c)[i].as_py() for c in ("conv_id", "part", "blob"))
                if now is not None and (owner,) != now:
                    yield pa.RecordBatch.from_pydict({"conv_id": pa.array([now[0]], pa.int64()), "sha256": [whole.hexdigest()]})
                if (owner,) != now:
                    now, whole = (owner,), sha256()
                elif part == 0:
                    whole.update(b"\n")
                whole.update(blob)
        if now is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([now[0]], pa.int64()), "sha256": [whole.hexdigest()]})

    packed = saved(turns.mapInArrow(pack, schema), "repair-packed")
    single = packed.where("segs = 1").select("conv_id", "sha256")
    longer = packed.where("segs > 1").repartition("conv_id").sortWithinPartitions("conv_id", "seg", "part")
    return single.unionByName(longer.select("conv_id", "part", "blob").mapInArrow(fold, "conv_id long, sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults by crc32 of "conv_id:turn", nulls written as one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text, role = or_space("text"), or_space("role")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(lot == 3, 2).otherwise(1)))
    return conversations.where(lot != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(lot == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(lot == 1, F.lit("")).when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations`: the reports on its damaged rows and the repaired text's digest."""
    fixed = repair(damaged(conversations))
    everyone = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    shas = text_digests(fixed.turns).select(F.col("conv_id").alias("owner"), "sha256")
    reports = everyone.join(fixed.reports, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return reports.join(shas, F.col("id").eqNullSafe(F.col("owner")), "left").select(
        F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )
