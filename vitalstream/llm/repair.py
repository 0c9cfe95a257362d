"""Cheapest repair of a conversation's turns, the least audit among equals.

Turns are kept, given another role, deleted, or inserted without text, so that the
roles' initials read ``(s?(ua)+)?``. A node is (rows read, state of that pattern); its arcs are
the edits ``D``, ``I``, ``K`` and ``R``. A cost DP from the end finds the arcs that lie on a cheapest path. Those arcs
are ranked by their letter, then by the audits of length 2, 4, 8, ... that begin with them: a
rank at twice the length is the rank of the pair (own rank, rank of the arc reached by the
doubled pointer). The ranks select the least arc of a node, and the doubled pointers unfold the path.

A conversation of any length is cut into segments of ``BLOCK`` rows at most, and
only one-byte codes of rows enter them:

1. a segment gives its 4 x 4 matrix of least costs between the states at its ends;
2. one pass back over the matrices of a conversation gives the cost from each segment's end to the conversation's;
3. a segment ranks its arcs and gives the least audit for each state it may be entered in;
4. a stream over the sorted rows enters each segment in the state it has reached and writes the edits.

No step holds the texts of a conversation; the stream holds one turn, the summary its audit.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitalstream.llm.common import col, materialise, pieces_of

#: Rows of a segment; a power of two.
BLOCK = 1 << 14
SPACE = " \t\n\x0b\f\r"
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: States: nothing written, after a system, a user, an assistant turn. The next of an inserted or reroled turn, and its role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = (None, None, "user", "assistant")
#: Cost and audit from a state after the last row to an end.
CLOSING = (0.0, 4.0, 2.0, 0.0)
SUFFIX = ("", "II", "I", "")
#: Faults, as the second digit of a row's code; the first is the place of its initial here.
INITIALS = "sua"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
FAULTS = (None, "truncated", "blank", "duplicate")
END = -1


@lru_cache(maxsize=None)
def step(code: int, ahead: tuple[float, ...]):
    """One row back: the least cost on, costs relative to it, and the optimal arcs of each state as (letter, move) by letter."""
    initial, fault = divmod(code, 4)
    extra = 1 if fault == TRUNCATED else 0
    arcs: list[dict[int, tuple[float, int, int]]] = []
    for state in range(4):
        out = {DELETE: (COST[DELETE], 1, state)}
        if fault in (FINE, TRUNCATED):
            to = NEXT[state]
            out[REROLE] = (COST[REROLE] + extra, 1, to)
            if initial == 0 and state == START:
                out[KEEP] = (extra, 1, SYSTEM)
            elif initial in (1, 2) and to == initial + 1:
                out[KEEP] = (extra, 1, to)
        out[INSERT] = (COST[INSERT], 0, NEXT[state])
        arcs.append(out)
    here = [min(c + ahead[to] for c, rows, to in out.values() if rows) for out in arcs]
    for _ in range(2):  # at most two inserted turns in a row help
        here = [min(h, COST[INSERT] + here[NEXT[s]]) for s, h in enumerate(here)]
    best = []
    for state, out in enumerate(arcs):
        found = []
        for letter in sorted(out):
            cost, rows, to = out[letter]
            if here[state] < float("inf") and cost + (ahead if rows else here)[to] == here[state]:
                found.append((letter, 4 * rows + to - state))
        best.append(tuple(found))
    least = min(here)
    counts = bytes(map(len, best))
    letters = np.array([a for f in best for a, _ in f], np.int8).tobytes()
    moves = np.array([m for f in best for _, m in f], np.int8).tobytes()
    return least, tuple(h - least for h in here), counts, letters, moves


def matrix(codes: bytes) -> list[float]:
    """Least costs from each state before the rows to each state after them, insertions after the last row apart."""
    out = []
    for to in range(4):
        total, costs = 0.0, tuple(0.0 if s == to else float("inf") for s in range(4))
        for code in reversed(codes):
            least, costs, *_ = step(code, costs)
            total += least
        out.append([total + c for c in costs])
    return [out[to][s] for s in range(4) for to in range(4)]


def least_audits(segments: list[tuple[bytes, tuple[float, ...]]]) -> list[list[str]]:
    """Per segment (codes, costs from its end) and state it is entered in: the least audit up to its end."""
    counts, letters, moves, firsts, at = [], [], [], [], 0
    for codes, ahead in segments:
        least = min(ahead)
        costs = tuple(c - least for c in ahead)
        rows = []
        for code in reversed(codes):
            _, costs, *arcs = step(code, costs)
            rows.append(arcs)
        rows.reverse()
        firsts.append(at)
        at += 4 * len(codes) + 4
        # Each state after the last row has one arc, to itself.
        counts += [r[0] for r in rows] + [b"\x01" * 4]
        letters += [r[1] for r in rows] + [np.full(4, END, np.int8).tobytes()]
        moves += [r[2] for r in rows] + [b"\x00" * 4]
    counts, letter, move = (np.frombuffer(b"".join(x), np.int8).astype(np.int64) for x in (counts, letters, moves))
    # Arcs of node v: begin[v] to begin[v + 1], by letter.
    begin = np.concatenate([[0], np.cumsum(counts)])
    head = np.repeat(np.arange(len(counts)), counts) + move
    rank = letter + 1
    jumps = [_least_arcs(rank, begin)[head]]
    while (letter[jumps[-1]] != END).any():
        rank = _dense(rank, rank[jumps[-1]])
        jumps.append(jumps[-1][jumps[-1]])
    rank = _dense(rank, rank[jumps[-1]])
    entries = (np.array(firsts)[:, None] + np.arange(4)).ravel()
    path = _least_arcs(rank, begin)[entries]
    owner = np.arange(len(path))
    # A path's arcs at even places are known; those at odd places lie one jump on.
    for jump in reversed(jumps):
        following = np.stack([path, jump[path]], axis=1).ravel()
        keep = np.stack([np.ones(len(path), bool), letter[jump[path]] != END], axis=1).ravel()
        path, owner = following[keep], np.repeat(owner, 2)[keep]
    text = np.frombuffer(LETTERS.encode(), np.uint8)[letter[path]].tobytes().decode()
    ends = np.searchsorted(owner, np.arange(len(entries)), "right").tolist()
    audits = [text[a:b] for a, b in zip([0, *ends], ends)]
    return [audits[k : k + 4] for k in range(0, len(audits), 4)]


def _dense(rank: np.ndarray, then: np.ndarray) -> np.ndarray:
    return np.unique(rank * (then.max() + 2) + then, return_inverse=True)[1]


def _least_arcs(rank: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The arc of the least rank of each node."""
    node = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    return np.lexsort((rank, node))[begin[:-1]]


def repair_conversations(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """The cheapest edits, one row each: ``conv_id, place, edit, turn, role, text, was_role, fault``.

    A conversation's rows are taken by turn (nulls first); rows of one turn by a hash of role and text, so
    that copies are adjacent. Null roles and texts are one space. The first fault of a row counts: ``blank`` (no
    visible character), ``duplicate`` (role and text stood before), ``truncated`` (the last visible character is none of ``.!?``). ``edit``
    is ``K`` (costs 0), ``R`` (another role, 2), ``D`` (3, and required for blank and duplicate rows) or
    ``I`` (an empty turn, 2; ``turn``, ``was_role`` and ``fault`` are null); truncated rows that stay cost 1 more. Among
    cheapest edits those whose letters come first in ASCII are taken. ``role`` is the role after the edit,
    for ``D`` the row's own. ``place`` counts the edits of a conversation from 0. Rows with a null conversation
    form one conversation. An empty table gives an empty result; other columns are not read. The result is
    partitioned by conversation and in order within a partition.
    """
    if block & (block - 1):
        raise ValueError("block must be a power of two")
    rows = _ordered(df.select(
        col(conv_id).alias("conv"), col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(col(text).cast("string"), F.lit(" ")).alias("text"),
    ))
    codes = materialise(_codes(rows).withColumn("block", F.floor(F.col("gid") / block)), "turn-codes")
    conv, when = rows.schema["conv"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    costs = codes.groupBy("block").applyInArrow(
        _matrices, f"conv {conv}, gid long, costs array<double>"
    )
    ahead = costs.repartition("conv").sortWithinPartitions("conv", F.desc("gid")).mapInArrow(
        _costs_on, "gid long, ahead array<double>"
    ).withColumn("block", F.floor(F.col("gid") / block))
    audited = codes.groupBy("block").cogroup(ahead.groupBy("block")).applyInArrow(
        _audits, f"conv {conv}, gid long, audits array<string>, codes binary"
    )
    none = F.lit(None)
    stream = audited.select(
        "conv", "gid", F.lit(0).alias("part"), "audits", "codes", none.cast(when).alias("turn"),
        none.cast("string").alias("role"), none.cast("string").alias("text"),
    ).unionByName(rows.select(
        "conv", "gid", F.lit(1).alias("part"), none.cast("array<string>").alias("audits"), none.cast("binary").alias("codes"),
        "turn", "role", "text",
    ))
    return stream.repartition("conv").sortWithinPartitions("conv", "gid", "part").mapInArrow(
        _edits(rows.schema["conv"].dataType, rows.schema["turn"].dataType),
        f"conv_id {conv}, place long, edit string, turn {when}, role string, text string, was_role string, fault string",
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows stored in order, with ascending numbers ``gid``; a long conversation spreads over many tasks."""
    by = ["conv", "turn", "hash", "tie"]
    sized = rows.withColumns({"hash": F.xxhash64("role", "text"), "tie": F.monotonically_increasing_id()})
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sized.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    return materialise(placed.withColumn("gid", F.monotonically_increasing_id()).drop("hash", "tie"), "ordered-turns")


def _codes(rows: DataFrame) -> DataFrame:
    """``gid``, ``conv`` and a code: initial and fault."""
    visible = F.rtrim("text", F.lit(SPACE))
    marked = rows.select(
        "gid", "conv", "role", F.sha2("text", 256).alias("sha"), (visible == "").alias("blank"),
        (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("open"),
        (F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1).alias("initial"),
    ).withColumn("initial", F.when(F.col("initial").between(0, 2) & (F.col("role") != ""), F.col("initial")).otherwise(3))
    first = marked.groupBy("conv", "role", "sha").agg(F.min("gid").alias("gid")).select("gid", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED)
    return marked.join(first, "gid", "left").select(
        "gid", "conv", (F.col("initial") * 4 + fault.otherwise(FINE)).cast("byte").alias("code")
    )


def _segments(codes: pa.Table) -> list[tuple[object, int, bytes]]:
    """Runs of one conversation: its id, the first row's number, the codes."""
    codes = codes.sort_by("gid")
    convs, gids = codes.column("conv").to_pylist(), codes.column("gid").to_pylist()
    packed = codes.column("code").to_numpy().astype(np.uint8).tobytes()
    cuts = [k for k in range(len(convs)) if k == 0 or convs[k] != convs[k - 1]]
    return [(convs[a], gids[a], packed[a:b]) for a, b in zip(cuts, [*cuts[1:], len(convs)])]


def _matrices(codes: pa.Table) -> pa.Table:
    found = _segments(codes)
    return pa.table({
        "conv": pa.array([f[0] for f in found], codes.schema.field("conv").type),
        "gid": pa.array([f[1] for f in found], pa.int64()),
        "costs": pa.array([matrix(f[2]) for f in found], pa.list_(pa.float64())),
    })


def _costs_on(batches):
    """Costs from the end of each segment; the segments of a conversation come last first."""
    conv, costs, begun = None, CLOSING, False
    for batch in batches:
        ahead = []
        for c, m in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist()):
            if not begun or c != conv:
                conv, costs, begun = c, CLOSING, True
            ahead.append(list(costs))
            costs = tuple(min(m[4 * s + t] + costs[t] for t in range(4)) for s in range(4))
        yield pa.RecordBatch.from_arrays(
            [batch.column("gid"), pa.array(ahead, pa.list_(pa.float64()))], ["gid", "ahead"]
        )


def _audits(codes: pa.Table, ahead: pa.Table) -> pa.Table:
    costs = dict(zip(ahead.column("gid").to_pylist(), ahead.column("ahead").to_pylist()))
    found = _segments(codes)
    audits = least_audits([(packed, tuple(costs[gid])) for _, gid, packed in found]) if found else []
    return pa.table({
        "conv": pa.array([f[0] for f in found], codes.schema.field("conv").type),
        "gid": pa.array([f[1] for f in found], pa.int64()),
        "audits": pa.array(audits, pa.list_(pa.string())),
        "codes": pa.array([f[2] for f in found], pa.binary()),
    })


def _edits(conv_type, turn_type):
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches):
        names = ["conv_id", "place", "edit", "turn", "role", "text", "was_role", "fault"]
        types = [to_arrow_type(conv_type), pa.int64(), pa.string(), to_arrow_type(turn_type), *[pa.string()] * 4]
        conv, state, place, begun, letters, codes = None, START, 0, False, iter(""), iter(b"")
        out: list[tuple] = []

        def insert():
            nonlocal state, place
            state = NEXT[state]
            out.append((conv, place, "I", None, ROLE[state], "", None, None))
            place += 1

        def close():
            for _ in SUFFIX[state]:
                insert()

        def flush():
            columns = zip(*out) if out else [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), types)], names)
            out.clear()
            return made

        for batch in batches:
            for piece in pieces_of(batch, "text"):
                for row in piece.to_pylist():
                    if not begun or row["conv"] != conv:
                        if begun:
                            close()
                        conv, state, place, begun = row["conv"], START, 0, True
                    if row["audits"] is not None:
                        letters, codes = iter(row["audits"][state]), iter(row["codes"])
                        continue
                    initial, fault = divmod(next(codes), 4)
                    while (letter := next(letters)) == "I":
                        insert()
                    role = row["role"]
                    if letter != "D":
                        state = SYSTEM if letter == "K" and initial == 0 else NEXT[state]
                        role = ROLE[state] if letter == "R" else role
                    out.append((conv, place, letter, row["turn"], role, row["text"], row["role"], FAULTS[fault]))
                    place += 1
                yield flush()
        if begun:
            close()
            yield flush()

    return run


def summarise(edits: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair_conversations`: counts of the rows as they were, cost, audit, hash of the result.

    ``gaps`` is the number of missing turn numbers (of whole-number turns, 0 if all are null), ``illegal`` that of adjacent rows whose roles'
    initials are not ``su``, ``ua`` or ``au``, and ``repaired_sha256`` covers ``role:text`` of the turns that
    stay or come, joined by newlines. The edits must come as they were returned, which keeps their order.
    """
    conv = edits.schema["conv_id"].dataType
    schema = (
        f"conv_id {conv.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired_sha256 string"
    )
    return edits.mapInArrow(_summaries(conv), schema)


def _summaries(conv_type):
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches):
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        types = [to_arrow_type(conv_type), *[pa.int64()] * 6, pa.string(), pa.string()]
        now, out = None, []

        def table():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out)), types)], names)
            out.clear()
            return made

        for batch in batches:
            for piece in pieces_of(batch, "text"):
                for row in piece.to_pylist():
                    if now is None or row["conv_id"] != now.conv:
                        if now is not None:
                            out.append(now.row())
                        now = _Summary(row["conv_id"])
                    now.add(row)
                if out:
                    yield table()
        if now is not None:
            out.append(now.row())
            yield table()

    return run


class _Summary:
    """Running figures of one conversation."""

    def __init__(self, conv):
        self.conv, self.sha, self.audit, self.written = conv, hashlib.sha256(), bytearray(), False
        self.faults, self.illegal, self.cost = dict.fromkeys(FAULTS, 0), 0, 0
        self.before = self.low = self.high = None
        self.turns = 0

    def add(self, row: dict) -> None:
        edit, fault = row["edit"], row["fault"]
        self.audit += edit.encode()
        self.cost += COST[LETTERS.index(edit)] + (fault == "truncated" and edit != "D")
        if edit != "D":
            self.sha.update(b"\n" * self.written + f"{row['role']}:{row['text']}".encode())
            self.written = True
        if edit == "I":
            return
        self.faults[fault] += 1
        if self.before is not None and self.before + row["was_role"][:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = row["was_role"][:1]
        if (turn := row["turn"]) is not None:
            # Turns ascend.
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        f = self.faults
        return (
            self.conv, gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, self.cost, self.audit.decode(),
            self.sha.hexdigest(),
        )


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's.

    Null roles, texts, and ids in the hashed string, are one space.
    """
    spaced = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn))) % 20
    rows = df.select(
        col(conv_id).alias("conv_id"), col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"),
        harm.alias("harm"),
    ).where("harm <> 0")
    written: Column = F.when(F.col("harm") == 1, "").when(
        F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")
    ).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), written.alias("text"), times
    ).drop("col")
