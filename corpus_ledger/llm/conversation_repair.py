"""Repair of conversation structure: the cheapest edits that make the roles read ``(s?(ua)+)?``.

A conversation's rows pass an automaton of four states (nothing yet, after a system, a user, an assistant row).
Edits cost: Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit of a blank or repeated row), Insert an
empty row 5; a truncated row that is not deleted adds 5. Of equally cheap audits the ASCII-least is taken.

Hirschberg's divide and conquer finds them in linear space: costs run forward from the start and backward from
the end, meet in the middle in the state through which an optimal path passes, and both halves recurse. Forward
vectors also rank their states by the least audit that leads to each. That order is enough to choose among
optimal crossings: an audit of the first half ends with the edit of its last row, so none is the beginning of
another, and what follows cannot change their order.

A conversation may hold any share of all rows, so it is cut into blocks of ``BLOCK`` rows. A block's cost from
each state to each state is one small matrix; the same recursion runs over the matrices of up to ``BLOCK``
blocks, over the matrices of those, and so on, and its crossings come down again to the rows. No task holds
more than ``BLOCK`` rows or matrices of a conversation; only the hash of a repaired conversation, which is
sequential, reads its rows as a stream in one task.

Defined results: nulls in conv_id form a conversation of their own; null role or text is one space; rows of one
turn lie in the order of role and text, null turns first; a role counts by its first character; rows that
repeat role and text are repeats; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_ledger.llm.common import positions, stored

BLOCK = 1024
# Fixed values of the edits.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"  # initials by code 1, 2, 3, which are also the states they lead to; any other is code 0
LEGAL = {(1, 2), (2, 3), (3, 2)}
FAULTS = 3  # none, truncated, to be deleted

NEXT = (2, 2, 3, 2)  # the state after inserting into, or reroling in, each state
ROLE = {2: "user", 3: "assistant"}
TAIL = {0: 0, 1: 2, 2: 1, 3: 0}  # inserts that complete a conversation from each state

# A matrix has, per entry state, a tuple of (exit state, cost, rank of its audit among those of the entry state).
# A vector has, per state, (cost, rank) or None; its least cost is 0.


def _keeps(state: int, code: int) -> int | None:
    if code == 1:
        return 1 if state == 0 else None
    return code if code and NEXT[state] == code else None


def row_edits(code: int, fault: int) -> list[dict[int, tuple[int, str]]]:
    """Per entry state: exit state -> (cost, audit) of one row, inserts before it included."""
    out = []
    for entry in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, audit = entry, 0, ""
        for _ in range(3):  # two inserts lead to every state that inserts can lead to
            moves = [(state, COST["D"], "D")]
            if fault != 2:
                extra = TRUNCATED if fault == 1 else 0
                moves.append((NEXT[state], COST["R"] + extra, "R"))
                kept = _keeps(state, code)
                if kept is not None:
                    moves.append((kept, COST["K"] + extra, "K"))
            for leaves, price, edit in moves:
                best[leaves] = min(best.get(leaves, (1 << 30, "")), (cost + price, audit + edit))
            state, cost, audit = NEXT[state], cost + COST["I"], audit + "I"
        out.append(best)
    return out


EDITS = [row_edits(k // FAULTS, k % FAULTS) for k in range(4 * FAULTS)]


def _matrix(paths: list[dict[int, tuple]]) -> tuple:
    """Costs and ranks of (cost, something that orders audits) per entry and exit state."""
    out = []
    for exits in paths:
        order = {q: r for r, q in enumerate(sorted(exits, key=lambda q: exits[q][1]))}
        out.append(tuple((q, exits[q][0], order[q]) for q in sorted(exits)))
    return tuple(out)


ROWS = [_matrix(e) for e in EDITS]


def _unit(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def _step(vector: tuple, matrix: tuple) -> tuple[tuple, int]:
    best: dict[int, tuple[int, int, int]] = {}
    for entry, reached in enumerate(vector):
        if reached:
            for leaves, cost, rank in matrix[entry]:
                way = (reached[0] + cost, reached[1], rank)
                if leaves not in best or way < best[leaves]:
                    best[leaves] = way
    low = min(way[0] for way in best.values())
    order = {q: r for r, q in enumerate(sorted(best, key=lambda q: best[q][1:]))}
    return tuple((best[q][0] - low, order[q]) if q in best else None for q in range(4)), low


def _back(vector: tuple, matrix: tuple) -> tuple[tuple, int]:
    costs = [min((c + vector[q] for q, c, _ in exits if vector[q] is not None), default=None) for exits in matrix]
    low = min(c for c in costs if c is not None)
    return tuple(None if c is None else c - low for c in costs), low


class Walk:
    """Forward and backward vectors over matrices; a step once made is remembered, as a conversation has few."""

    def __init__(self) -> None:
        self.known: dict = {}

    def run(self, step, vector: tuple, matrices) -> tuple[tuple, int]:
        total = 0
        for matrix in matrices:
            key = (step, vector, matrix)
            if key not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[key] = step(vector, matrix)
            vector, low = self.known[key]
            total += low
        return vector, total

    def matrix(self, matrices: list[tuple]) -> tuple:
        """The matrix of several in a row."""
        paths = []
        for entry in range(4):
            vector, low = self.run(_step, _unit(entry), matrices)
            paths.append({q: (low + v[0], v[1]) for q, v in enumerate(vector) if v})
        return _matrix(paths)

    def crossings(self, matrices: list[tuple], entry: int, leaves: int) -> list[tuple[int, int]]:
        """Entry and exit state of each matrix on the audit-least optimal path from ``entry`` to ``leaves``."""
        if len(matrices) == 1:
            return [(entry, leaves)]
        mid = len(matrices) // 2
        ahead, _ = self.run(_step, _unit(entry), matrices[:mid])
        behind, _ = self.run(_back, tuple(0 if s == leaves else None for s in range(4)), reversed(matrices[mid:]))
        meet = min((s for s in range(4) if ahead[s] and behind[s] is not None),
                   key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))
        return self.crossings(matrices[:mid], entry, meet) + self.crossings(matrices[mid:], meet, leaves)


def _packed(matrix: tuple) -> list[int]:
    """Three numbers for each way: entry * 4 + exit, cost, rank."""
    return [n for p, exits in enumerate(matrix) for q, cost, rank in exits for n in (4 * p + q, cost, rank)]


def _unpacked(flat: list[int]) -> tuple:
    exits: list[list] = [[], [], [], []]
    for at in range(0, len(flat), 3):
        exits[flat[at] // 4].append((flat[at] % 4, flat[at + 1], flat[at + 2]))
    return tuple(tuple(e) for e in exits)


def _codes(letters: str) -> list[int]:
    return [ord(c) - 65 for c in letters]


def _illegal(codes: list[int]) -> int:
    return sum((a, b) not in LEGAL for a, b in zip(codes, codes[1:]))


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summary of each block of rows."""
    walk = Walk()
    for batch in batches:
        ways, head, last, illegal, n = [], [], [], [], []
        for letters in batch.column("rows").to_pylist():
            classes = _codes(letters)
            ways.append(_packed(walk.matrix([ROWS[k] for k in classes])))
            codes = [k // FAULTS for k in classes]
            head.append(codes[0]), last.append(codes[-1]), illegal.append(_illegal(codes)), n.append(len(codes))
        yield _summaries(batch, ways, head, last, illegal, n)


def _of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summary of each group of neighbouring blocks."""
    walk = Walk()
    for batch in batches:
        ways, head, last, illegal, n = [], [], [], [], []
        for parts in batch.column("parts").to_pylist():
            ways.append(_packed(walk.matrix([_unpacked(p["ways"]) for p in parts])))
            head.append(parts[0]["head"]), last.append(parts[-1]["last"]), n.append(sum(p["n"] for p in parts))
            between = sum((a["last"], b["head"]) not in LEGAL for a, b in zip(parts, parts[1:]))
            illegal.append(between + sum(p["illegal"] for p in parts))
        yield _summaries(batch, ways, head, last, illegal, n)


def _summaries(batch: pa.RecordBatch, ways, head, last, illegal, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("conv"), batch.column("block"), batch.column("first"), pa.array(ways, pa.list_(pa.int64())),
         pa.array(head, pa.int32()), pa.array(last, pa.int32()), pa.array(illegal, pa.int64()), pa.array(n, pa.int64())],
        ["conv", "block", "first", "ways", "head", "last", "illegal", "n"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations: the state in which the last row leaves them, what they cost, inserts at the end."""
    for batch in batches:
        best = []
        for flat in batch.column("ways").to_pylist():
            # By cost, then by the rank of what comes before the inserts at the end.
            best.append(min((cost + TAIL[q] * COST["I"], rank, q) for q, cost, rank in _unpacked(flat)[0]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("first"), pa.array([0] * len(best), pa.int32()),
             pa.array([q for _, _, q in best], pa.int32()), pa.array([c for c, _, _ in best], pa.int64()),
             batch.column("illegal"), batch.column("n")],
            ["conv", "first", "entry", "leaves", "cost", "illegal", "n"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = Walk()
    for batch in batches:
        first, entry, leaves = [], [], []
        for parts, p, q in zip(*(batch.column(c).to_pylist() for c in ("parts", "entry", "leaves"))):
            for part, (a, b) in zip(parts, walk.crossings([_unpacked(x["ways"]) for x in parts], p, q)):
                first.append(part["first"]), entry.append(a), leaves.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(entry, pa.int32()),
                                          pa.array(leaves, pa.int32())], ["first", "entry", "leaves"])


def _edits(audit: str, state: int, code: int) -> list[dict]:
    out = []
    for edit in audit:
        if edit in "IR":
            state = NEXT[state]
        elif edit == "K":
            state = _keeps(state, code)
        out.append({"edit": edit, "role": ROLE[state] if edit in "IR" else None})
    return out


def _of_each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of every row; the rows of a block follow each other without gaps."""
    walk = Walk()
    kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())]))
    for batch in batches:
        pos, edits = [], []
        for first, letters, p, q in zip(*(batch.column(c).to_pylist() for c in ("first", "rows", "entry", "leaves"))):
            classes = _codes(letters)
            for i, (k, (a, b)) in enumerate(zip(classes, walk.crossings([ROWS[k] for k in classes], p, q))):
                pos.append(first + i), edits.append(_edits(EDITS[k][a][b][1], a, k // FAULTS))
        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(edits, kind)], ["pos", "edits"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation, whose rows follow each other: one row at a time."""
    some, conv, audit, digest, lines = False, None, bytearray(), hashlib.sha256(), 0
    for batch in batches:
        done: list[tuple] = []
        for c, edit, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "edit", "role", "text"))):
            if some and c != conv:
                done.append((conv, audit.decode(), digest.hexdigest()))
                audit, digest, lines = bytearray(), hashlib.sha256(), 0
            some, conv = True, c
            audit += edit.encode()
            if edit != "D":
                digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
                lines += 1
        if done:
            yield _digest_rows(done, batch)
    if some:
        yield _digest_rows([(conv, audit.decode(), digest.hexdigest())], batch)


def _digest_rows(done: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
    conv, audit, digest = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(conv, batch.column("conv").type), pa.array(audit, pa.string()),
                                       pa.array(digest, pa.string())], ["conv", "audit", "repaired_sha256"])


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, pos) with blank, duplicate, truncated (the first fault only), code."""
    said = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    code = F.coalesce(*[F.when(initial == c, F.lit(i)) for i, c in enumerate(INITIALS, 1)], F.lit(0))
    marked = rows.select("conv", "pos", "turn", code.alias("code"), (said == "").alias("blank"),
                         (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("open"),
                         F.sha2(F.to_json(F.struct("conv", "role", "text")), 256).alias("h"))
    first = (marked.filter(~F.col("blank")).groupBy("h").agg(F.min("pos").alias("seen"), F.count(F.lit(1)).alias("times"))
             .filter("times > 1").select("h", "seen"))
    repeat = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("seen"), F.lit(False))
    return (marked.join(first, "h", "left").withColumn("duplicate", repeat)
            .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
            .select("conv", "pos", "turn", "code", "blank", "duplicate", "truncated"))


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The edits in order (conv, pos, step, edit, role, text: a deleted row has neither role nor text) and one row
    per conversation (conv, gaps, blank, duplicate, truncated, illegal, cost)."""
    space = F.lit(" ")
    rows, total = positions(conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"),
        F.coalesce(F.col(text_col), space).alias("text")), ["conv", "turn", "role", "text"], "pos")
    marked = stored(faults(rows), "faults")
    conv_type = dict(marked.dtypes)["conv"]
    kind = F.when(F.col("blank") | F.col("duplicate"), 2).when(F.col("truncated"), 1).otherwise(0)
    letter = F.char(F.col("code") * FAULTS + kind + 65)
    in_order = F.sort_array(F.collect_list(F.struct("pos", letter.alias("k"))))
    blocks = stored(marked.groupBy("conv", F.floor(F.col("pos") / block).alias("block"))
                    .agg(F.min("pos").alias("first"), in_order.alias("list"))
                    .select("conv", "block", "first", F.array_join(F.col("list.k"), "").alias("rows")), "blocks")
    summary = f"conv {conv_type}, block long, first long, ways array<long>, head int, last int, illegal long, n long"
    level = stored(blocks.mapInArrow(_of_rows, summary), "summaries")
    levels: list[DataFrame] = []
    size = block
    while size < total:  # until one group can hold every block of a conversation
        parts = F.sort_array(F.collect_list(F.struct("first", "ways", "head", "last", "illegal", "n")))
        groups = stored(level.groupBy("conv", F.floor(F.col("block") / block).alias("block"))
                        .agg(F.min("first").alias("first"), parts.alias("parts")), "groups")
        level = stored(groups.mapInArrow(_of_blocks, summary), "summaries")
        levels.append(groups)
        size *= block
    ends = stored(level.mapInArrow(_ends, f"conv {conv_type}, first long, entry int, leaves int, cost long, illegal long, n long"),
                  "ends")
    chosen = ends.select("first", "entry", "leaves")
    for groups in reversed(levels):
        chosen = stored(groups.select("first", "parts").join(chosen, "first")
                        .mapInArrow(_down, "first long, entry int, leaves int"), "crossings")
    edits = blocks.select("first", "rows").join(chosen, "first").mapInArrow(
        _of_each_row, "pos long, edits array<struct<edit:string,role:string>>")
    done = rows.select("conv", "pos", F.col("role").alias("was"), "text").join(edits, "pos").select(
        "conv", "pos", F.posexplode("edits").alias("step", "e"), "was", "text")
    kept = F.col("e.edit").isin("K", "R")
    done = done.select("conv", "pos", "step", F.col("e.edit").alias("edit"),
                       F.when(F.col("e.edit") == "K", F.col("was")).otherwise(F.col("e.role")).alias("role"),
                       F.when(kept, F.col("text")).when(F.col("e.edit") == "I", "").alias("text"))
    inserts = F.array_join(F.array_repeat(F.lit("I"), F.element_at(
        F.create_map(*[F.lit(x) for pair in TAIL.items() for x in pair]), F.col("leaves"))), "")
    # At the end at most a user and an assistant row are missing; they follow the last row's own edits.
    roles = [F.lit(ROLE[2]), F.lit(ROLE[3])]
    tail = ends.withColumn("inserts", F.length(inserts)).select(
        "conv", (F.col("first") + F.col("n") - 1).alias("pos"),
        F.explode(F.slice(F.array(*[F.struct(F.lit(100 + i).alias("step"), r.alias("role")) for i, r in enumerate(roles)]),
                          F.lit(3) - F.col("inserts"), F.col("inserts"))).alias("e"))
    tail = tail.select("conv", "pos", F.col("e.step").alias("step"), F.lit("I").alias("edit"), F.col("e.role").alias("role"),
                       F.lit("").alias("text"))
    return done.unionByName(tail), _summary(marked, ends)


def _summary(marked: DataFrame, ends: DataFrame) -> DataFrame:
    named = ["blank", "duplicate", "truncated"]
    turns = marked.groupBy("conv", "turn").agg(*[F.count_if(c).alias(c) for c in named])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("conv").agg(gaps.cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in named])
    return counts.join(ends.select(F.col("conv").alias("_conv"), "illegal", "cost"),
                       F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")


def digests(edits: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256 of the edits of ``repair_conversations``."""
    conv_type = dict(edits.dtypes)["conv"]
    return (edits.repartition("conv").sortWithinPartitions("conv", "pos", "step").select("conv", "edit", "role", "text")
            .mapInArrow(_digests, f"conv {conv_type}, audit string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that a hash of conversation and turn names; nulls are one space."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                                (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("_fate"))
    fate = F.col("_fate")
    text = (F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    edits, summary = repair_conversations(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [conversations.select(F.col("conv_id").alias("conv")).distinct(), summary, digests(edits)]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    out = rows.groupBy("conv").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
                                   F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                   F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return out.withColumnRenamed("conv", "conv_id")
