"""Objects of one array of a single JSON document, read by many tasks.

Spark's text reader cuts the file at every closing brace and deals the pieces out by byte blocks, so a piece
ends where an object may end. Whether that brace closes an object or stands in a string, and at which depth,
depends on all that comes before. That is a prefix scan over blocks: a first pass gives for each block how it
changes the two states (inside a string or not) and the depth, a second, with those known, in which array it
ends; one short row per block reaches the driver, whose answer goes back as the state in which each block begins.
The last pass emits the objects. One that crosses a block's end is emitted in parts, which are joined by the
number of the object. What it emits is stored, so the document is read three times however often the objects are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_ledger.functions.materialize import materialize

_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)  # the rest of a string and its closing quote
_MARKS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{\[\]]', re.DOTALL)  # a string, closed or cut off, or a bracket
Start = tuple[bool, int, bool]  # inside a string, depth, inside the wanted array


def _marks(piece: str, in_string: bool) -> tuple[list[tuple[str, int]], bool]:
    """Brackets of a piece that stand outside strings, with their places, and whether it ends inside a string."""
    found, at = [], 0
    if in_string:
        rest = _STRING.match(piece)
        if rest is None:
            return found, True
        at = rest.end()
    for mark in _MARKS.finditer(piece, at):
        if mark[0][0] != '"':
            found.append((mark[0], mark.start()))
        elif not mark[1]:
            return found, True
    return found, False


def _depth(marks: list[tuple[str, int]], in_string: bool) -> int:
    """Change of depth over a piece, the brace that follows it included."""
    return sum(-1 if m == "]" else 1 for m, _ in marks) - (not in_string)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for file, block, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            yield (file, block), piece


def _by_block(batches: Iterator[pa.RecordBatch], begin: Callable, step: Callable) -> Iterator[tuple]:
    """``step(state, piece)`` over the pieces of each block, from ``begin(block)``: (file, block, last state)."""
    at, state = None, None
    for block, piece in _runs(batches):
        if block != at:
            if at is not None:
                yield (*at, state)
            at, state = block, begin(block)
        state = step(state, piece)
    if at is not None:
        yield (*at, state)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, from outside and from inside a string: where it ends and its change of depth."""
    def step(state, piece):
        out = []
        for in_string, depth in state:
            marks, ends = _marks(piece, in_string)
            out.append((ends, depth + _depth(marks, ends)))
        return out

    for file, block, ((e0, d0), (e1, d1)) in _by_block(batches, lambda _: [(False, 0), (True, 0)], step):
        yield _row(file=file, block=block, e0=e0, d0=d0, e1=e1, d1=d1)


def _row(**values) -> pa.RecordBatch:
    types = {str: pa.string(), int: pa.int64(), bool: pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([v], types[type(v)]) for v in values.values()], list(values))


class _Walk:
    """The array at depth two that a place lies in, and the objects at depth three of the wanted one."""

    def __init__(self, start: Start, key: str) -> None:
        self.in_string, self.depth, self.wanted = start
        self.named = re.compile(rf'"{re.escape(key)}"\s*:\s*$')
        self.parts: list[str] = []
        self.open = self.wanted and self.depth > 2  # an object goes on here
        self.begun = False  # in this block

    def step(self, piece: str, emit: Callable | None = None) -> None:
        marks, ends = _marks(piece, self.in_string)
        start = 0
        for mark, at in marks:
            if mark == "[" and self.depth == 1:
                self.wanted = self.named.search(piece, 0, at) is not None
            elif mark == "]" and self.depth == 2:
                self.wanted = False
            elif mark == "{" and self.depth == 2 and self.wanted:
                self.open, self.begun, start = True, True, at
            self.depth += -1 if mark == "]" else 1
        self.in_string = ends
        if self.open and emit:
            self.parts.append(piece[start:])
        if not ends:
            self.depth -= 1
            if self.open and self.depth == 2:
                if emit:
                    emit("whole" if self.begun else "end", "}".join(self.parts) + "}")
                self.parts, self.open, self.begun = [], False, False


def document_objects(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row (object: JSON text) for each object of the array under ``key`` of the document(s) at ``path``."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = pieces.mapInArrow(_effects, "file string, block long, e0 boolean, d0 long, e1 boolean, d1 long").collect()
    begins: dict[tuple[str, int], Start] = {}
    file = None
    for r in sorted(effects):
        if r["file"] != file:
            file, in_string, depth = r["file"], False, 0
        begins[r["file"], r["block"]] = (in_string, depth, False)
        in_string, depth = (r["e1"], depth + r["d1"]) if in_string else (r["e0"], depth + r["d0"])

    sent = spark.sparkContext.broadcast(begins)

    def arrays(batches):
        def step(walk, piece):
            walk.step(piece)
            return walk

        def begin(block):
            in_string, depth, _ = sent.value[block]
            walk = _Walk((in_string, depth, False), key)
            walk.wanted = None  # not known, unless an array begins or ends here
            return walk

        for file, block, walk in _by_block(batches, begin, step):
            yield _row(file=file, block=block, told=walk.wanted is not None, wanted=bool(walk.wanted))

    told = pieces.mapInArrow(arrays, "file string, block long, told boolean, wanted boolean").collect()
    file = None
    for r in sorted(told):
        if r["file"] != file:
            file, wanted = r["file"], False
        begins[r["file"], r["block"]] = (*begins[r["file"], r["block"]][:2], wanted)
        wanted = r["wanted"] if r["told"] else wanted
    known = spark.sparkContext.broadcast(begins)

    def objects(batches):
        out: list[tuple] = []

        def begin(block):
            return _Walk(known.value[block], key)

        def step(walk, piece):
            walk.step(piece, lambda kind, text: out.append((kind, text)))
            return walk

        at, walk = None, None
        for block, piece in _runs(batches):
            if block != at:
                yield from _parts(at, walk, out)
                at, walk, out[:] = block, begin(block), []
            step(walk, piece)
            if len(out) >= 1000:
                yield from _parts(at, None, out)
                out[:] = []
        yield from _parts(at, walk, out)

    parts = materialize(pieces.mapInArrow(objects, "file string, block long, kind string, object string"))
    # An object that goes on over a block's end: its parts follow each other, from a "begin" to the next "end".
    ends = parts.filter("kind <> 'whole'").select("file", "block", "kind").collect()  # two rows a block at most
    order = {"end": 0, "middle": 1, "begin": 2}
    rows, number = [], 0
    for r in sorted(ends, key=lambda r: (r["file"], r["block"], order[r["kind"]])):
        number += r["kind"] == "begin"
        rows.append((r["file"], r["block"], r["kind"], number))
    whole = parts.filter("kind = 'whole'").select("object")
    if not rows:
        return whole
    numbers = spark.createDataFrame(rows, "file string, block long, kind string, number long")
    text = F.sort_array(F.collect_list(F.struct("block", "object")))
    joined = (parts.filter("kind <> 'whole'").join(numbers, ["file", "block", "kind"]).groupBy("number")
              .agg(text.alias("p")).select(F.array_join(F.col("p.object"), "").alias("object")))
    return whole.unionByName(joined)


def _parts(at: tuple[str, int] | None, walk: _Walk | None, out: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The objects of a block so far; with ``walk`` at its end, also the part that goes on in the next."""
    rows = list(out)
    if walk is not None and walk.open:
        rows.append(("begin" if walk.begun else "middle", "}".join(walk.parts) + "}"))
    if rows:
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()),
                                          pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])],
                                         ["file", "block", "kind", "object"])
