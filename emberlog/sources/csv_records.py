"""CSV records that go over several lines, read by all tasks: what a line does to an open quotation composes.

A file is read as physical lines, in chunks as Spark splits it. Whether a line begins inside a quoted field is unknown
until all text before it has been seen, but each line maps the two possible states to two states, and so does each
chunk. One pass gives a row for each chunk; composing these in order gives every chunk's true state, the number of its
first record, and the chunk in which a record began that it continues. The second pass cuts records at their true ends.
Records that cross chunks are put together by grouping them by the chunk where they began. Line ends inside quotes stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

#: Rows of the table of chunks up to which it is sent to all tasks: about 64 bytes each.
CHUNKS_SENT = 1 << 20


@lru_cache(maxsize=8)
def _patterns(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    d = re.escape(delimiter)
    # the rest of a quoted field, and what stands between its end and the next delimiter
    return re.compile(rf'(?:[^"]|"")*+"(?!")[^{d}]*'), re.compile(rf'{d}"')


def after(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one, or at the start of a record.

    A quotation mark opens a field only at its first character, two in a row stand for one, and what follows a closing
    mark up to the delimiter is as it is.
    """
    rest, opening = _patterns(delimiter)
    at = 0
    if not inside and not line.startswith('"'):
        found = opening.search(line)
        if not found:
            return False
        at = found.end()
    elif not inside:
        at = 1
    while True:
        closed = rest.match(line, at)
        if not closed:
            return True
        found = opening.search(line, closed.end())
        if not found:
            return False
        at = found.end()


class Chunk(NamedTuple):
    """What a chunk does from outside a quoted field, and from inside one."""

    file: int
    start: int
    outside: bool  # state at its end
    inside: bool
    records: int  # records that begin in it
    records_inside: int
    ends_inside: bool  # whether a record that was open before it ends in it


def _effects(lines: pa.Array, delimiter: str) -> tuple[np.ndarray, np.ndarray]:
    """State after each line from outside and from inside."""
    out, inn = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    for i in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist():
        line = lines[i].as_py()
        out[i], inn[i] = after(line, False, delimiter), after(line, True, delimiter)
    return out, inn


def _states(out: np.ndarray, inn: np.ndarray, first: bool) -> np.ndarray:
    """State before each line and after the last; lines without a mark change nothing from outside or inside."""
    state = np.empty(len(out) + 1, bool)
    state[0] = first
    # only lines whose effect is not that of a line without marks are walked
    at, now = 0, first
    for i in np.flatnonzero(out | ~inn).tolist():
        state[at + 1 : i + 1] = now
        now = bool(inn[i] if now else out[i])
        state[i + 1] = now
        at = i + 1
    state[at + 1 :] = now
    return state


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.less(pc.binary_length(pc.replace_substring_regex(lines, "\r$", "")), 1).to_numpy(zero_copy_only=False)


def _runs(rb: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(file, start, lines) of the stretches of a batch that come from one chunk."""
    file, start = rb.column(0).to_numpy(), rb.column(1).to_numpy()
    edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), rb.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield int(file[a]), int(start[a]), rb.slice(a, b - a)


def _measure(batches: Iterator[pa.RecordBatch], delimiter: str) -> Iterator[pa.RecordBatch]:
    """One row of ``Chunk`` for each chunk."""
    now: list | None = None

    def row(c: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([Chunk(*c)._asdict()], schema=_CHUNK_ARROW)

    for rb in batches:
        for file, start, part in _runs(rb):
            if now is None or now[:2] != [file, start]:
                if now:
                    yield row(now)
                now = [file, start, False, True, 0, 0, False]
            lines = part.column(2)
            out, inn = _effects(lines, delimiter)
            filled = ~_blank(lines)
            for k, state in ((2, _states(out, inn, now[2])), (3, _states(out, inn, now[3]))):
                begins = ~state[:-1] & (filled | state[1:])
                now[k + 2] += int(begins.sum())
                if k == 3:
                    now[6] = now[6] or not state.all()
                now[k] = bool(state[-1])
    if now:
        yield row(now)


_CHUNK = T.StructType([T.StructField("file", T.LongType()), T.StructField("start", T.LongType()), T.StructField("outside", T.BooleanType()), T.StructField("inside", T.BooleanType()), T.StructField("records", T.LongType()), T.StructField("records_inside", T.LongType()), T.StructField("ends_inside", T.BooleanType())])
_CHUNK_ARROW = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("records", pa.int64()), ("records_inside", pa.int64()), ("ends_inside", pa.bool_())])


def composed(chunks: list[Chunk]) -> list[tuple[int, int, bool, int, int]]:
    """(file, start, begins inside, number of its first record in the file, start of the chunk of the open record)."""
    told, file, inside, number, origin = [], None, False, 0, 0
    for c in sorted(chunks):
        if c.file != file:
            file, inside, number = c.file, False, 0
        told.append((c.file, c.start, inside, number, origin if inside else c.start))
        number += c.records_inside if inside else c.records
        # a record that is open at the end began here, unless the chunk lies within one record from before
        if not inside or c.ends_inside:
            origin = c.start
        inside = c.inside if inside else c.outside
    return told


def _cut(batches: Iterator[pa.RecordBatch], delimiter: str) -> Iterator[pa.RecordBatch]:
    """(file, origin, number, place, text, whole) of rows (file, start, value, begins inside, first number, origin).

    A record within a chunk is whole; the others are parts, in order by ``place``, the chunk in which a part stands.
    """
    names = ["file", "origin", "number", "place", "text", "whole"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    key, state, number, origin, held, here = None, False, 0, 0, [], True
    rows: list[tuple] = []

    def open_part() -> list[tuple]:
        """What is held at the end of a chunk is a part of a record that goes on."""
        return [(key[0], origin, number if here else -1, key[1], "\n".join(held), False)] if held else []

    for rb in batches:
        for file, start, part in _runs(rb):
            if key != (file, start):
                rows += open_part()
                key, state = (file, start), part.column(3)[0].as_py()
                number, origin, held, here = part.column(4)[0].as_py(), part.column(5)[0].as_py(), [], not state
            lines = part.column(2)
            out, inn = _effects(lines, delimiter)
            states, blank = _states(out, inn, state), _blank(lines)
            plain = ~states[:-1] & ~states[1:] & ~blank
            ends = states[:-1] & ~states[1:]
            text = lines.to_pylist()
            for i in np.flatnonzero(plain | states[:-1] | states[1:]).tolist():
                if plain[i]:
                    rows.append((file, start, number, start, text[i], True))
                    number += 1
                    continue
                if not states[i]:  # begins here and goes on
                    held, origin, here = [], start, True
                held.append(text[i])
                if ends[i]:
                    rows.append((file, origin, number if here else -1, start, "\n".join(held), here))
                    number += here
                    held, here = [], True
            state = bool(states[-1])
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if key:
        rows += open_part()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def lines_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, start, value): physical lines with the hash of their file's name and the place of their split in it."""
    raw = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding.upper().replace("-", "") in ("UTF8", "USASCII") else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("start"), value.alias("value"))


def records(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", sent: int = CHUNKS_SENT) -> DataFrame:
    """(file, number, text): the records of CSV files, numbered from 0 in each file; empty lines between them are none.

    The driver holds one row for each chunk. That table goes to all tasks up to ``sent`` rows, which bounds its size;
    a larger one meets the lines by a join on the chunk, after which a chunk's lines are put in order again.
    """
    store.ship(spark)
    lines = lines_of(spark, path, encoding)
    chunks = [Chunk(*r) for r in lines.mapInArrow(lambda it: _measure(it, delimiter), _CHUNK).collect()]
    told = spark.createDataFrame(composed(chunks), "c_file long, c_start long, begins boolean, number long, origin long")
    on = (F.col("file") == F.col("c_file")) & (F.col("start") == F.col("c_start"))
    if len(chunks) <= sent:
        met = lines.join(F.broadcast(told), on)
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id())
        met = placed.join(told.hint("merge"), on).sortWithinPartitions("file", "start", "at")
    met = met.select("file", "start", "value", "begins", "number", "origin")
    cut = met.mapInArrow(lambda it: _cut(it, delimiter), "file long, origin long, number long, place long, text string, whole boolean")
    crossing = cut.filter("NOT whole").groupBy("file", "origin").agg(F.max("number").alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    whole = cut.filter("whole").select("file", "number", "text")
    both = whole.unionByName(crossing.select("file", "number", "text"))
    return both.withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def read(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, encoding: str = "UTF-8", **options) -> DataFrame:
    """The columns of CSV files as text, with ``__file`` and ``__number``, a record's place in its file.

    Column names are those that Spark's own reader finds in the first record.
    """
    names = spark.read.option("sep", delimiter).option("header", header).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path).columns
    found = records(spark, path, delimiter, encoding, **options)
    if header:
        found = found.filter("number > 0")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    parsed = F.from_csv("text", F.lit(schema.toDDL()), {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true"})
    return found.select(parsed.alias("r"), "file", "number").select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], F.col("file").alias("__file"), F.col("number").alias("__number"))
