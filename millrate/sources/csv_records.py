"""CSV files read in byte ranges, whatever line ends stand inside quotes.

Spark's text source splits a file at line ends, so one large file uses all
cores; but a range can begin inside a quoted field.  A line maps the state in
which it is entered (at a record's start, or inside quotes) to the state it leaves
behind, and so does a range of lines, by composition.

1. Each range's map is found on its own: a row per range.
2. The maps of a file's ranges are composed in order: the state in which each
   range is entered.
3. Each range is cut into records from that state.  Of a record that crosses
   ranges each has a piece; a file's pieces, two a range at most, are joined.

Every file is read by its own header: ``header`` comes with each row.  Records are
those of Python's csv module with default settings; an empty field without
quotes is NULL, and records without a character are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrate.session import cut_lineage

RECORD, QUOTED = 0, 1
_WHOLE, _END, _START = 0, 1, 2  # kinds of pieces: of one range, ending one, starting one


def state_after(line: str, state: int) -> int:
    """The state behind a line that is entered in ``state``."""
    at = 0
    while True:
        if state == RECORD:  # at the start of a field
            if line.startswith('"', at):
                at, state = at + 1, QUOTED
            else:
                comma = line.find(",", at)
                if comma < 0:
                    return RECORD
                at = comma + 1
                continue
        quote = line.find('"', at)
        if quote < 0:
            return QUOTED
        if line.startswith('"', quote + 1):
            at = quote + 2
            continue
        comma = line.find(",", quote + 1)  # behind the closing quote quotes are plain
        if comma < 0:
            return RECORD
        at, state = comma + 1, RECORD


def split_record(record: str) -> list[str | None]:
    """The fields of a record; NULL: empty without quotes."""
    if '"' not in record:
        return [x or None for x in record.split(",")]
    out: list[str | None] = []
    at, n = 0, len(record)
    while True:
        value, quoted = "", record.startswith('"', at)
        if quoted:
            at += 1
            while True:
                quote = record.find('"', at)
                if quote < 0:
                    value, at = value + record[at:], n
                    break
                value += record[at:quote]
                at = quote + 1
                if not record.startswith('"', at):
                    break
                value, at = value + '"', at + 1
        comma = record.find(",", at)
        value += record[at:] if comma < 0 else record[at:comma]
        out.append(value if value or quoted else None)
        if comma < 0:
            return out
        at = comma + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], pa.RecordBatch]]:
    """(file, range), lines of each batch's stretches of one range."""
    for batch in batches:
        file = batch.column("file").dictionary_encode()
        codes, blocks = file.indices.to_numpy(), batch.column("block").to_numpy()
        start = 0
        for end in range(1, batch.num_rows + 1):
            if end == batch.num_rows or codes[end] != codes[start] or blocks[end] != blocks[start]:
                part = batch.slice(start, end - start)
                yield (file.dictionary[codes[start]].as_py(), int(blocks[start])), part.column("value").to_pylist(), part
                start = end


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _unmarked(line: str, block: int, first: bool) -> str:
    """Without the byte order mark that can stand before a file's first line."""
    return line.removeprefix("﻿") if first and not block else line


def _range_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, the states behind the range by the state before it, and the
    first record of a file's first range."""
    now: tuple[str, int] | None = None
    state, header, open_ = [RECORD, QUOTED], [], True

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"file": [now[0]], "block": [now[1]], "from_record": [state[0]], "from_quoted": [state[1]],
             "header": [None if now[1] else "\n".join(header)]},
            schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_record", pa.int32()),
                              ("from_quoted", pa.int32()), ("header", pa.string())]))

    for key, lines, _ in _runs(batches):
        if key != now:
            if now:
                yield row()
            now, state, header, open_ = key, [RECORD, QUOTED], [], True
        for i, line in enumerate(lines):
            if open_ and not key[1]:
                line = _unmarked(line, key[1], not header)
                if line or header:
                    header.append(line)
            if '"' in line:
                state = [state_after(line, s) for s in state]
            open_ = open_ and (state[0] == QUOTED or not header)
    if now:
        yield row()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, at (a record's place in its file's order), kind, fields of
    whole records, text of other pieces."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()),
                        ("fields", pa.list_(pa.string())), ("text", pa.string())])
    now: tuple[str, int] | None = None
    held: list[str] = []       # of a record that isn't complete
    kind, state, n = _WHOLE, RECORD, 0
    for key, lines, part in _runs(batches):
        out: list[tuple] = []
        if key != now:
            if held:  # the last range's record goes on in the next one
                out.append((now[0], now[1], now[1] + n, _START if kind == _WHOLE else _END, None, "\n".join(held)))
            entered = part.column("entered")[0].as_py()
            now, held, n, state = key, [], 0, entered
            kind = _END if entered == QUOTED else _WHOLE
            first = True
        for line in lines:
            line = _unmarked(line, key[1], first)
            first = False
            held.append(line)
            if '"' in line:
                state = state_after(line, state)
            if state == RECORD:
                record = "\n".join(held)
                held = []
                if kind == _END:
                    out.append((key[0], key[1], key[1], _END, None, record))
                elif record:
                    out.append((key[0], key[1], key[1] + n, _WHOLE, split_record(record), None))
                    n += 1
                kind = _WHOLE
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if held:
        row = (now[0], now[1], now[1] + n, _START if kind == _WHOLE else _END, None, "\n".join(held))
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, schema)], schema=schema)


def _split(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [split_record(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != column), pa.array(fields, pa.list_(pa.string()))],
                names=[*(c for c in batch.schema.names if c != column), "fields"])
    return run


def entered_states(maps: DataFrame) -> DataFrame:
    """file, block, entered: the composed maps of the ranges before each one."""
    ranges = maps.groupBy("file").agg(F.array_sort(F.collect_list(
        F.struct("block", "from_record", "from_quoted"))).alias("ranges"))  # a row per file
    step = F.aggregate(
        "ranges", F.struct(F.lit(RECORD).alias("state"), F.array().cast("array<int>").alias("seen")),
        lambda a, r: F.struct(
            F.when(a["state"] == RECORD, r["from_record"]).otherwise(r["from_quoted"]).alias("state"),
            F.concat(a["seen"], F.array(a["state"])).alias("seen")), lambda a: a["seen"])
    return ranges.select("file", F.explode(F.arrays_zip(
        F.col("ranges.block").alias("block"), step.alias("entered"))).alias("r")).select(
        "file", "r.block", "r.entered")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[str]]]:
    """(records, distinct headers).  Records: file, at (rising within a file),
    header and fields, arrays of strings."""
    lines = _lines(spark, path)
    maps = cut_lineage(lines.mapInArrow(
        _range_maps, "file string, block long, from_record int, from_quoted int, header string"), "csv-ranges")
    inside = entered_states(maps).filter(F.col("entered") == QUOTED)  # at most a row per range read
    placed = lines.join(F.broadcast(inside), ["file", "block"], "left").select(
        "file", "block", "value", F.coalesce("entered", F.lit(RECORD)).alias("entered"))
    pieces = placed.mapInArrow(
        _pieces, "file string, block long, at long, kind int, fields array<string>, text string")
    whole = pieces.filter(F.col("kind") == _WHOLE).select("file", "at", "fields")
    # A record's pieces: the one that starts it and those before the next start.
    order = Window.partitionBy("file").orderBy("block", "kind")
    parts = pieces.filter(F.col("kind") != _WHOLE).withColumn(
        "record", F.sum(F.when(F.col("kind") == _START, 1).otherwise(0)).over(order))
    crossing = parts.groupBy("file", "record").agg(
        F.min("at").alias("at"),
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "kind", "text")))["text"], "\n").alias("text"))
    joined = crossing.select("file", "at", "text").mapInArrow(
        _split("text"), "file string, at long, fields array<string>")
    headers = maps.filter("block = 0").select("file", F.col("header").alias("text")).mapInArrow(
        _split("text"), "file string, fields array<string>").select("file", F.col("fields").alias("header"))
    headers = cut_lineage(headers, "csv-headers")
    kinds = [r["header"] for r in headers.select("header").distinct().collect()]
    return whole.unionByName(joined).filter(F.col("at") > 0).join(headers, "file"), kinds


def field(name: str):
    """The column ``name`` of a row by its own file's header (NULL: not there)."""
    return F.get("fields", (F.array_position("header", F.lit(name)) - 1).cast("int"))
