"""Delimited lines with quoting: good records typed, bad ones apart with the reason."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
#: csv reads these as the end of a record even where they are ordinary characters of a one-line record.
BREAKS = re.compile("[\r\n]")
#: Fields of any length are read; the limit holds for the process.
csv.field_size_limit(2**31 - 1)


def _quoted_well(line: str, sep: str) -> bool:
    """Whether every quote of the line opens, doubles inside, or closes a field that begins with a quote."""
    at, end = 0, len(line)
    while True:
        if line.startswith('"', at):
            at += 1
            while True:
                at = line.find('"', at)
                if at < 0:
                    return False
                if not line.startswith('"', at + 1):
                    break
                at += 2
            at += 1
            if at < end and line[at] != sep:
                return False
        else:
            stop = line.find(sep, at)
            stop = end if stop < 0 else stop
            if line.find('"', at, stop) >= 0:
                return False
            at = stop
        if at >= end:
            return True
        at += 1


def split_record(line: str, sep: str = "\t") -> list[str]:
    """Fields of one assembled record; ``csv.Error`` where the quoting is broken."""
    marks = None
    if BREAKS.search(line):
        marks = [c for c in map(chr, range(0xE000, 0xF900)) if c not in line][:2]
        if len(marks) < 2:
            raise csv.Error("no free placeholder for line breaks")
        line = line.replace("\r", marks[0]).replace("\n", marks[1])
    if '"' in line and not _quoted_well(line, sep):
        raise csv.Error("quote where none may stand")
    fields = next(csv.reader((line,), delimiter=sep, quotechar='"', doublequote=True, strict=True), []) or [""]
    if marks:
        fields = [f.replace(marks[0], "\r").replace(marks[1], "\n") for f in fields]
    return fields


def to_number(text: str) -> float | None:
    """The finite number that a text without its outer spaces is; None if it is none."""
    text = text.strip(" ")
    if not NUMBER.fullmatch(text):
        return None
    value = float(text)
    return value if abs(value) != float("inf") else None


def parse_record(line: str | None, sep: str = "\t") -> tuple[str | None, float | None, str | None]:
    """(key, value, reason) of a line; reason is None for a good one."""
    if line is None:
        return None, None, "columns"
    if line.endswith("\r"):
        line = line[:-1]
    try:
        fields = split_record(line, sep)
    except csv.Error:
        return None, None, "quoting"
    if len(fields) != 2:
        return None, None, "columns"
    value = to_number(fields[1])
    if not fields[0].strip(" ") or value is None:
        return None, None, "value"
    return fields[0], value, None


def parse_scores(lines: DataFrame, key: str = "line_id", line: str = "line", sep: str = "\t") -> DataFrame:
    """Parse two-field score lines into ``(<key>, b STRING, y DOUBLE, reason STRING)``, one row per input row.

    Good lines have a null ``reason``; bad ones have null ``b`` and ``y`` and the first reason that applies: ``quoting``
    (an open quote, text behind a closing quote, a quote inside an unquoted field), ``columns`` (not two fields), ``value`` (blank b,
    or y isn't a finite decimal number). Each row is one record, so a quoted field can't go on in the next row. One carriage
    return at the end is dropped; other line breaks are ordinary characters. A null line has no fields (``columns``), an empty line one
    (``columns``). Repeated rows give repeated rows, a null key stays null, other columns are left out, very long lines are read
    whole. A number beyond the range of a double isn't finite (``value``).
    """
    kind = lines.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("b", T.StringType()), T.StructField("y", T.DoubleType()), T.StructField("reason", T.StringType())])
    if len(set(schema.names)) < 4:
        raise ValueError(f"the key column can't be named {key}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_record(x, sep) for x in batch.column(1).to_pylist()]
            b, y, reason = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b, pa.string()), pa.array(y, pa.float64()), pa.array(reason, pa.string())], names=schema.names)

    return lines.select(key, line).mapInArrow(run, schema)


def failed_lines(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    return parsed.where("reason is not null").select(key, "reason")


def good_scores(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    return parsed.where("reason is null").select(key, "b", "y")
