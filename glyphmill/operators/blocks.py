"""Scripts whose blocks are told by indents: logical lines, parents, ends, and blocks to skip."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Signs(NamedTuple):
    """What a script's lines are read by. An empty string switches a rule off."""

    tab: int = 4
    comment: str = "#"
    quotes: str = "\"'"
    opening: str = "([{"
    closing: str = ")]}"


#: Lines that a task hands on at once.
HANDED = 20_000


def logical_lines(text: str, signs: Signs) -> Iterator[tuple[int, int, int, str]]:
    """First and last number, indent and text of each logical line: open brackets and quotes go on in the next line; comments and blank lines are none."""
    first = indent = depth = 0
    parts: list[str] = []
    quote = ""
    for number, line in enumerate(text.split("\n"), 1):
        body = line.strip(" \t\r")
        if not first:
            if not body or signs.comment and body.startswith(signs.comment):
                continue
            margin = line[: len(line) - len(line.lstrip(" \t"))]
            first, indent = number, len(margin) + margin.count("\t") * (signs.tab - 1)
        at = 0
        while at < len(body):
            c = body[at]
            if quote and c == "\\":
                at += 2
            elif quote and body.startswith(quote, at):
                at, quote = at + len(quote), ""
            elif quote:
                at += 1
            elif signs.comment and body.startswith(signs.comment, at):
                body = body[:at].rstrip(" \t")
            elif c in signs.quotes:
                quote = 3 * c if body.startswith(3 * c, at) else c
                at += len(quote)
            else:
                depth = max(0, depth + (c in signs.opening) - (c in signs.closing))
                at += 1
        parts.append(body)
        if not depth and not quote:
            yield first, number, indent, " ".join(x for x in parts if x)
            first, parts = 0, []
    if first:
        yield first, number, indent, " ".join(x for x in parts if x)


def nested(text: str, signs: Signs, skip: Collection[str]) -> Iterator[list]:
    """[first, last, indent, line, parent, depth, end, skipped] of each logical line. The open blocks are a stack of growing indents."""
    stack: list[list] = []
    last = 0
    for own_first, own_last, indent, line in logical_lines(text, signs):
        while stack and stack[-1][2] >= indent:
            stack[-1][6] = last
            yield stack.pop()
        above = stack[-1] if stack else None
        head = re.match("[A-Za-z0-9_]*", line)[0]
        stack.append([own_first, own_last, indent, line, above and above[0], len(stack), None, bool(above and above[7]) or head in skip])
        last = own_last
    while stack:
        stack[-1][6] = last
        yield stack.pop()


def indent_blocks(documents: DataFrame, skip: Collection[str] = (), signs: Signs = Signs(), key: str = "doc_id") -> DataFrame:
    """key, line_no, last_no, indent, line, parent, depth, block_end, skipped: the logical lines of documents(key, text).

    A line's parent is the last one before it with a smaller indent (null: none), its depth the number of those above it, and its block
    ends with the last line below it.  `skipped` are lines that begin with a word of `skip`, with their blocks.
    Rows come in the order in which blocks end.  A null text has no lines; a quote or bracket that never closes ends with the text.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
    names = ("line_no", "last_no", "indent", "line", "parent", "depth", "block_end", "skipped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []

            def handed() -> pa.RecordBatch:
                cols = [pa.array(keys, batch.schema.field("key").type), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))]
                return pa.RecordBatch.from_arrays(cols, names=["key", *names])

            for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for row in nested(text or "", signs, skip):
                    keys.append(k)
                    rows.append(row)
                    if len(rows) == HANDED:
                        yield handed()
                        keys, rows = [], []
            yield handed()

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"key {kind}, line_no long, last_no long, indent int, line string, parent long, depth int, block_end long, skipped boolean")
    return out.withColumnRenamed("key", key)
