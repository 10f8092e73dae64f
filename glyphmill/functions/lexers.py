"""Table functions that turn a script or a record into rows."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql.functions import udtf

_ATTRIBUTE = re.compile(r"""([^\s=\[\]]+)\s*=\s*("[^"]*"|'[^']*'|[^\s\]]+)""")


def _partners(line: str, opening: str, closing: str) -> dict[int, int]:
    """Place of each opening bracket to that of its closing one."""
    held, out = [], {}
    for m in re.finditer(f"[{re.escape(opening + closing)}]", line):
        if m[0] == opening:
            held.append(m.start())
        elif held:
            out[held.pop()] = m.start()
    return out


def tag_spans(text: str, opening: str = "[", closing: str = "]") -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of texts and tags, line by line; line ends stand in neither.

    Brackets nest.  A tag without a partner ends at the next closing bracket of its line, and takes the rest of the line if there is none.
    """
    base = 0
    for line in text.split("\n"):
        partners, done = _partners(line, opening, closing), 0
        for at in (m.start() for m in re.finditer(re.escape(opening), line)):
            if at < done:
                continue
            if at > done:
                yield base + done, base + at, "text"
            end = partners.get(at, line.find(closing, at)) + 1
            done = end or len(line)
            yield base + at, base + done, "tag" if end else "cut"
        if done < len(line):
            yield base + done, base + len(line), "text"
        base += len(line) + 1


@udtf(returnType="pos int, kind string, name string, attributes map<string,string>, value string, start int, end int")
class TagTokens:
    """The tokens of a bracket-tag script, in order, with their places; `cut` tags are never closed."""

    def eval(self, text: str):
        for pos, (a, b, kind) in enumerate(tag_spans(text or "")):
            inner = text[a + 1 : b - 1].strip() if kind == "tag" else text[a + 1 : b].strip() if kind == "cut" else ""
            name = inner.split(None, 1)[0] if inner else None
            attributes = {k: v.strip("\"'") for k, v in _ATTRIBUTE.findall(inner[len(name or "") :])}
            yield pos, kind, name, attributes, text[a:b] if kind == "text" else None, a, b


@udtf(returnType="pos int, kind string, value string")
class LineScript:
    """A line-oriented script: labels, comments, commands, and text with its wait (@) and page (\\\\) marks."""

    def eval(self, text: str):
        pos = 0
        for line in (text or "").split("\n"):
            line = line.strip()
            if not line or line[0] == ";":
                continue
            if line[0] == "*":
                events = [("label", line[1:])]
            elif re.match(r"[A-Za-z_%$?!]", line):
                events = [("command", line)]
            else:
                events = [(p, "") if p in ("@", "\\") else ("text", p) for p in re.split(r"([@\\])", line) if p]
            for kind, value in events:
                yield pos, kind, value
                pos += 1


@udtf(returnType="off int, op int, operands array<string>, error string")
class OpcodeWalk:
    """Instructions of a byte stream by a table of operand kinds per opcode.

    `table`: opcode in hex, a colon, and kinds (b, h, i: 1, 2, 4 bytes; s: text up to a zero), with blanks between.
    The walk ends with a row that tells the place and the reason where the bytes don't fit.
    """

    def eval(self, content: bytes, table: str):
        ops = {int(k, 16): kinds for k, _, kinds in (x.partition(":") for x in table.split())}
        i, data = 0, bytes(content or b"")
        while i < len(data):
            off, op = i, data[i]
            if op not in ops:
                yield off, op, None, "unknown opcode"
                return
            i, values = i + 1, []
            for kind in ops[op]:
                if kind == "s":
                    end = data.find(b"\0", i)
                    value, i = (data[i:end].decode("cp932", "replace"), end + 1) if end >= 0 else (None, len(data) + 1)
                else:
                    n = {"b": 1, "h": 2, "i": 4}[kind]
                    value, i = str(int.from_bytes(data[i : i + n], "little")), i + n
                values.append(value)
            if i > len(data):
                yield off, op, None, "cut operand"
                return
            yield off, op, values, None


@udtf(returnType="off int, encoding string, text string")
class PrintableRuns:
    """Runs of printable characters of `least` or more, as ASCII, CP932 and UTF-16."""

    PATTERNS = (
        ("ascii", re.compile(rb"[\x20-\x7e\t]{2,}")),
        ("cp932", re.compile(rb"(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\x20-\x7e]){2,}")),
        ("utf-16-le", re.compile(rb"(?:[\x20-\x7e]\x00|[\x00-\xff][\x30-\x9f]){2,}")),
    )

    def eval(self, content: bytes, least: int):
        for encoding, pattern in self.PATTERNS:
            for m in pattern.finditer(bytes(content or b"")):
                text = m[0].decode(encoding, "replace")
                if len(text) >= least:
                    yield m.start(), encoding, text


def directory_entries(data: bytes, start: int, layout: str) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset, stored size, raw size) of a directory: count, then fixed-width records, as far as they are there.

    `layout`: name_bytes,field kinds in order (n: name, o: offset, s: stored size, r: raw size, u: unused 4 bytes),byte order (< or >)
    """
    if len(data) < start + 4:
        return
    width, fields, order = layout.split(",")
    (count,) = struct.unpack_from(order + "I", data, start)
    record = struct.Struct(order + "".join(f"{width}s" if f == "n" else "I" for f in fields))
    there = min(count, (len(data) - start - 4) // record.size)
    for values in record.iter_unpack(data[start + 4 : start + 4 + there * record.size]):
        row = dict(zip(fields, values))
        yield row["n"].split(b"\0")[0].decode("cp932", "replace"), row["o"], row["s"], row.get("r", row["s"])


@udtf(returnType="name string, off long, stored long, raw long")
class DirectoryEntries:
    """Entries of a simple archive directory, by a declared layout (see directory_entries)."""

    def eval(self, content: bytes, start: int, layout: str):
        yield from directory_entries(bytes(content or b""), start, layout)


@udtf(returnType="name string, raw long, piece binary, short boolean")
class MemberBytes:
    """The stored bytes of every entry of a directory, whose offsets count from `base`; `short` ones reach past the end."""

    def eval(self, content: bytes, start: int, layout: str, base: int):
        data = bytes(content or b"")
        for name, off, stored, raw in directory_entries(data, start, layout):
            piece = data[off + base : off + base + stored]
            yield name, raw, piece, len(piece) < stored
