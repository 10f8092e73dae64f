"""Byte streams whose units have different widths: characters of several bytes, escapes that are dropped, controls with operands.

The walk is one regular expression over the bytes: an alternation takes whole units a step and gives none back, so a byte
inside a unit is never taken for a control.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType


@dataclass(frozen=True)
class Widths:
    """How far a unit reaches, by its first byte.

    leads: (first, last, width) of characters of several bytes. dropped: escape to the number of bytes behind it that go with it.
    controls: byte that ends a run of text to the number of its operand bytes. Any other byte is a character of its own.
    """

    leads: tuple[tuple[int, int, int], ...] = ((0x81, 0x9F, 2), (0xE0, 0xFC, 2))
    dropped: dict[int, int] = field(default_factory=lambda: {0x1B: 1})
    controls: dict[int, int] = field(default_factory=lambda: {0x00: 0})

    @property
    def patterns(self) -> tuple[bytes, bytes]:
        """Of a run (its units in a first group; then a control with its operands, or the rest of a stream that ends inside a unit), and of its units (characters in a group)."""
        one = lambda b: rf"\x{b:02X}"
        wide = [(f"[{one(a)}-{one(z)}]", n) for a, z, n in self.leads]
        special = "".join(c[1:-1] for c, _ in wide) + "".join(map(one, [*self.dropped, *self.controls]))
        chars = "|".join([f"{c}.{{{n - 1}}}" for c, n in wide] + [f"[^{special}]++" if special else "."])
        drops = "|".join([f"{one(b)}.{{{n}}}" for b, n in self.dropped.items()] or ["(?!)"])
        controls = "|".join([f"{one(b)}.{{{n}}}" for b, n in self.controls.items()] or ["(?!)"])
        return f"(?s)((?:{chars}|{drops})*+)(?:({controls})|(.+))?".encode(), f"(?s)((?:{chars})++)|{drops}".encode()


_RUNS = ArrayType(StructType().add("place", LongType()).add("text", BinaryType()).add("control", BinaryType()).add("operands", BinaryType()).add("error", StringType()))


def mixed_width(streams: DataFrame, widths: Widths, key: str = "path", content: str = "content") -> DataFrame:
    """key, seq, place, text, control, operands, error: the runs of text, each with the control that ends it.

    place: where the run starts in the stream, in bytes. text: its bytes without escapes, to be decoded. control, operands: binary, null for
    the last run of a stream that ends in text. A stream that ends inside a unit gives `control` its first byte, `operands` what is there
    of the others, and an error. Null and empty streams have no rows. Nothing is shuffled.
    """
    patterns = widths.patterns

    @F.arrow_udf(_RUNS)
    def walk(content: pa.Array) -> pa.Array:
        run, units = map(re.compile, patterns)
        ends, place, text, control, operands, error = [0], [], [], [], [], []
        for data in content.to_pylist():
            for m in run.finditer(data or b""):
                if m.end() > m.start():
                    own, whole, cut = m.groups()
                    last = cut if whole is None else whole
                    place.append(m.start())
                    text.append(b"".join(units.findall(own)))
                    control.append(last and last[:1])
                    operands.append(last and last[1:])
                    error.append(cut and "ends inside a unit")
            ends.append(len(place))
        columns = [pa.array(place, pa.int64()), *(pa.array(x, pa.binary()) for x in (text, control, operands)), pa.array(error, pa.string())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, _RUNS.elementType.names))

    # explode() would have Spark filter by the array's size first, which walks the stream twice.
    rows = streams.select(key, F.posexplode_outer(walk(F.col(content))).alias("seq", "_r")).where("_r is not null")
    return rows.select(key, "seq", "_r.*")
