"""Bytes to bytes and bytes to text, in Arrow batches.

Each decoder gives a struct of the value and an error, so bytes that don't decode are
told apart from those that do; nothing is passed on raw in silence.
"""

from __future__ import annotations

import gzip
import lzma
import unicodedata
import zlib

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

DECODED = StructType([StructField("data", BinaryType()), StructField("error", StringType())])
TEXT = StructType([StructField("text", StringType()), StructField("encoding", StringType()), StructField("error", StringType())])


def _inflate(data: bytes) -> bytes:
    """zlib, or a raw deflate stream."""
    try:
        return zlib.decompress(data)
    except zlib.error:
        return zlib.decompress(data, -15)


def lz4_block(data: bytes) -> bytes:
    """One raw LZ4 block: tokens of literal and match lengths, two-byte distances."""
    out, i = bytearray(), 0

    def length(n: int, i: int) -> tuple[int, int]:
        while n >= 15:
            more = data[i]
            i, n = i + 1, n + more
            if more != 255:
                break
        return n, i

    while i < len(data):
        token = data[i]
        n, i = length(token >> 4, i + 1)
        out += data[i : i + n]
        i += n
        if i >= len(data):
            break
        back = int.from_bytes(data[i : i + 2], "little")
        n, i = length(token & 15, i + 2)
        if not 0 < back <= len(out):
            raise ValueError("distance outside the window")
        for _ in range(n + 4):
            out.append(out[-back])
    return bytes(out)


def lzss(data: bytes, offset_bits: int = 12, least: int = 3, start: int | None = None, fill: int = 0) -> bytes:
    """LZSS with flag bytes from the lowest bit (1: literal) and two-byte matches into a ring buffer."""
    size = 1 << offset_bits
    longest = (1 << (16 - offset_bits)) - 1 + least
    ring, at, out, i = bytearray([fill]) * size, size - longest if start is None else start, bytearray(), 0
    while i < len(data):
        flags, i = data[i], i + 1
        for bit in range(8):
            if i >= len(data):
                break
            if flags >> bit & 1:
                piece = data[i : i + 1]
                i += 1
                out += piece
                ring[at] = piece[0]
                at = (at + 1) % size
                continue
            if i + 1 >= len(data):
                raise ValueError("cut match")
            a, b = data[i], data[i + 1]
            i += 2
            place, n = a | (b >> (16 - offset_bits)) << 8, (b & longest - least) + least
            for k in range(n):
                c = ring[(place + k) % size]
                out.append(c)
                ring[at] = c
                at = (at + 1) % size
    return bytes(out)


_DECODERS = {"zlib": _inflate, "deflate": _inflate, "gzip": gzip.decompress, "lzma": lzma.decompress, "zstd": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b), "lz4": lz4_block, "lzss": lzss, "": bytes}


@F.pandas_udf(DECODED)
def decompress(data: pd.Series, codec: pd.Series) -> pd.DataFrame:
    """(data, error) of bytes by the name of their codec; an empty name copies."""
    rows = []
    for b, c in zip(data, codec):
        try:
            rows.append((None, None) if b is None else (_DECODERS[c or ""](bytes(b)), None))
        except KeyError:
            rows.append((None, f"unknown codec {c}"))
        except Exception as e:  # decoders raise many kinds; all are told in the row
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["data", "error"])


def translate_bytes(table: bytes):
    """A function of a binary column that maps each byte by a table of 256."""

    @F.pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else bytes(b).translate(table))

    return run


def xor_table(key: int) -> bytes:
    return bytes(b ^ key for b in range(256))


def rotate_table(bits: int) -> bytes:
    """Rotation to the left by `bits`."""
    return bytes((b << bits | b >> (8 - bits)) & 255 for b in range(256))


def nibble_table() -> bytes:
    return rotate_table(4)


def _guess(b: bytes) -> str:
    if b.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    # A quarter of zero bytes: two-byte text without a mark.
    if b and b.count(0) > len(b) / 4:
        return "utf-16-le"
    try:
        b.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "cp932"


@F.pandas_udf(TEXT)
def decode_text(data: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    """(text, encoding, error); a null encoding is guessed from marks, zero bytes and validity."""
    rows = []
    for b, e in zip(data, encoding):
        if b is None:
            rows.append((None, None, None))
            continue
        name = e or _guess(bytes(b))
        try:
            rows.append((bytes(b).decode(name), name, None))
        except (UnicodeDecodeError, LookupError) as x:
            rows.append((None, name, str(x)))
    return pd.DataFrame(rows, columns=["text", "encoding", "error"])


@F.pandas_udf(StringType())
def decode_table(codes: pd.Series, table: pd.Series) -> pd.Series:
    """Arrays of codes to text by a string whose n-th character is code n; unknown codes show as <hex>."""
    return pd.Series([None if c is None else "".join(t[k] if 0 <= k < len(t) else f"<{k:04X}>" for k in c) for c, t in zip(codes, table)], dtype=object)


@F.pandas_udf(StringType())
def normalise(text: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form)], dtype=object)


def byte_entropy(c: Column) -> Column:
    """Bits per byte of a binary column, inside the JVM: equal pairs of hex digits are counted in order."""
    pairs = F.array_sort(F.regexp_extract_all(F.hex(c), F.lit("(..)"), 1))
    n = F.size(pairs).cast("double")
    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    add = lambda a: a["sum"] + F.when(a["run"] > 0, a["run"] * F.log2(a["run"])).otherwise(0.0)
    step = lambda a, p: F.when(a["last"] == p, F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(p.alias("last"), F.lit(1.0).alias("run"), add(a).alias("sum")))
    return F.when(n > 0, F.log2(n) - F.aggregate(pairs, zero, step, add) / n).otherwise(F.lit(0.0))
