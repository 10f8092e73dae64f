"""Identification of files by signature and by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a file that are looked at.
PREFIX = 1 << 20


@dataclass(frozen=True)
class Signature:
    """`magic` (hex) at `offset`; without an offset anywhere in the prefix. Earlier signatures win."""

    magic: str
    label: str
    offset: int | None = 0
    codec: str = ""


# Public file signatures.
SIGNATURES = (
    Signature("504B0304", "zip", codec="deflate"),
    Signature("1F8B", "gzip", codec="gzip"),
    Signature("28B52FFD", "zstd", codec="zstd"),
    Signature("FD377A585A00", "xz", codec="lzma"),
    Signature("425A68", "bzip2"),
    Signature("526172211A0701", "rar5"),
    Signature("377ABCAF271C", "7z"),
    Signature("89504E470D0A1A0A", "png"),
    Signature("FFD8FF", "jpeg"),
    Signature("4F676753", "ogg"),
    Signature("52494646", "riff"),
    Signature("53514C69746520666F726D6174203300", "sqlite"),
    Signature("43504B20", "cpk"),
    Signature("40555446", "utf table"),
    Signature("5850330D0A200A1A8B6701", "xp3", codec="zlib"),
    Signature("50534152", "psarc", codec="zlib"),
    Signature("556E6974794653", "unityfs"),
    Signature("1B4C7561", "lua bytecode"),
    Signature("4D436F6D707248", "chd"),
    Signature("EFBBBF", "utf-8 text"),
    Signature("FFFE", "utf-16 text"),
    Signature("4344303031", "iso9660", 0x8001),
    Signature("78DA", "zlib stream", codec="zlib"),
    Signature("524F4D32", "rom2 archive"),
    Signature("534E5220", "snr script"),
    Signature("54584134", "txa4 texture"),
    Signature("42555034", "bup4 sprite"),
    Signature("706638", "pf8 archive"),
    Signature("43444152", "cdar archive"),
    Signature("5354434D324C", "stcm2l script"),
    Signature("554E4932", "uni2 container"),
    Signature("4C494250", "libp archive"),
    Signature("41524321", "arc! archive"),
    Signature("5061636B46696C65", "packfile archive"),
    Signature("4E534172", "nsa archive"),
    Signature("4E534143", "nsac archive"),
    Signature("4D5A5830", "mzx0 data"),
    Signature("41465300", "afs archive"),
    Signature("6D7267643030", "mrg container"),
    Signature("4E504101", "npa archive"),
    Signature("616C6C736372", "allscr script"),
    Signature("43525054", "crpt container"),
    Signature("535054484541444552", "spt script"),
    Signature("50465330", "pfs0 archive"),
    Signature("4E434133", "nca3 archive"),
    Signature("48454144", "xci image"),
    Signature("53434500", "self image"),
    Signature("4352494C41594C41", "crilayla data", None, "crilayla"),
    Signature("585033", "xp3 inside", None, "zlib"),
)
# Names that tell what a folder holds.
FOLDER_HINTS = (("eboot.bin", "application"), ("sce_pfs", "protected files"), ("data.rom", "rom2 archive"), ("exec.dat", "malie script"), ("nscript.dat", "nscripter script"))
TEXT_SIGNATURES = (("html", ("<!DOCTYPE", "<html"), True), ("json", ("{", "["), True), ("table", (" | ",), False), ("junk", ("%%%", "$$$"), False))


def scan_files(spark, path: str, glob: str | None = None) -> DataFrame:
    """path, length, modificationTime, content. Columns that aren't used aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def extension_stats(files: DataFrame, top: int = 20) -> DataFrame:
    """ext, files, bytes of the most common extensions."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("files"), "ext").limit(top)


def _fits(content: Column, s: Signature) -> Column:
    n = len(s.magic) // 2
    if s.offset is None:
        # On hex digits, at an even place.
        return F.hex(F.substring(content, 1, PREFIX)).rlike(f"^(?:[0-9A-F]{{2}})*?{s.magic}")
    return F.hex(F.substring(content, s.offset + 1, n)) == s.magic


def identify(files: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """files with `kind` and `codec`: signatures at fixed places first, then those anywhere; null if none fits."""
    ordered = [s for s in signatures if s.offset is not None] + [s for s in signatures if s.offset is None]
    hit = F.coalesce(*[F.when(_fits(F.col("content"), s), F.struct(F.lit(s.label).alias("kind"), F.lit(s.codec).alias("codec"))) for s in ordered])
    return files.withColumn("hit", hit).withColumn("kind", F.col("hit.kind")).withColumn("codec", F.col("hit.codec")).drop("hit")


def all_signatures(files: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """path, kind, offset of the first place of every signature in the prefix."""
    hexed = F.hex(F.substring("content", 1, PREFIX))
    hits = F.array(*[F.struct(F.lit(s.label).alias("kind"), F.length(F.regexp_extract(hexed, f"^((?:[0-9A-F]{{2}})*?){s.magic}", 1)).alias("d"), hexed.rlike(f"^(?:[0-9A-F]{{2}})*?{s.magic}").alias("there")) for s in signatures])
    return files.select("path", F.explode(F.filter(hits, lambda h: h["there"])).alias("h")).select("path", "h.kind", (F.col("h.d") / 2).cast("long").alias("offset"))


def sniff_text(c: Column, table, otherwise: str) -> Column:
    """The first kind whose marks stand at the start, or in the first 200 characters."""
    out = None
    for kind, marks, at_start in table:
        fits = None
        for m in marks:
            one = c.startswith(m) if at_start else F.substring(c, 1, 200).contains(m)
            fits = one if fits is None else fits | one
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise(otherwise)


def modified_since(files: DataFrame, since: str) -> DataFrame:
    """Files of a scan that changed at or after a date; only their metadata is looked at."""
    return files.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))


def without_names(rows: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """rows whose name isn't in names(name), case aside."""
    return rows.join(names.select(F.lower("name").alias("_skip")).distinct(), F.lower(F.col(name)) == F.col("_skip"), "left_anti")


def find_all(files: DataFrame, needle: str, key: str = "path", content: str = "content") -> DataFrame:
    """key, offset of every place of a hex string in a binary column, overlapping ones too."""
    if len(needle) % 2 or not needle:
        raise ValueError("whole bytes in hex, please")
    needle = needle.upper()
    # Looking ahead consumes one byte at a time; what was passed over is kept to add up the places.
    pieces = F.regexp_extract_all(F.hex(content), F.lit(f"((?:(?!{needle})..)*+)(?={needle}).."), 1)
    rows = files.select(key, F.posexplode(pieces).alias("k", "piece"))
    place = F.sum(F.length("piece") / 2 + 1).over(Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.select(key, place.cast("long").alias("offset"))


def most_runs(runs: DataFrame, top: int = 20, key: str = "path") -> DataFrame:
    """key, runs of the files with most printable runs."""
    return runs.groupBy(key).agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), key).limit(top)


def directory_hints(files: DataFrame, hints: Sequence[tuple[str, str]]) -> DataFrame:
    """folder, name, kind: where a file or folder of a hinted name stands, once for each folder that it stands in, of files(path)."""
    listed = F.broadcast(files.sparkSession.createDataFrame(list(hints), "name string, kind string"))
    parts = F.split("path", "/")
    places = F.transform(parts, lambda p, i: F.struct(p.alias("name"), i.alias("i")))
    wanted = F.filter(places, lambda p: p["name"].isin(*[n for n, _ in hints]))
    hits = files.select(parts.alias("parts"), F.explode(wanted).alias("p")).select(F.array_join(F.slice("parts", 1, F.col("p.i")), "/").alias("folder"), "p.name").distinct()
    return hits.join(listed, "name").select("folder", "name", "kind")
