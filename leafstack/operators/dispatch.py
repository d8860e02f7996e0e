"""Which adapter reads a resource, and which format an archive has, by rules with priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each adapter reads, by kind of evidence. fourcc are hexadecimal; one is six bytes long and one
# stands under a kind that no one asks for, so neither can match.
RULES: dict[str, dict[str, str]] = {
    "archive": {"ext": "zip cbz rar cbr 7z", "mime": "application/zip application/x-zip application/x-zip-compressed multipart/x-zip application/rar application/x-rar application/x-rar-compressed compressed/rar application/x-7z-compressed", "uti": "org.7-zip.7-zip-archive", "fourcc": "504b0304 52617221 377ac2bcc2af"},
    "folder": {"uti": "public.folder"},
    "image": {
        "ext": "epi eps epsf epsi tiff tif crw cr2 nef raf orf mrw srf dcr arw pef raw dng xbm exr bmp gif ico jpg jpeg jpe thm pict pct png qtif tga sgi psd pntg fpx fax jfx jfax icns jp2 pic hdr",
        "mime": "application/postscript image/tiff image/raw image/exr image/bmp image/x-bmp image/x-windows-bmp image/ms-bmp image/x-ms-bmp application/bmp image/gif image/jpeg image/jpg image/pjpeg image/pict image/x-pict image/png application/png application/x-png image/photoshop image/x-photoshop image/psd application/photoshop application/psd",
        "uti": "public.tiff com.ilm.openexr-image com.microsoft.bmp com.compuserve.gif com.microsoft.ico public.jpeg com.apple.pict public.png com.apple.quicktime-image com.truevision.tga-image com.sgi.sgi-image com.adobe.photoshop-image com.apple.macpaint-image com.kodak.flashpix-image public.fax com.apple.icns public.jpeg-2000 public.radiance",
    },
    "html": {"mime": "text/html application/xhtml+xml"},
    "feed": {"ext": "xml rss", "mime": "application/rss+xml text/rss+xml", "uti": "public.rss public.xml"},
    "pdf": {"ext": "pdf", "mime": "application/pdf application/x-pdf application/acrobat applications/vnd.pdf text/pdf text/x-pdf", "uti": "com.adobe.pdf", "unused": "25504446"},
}
PRIORITY = {"fourcc": 5, "uti": 4, "mime": 3, "ostype": 2, "ext": 1}
BASE = "resource"


def rules(spark: SparkSession) -> DataFrame:
    """(adapter, kind, pattern, priority), a fixed table of some hundred rows."""
    rows = [(a, k, p, PRIORITY.get(k, 0)) for a, kinds in RULES.items() for k, patterns in kinds.items() for p in patterns.split()]
    return spark.createDataFrame(rows, "adapter string, kind string, pattern string, priority int")


def resolve(df: DataFrame, key: str, evidence: dict[str, Column]) -> DataFrame:
    """(key, adapter, priority, candidates): the best adapter of each row, and all in the order they are tried.

    evidence: for kinds of rules what a row shows; fourcc as hexadecimal of the first four bytes, and only of
    content that is longer. Equal priorities go by name; the base adapter always stands last.
    """
    table = F.broadcast(rules(df.sparkSession).select("adapter", "kind", "pattern", "priority"))
    given = df.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(c).alias("pattern")) for k, c in evidence.items()])).alias("e")).select(key, "e.*").filter("pattern is not null")
    best = given.join(table, ["kind", "pattern"]).groupBy(key, "adapter").agg(F.max("priority").alias("priority"))
    found = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("minus"), "adapter"))).alias("c"))  # as many as adapters, at most
    found = df.select(key).join(found, key, "left")
    names = F.concat(F.coalesce(F.transform("c", lambda x: x.adapter), F.array().cast("array<string>")), F.array(F.lit(BASE)))
    return found.select(key, F.get(names, F.lit(0)).alias("adapter"), F.coalesce(-F.get(F.col("c"), F.lit(0)).minus, F.lit(0)).alias("priority"), F.array_join(names, ",").alias("candidates"))


# Signatures of archive formats in the order in which they are tried: (name, offset, hexadecimal).
SIGNATURES: tuple[tuple[str, int, str], ...] = (
    ("Zip", 0, "504b0304"), ("Zip", 0, "504b0506"), ("Zip", 4, "504b0304"), ("RAR", 0, "526172211a07"), ("7-Zip", 0, "377abcaf271c"), ("Gzip", 0, "1f8b08"), ("Bzip2", 0, "425a68"), ("Tar", 257, "7573746172"),
    ("StuffIt", 0, "53495421"), ("StuffIt 5", 0, "5374756666497420"), ("StuffIt X", 0, "5374756666497421"), ("XAR", 0, "78617221"), ("Compress", 0, "1f9d"), ("RPM", 0, "edabeedb"), ("XZ", 0, "fd377a585a00"),
    ("SWF", 0, "465753"), ("SWF", 0, "435753"), ("PDF", 0, "255044462d"), ("ALZip", 0, "414c5a01"), ("CAB", 0, "4d534346"), ("CFBF", 0, "d0cf11e0a1b11ae1"), ("LZH", 2, "2d6c68"), ("Zoo", 20, "dca7c4fd"), ("LZX", 0, "4c5a58"),
    ("PowerPacker", 0, "50503230"), ("Ar", 0, "213c617263683e0a"), ("ARJ", 0, "60ea"), ("Cpio", 0, "303730373037"), ("Cpio", 0, "303730373031"), ("Cpio", 0, "303730373032"), ("ISO 9660", 32769, "4344303031"),
)


def detect_format(header: Column) -> Column:
    """Name of the first format whose signature the header has, else null. Only formats with a plain signature are known."""
    out = F.lit(None).cast("string")
    for name, offset, code in reversed(SIGNATURES):
        out = F.when(F.hex(F.substring(header, offset + 1, len(code) // 2)) == code.upper(), name).otherwise(out)
    return out


def tar_variant(header: Column) -> Column:
    """USTAR, STAR, GNU or V7 by the magic of a 512-byte header; V7 only if its checksum is right."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.substring(header, 1, 512)), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))
    total = F.aggregate(F.concat(F.slice(codes, 1, 148), F.slice(codes, 157, 356)), F.lit(256), lambda a, x: a + x)
    written = F.conv(F.regexp_extract(F.substring(header, 149, 8).cast("string"), "([0-7]+)", 1), 8, 10).cast("int")
    magic = F.hex(F.substring(header, 258, 8))
    return F.when(F.octet_length(header) < 512, None).when(magic == "7573746172003030", F.when(F.hex(F.substring(header, 509, 4)) == "74617200", "STAR").otherwise("USTAR")).when(magic == "7573746172202000", "GNU").when(total == written, "V7")
