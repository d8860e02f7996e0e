"""Listings and tests of archives: zip, tar (plain or compressed), gzip, bzip2, xz and lzma, as far as Python reads them."""

from __future__ import annotations

import bz2
import ctypes
import gzip
import io
import lzma
import tarfile
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.operators.dispatch import SIGNATURES

#: Formats of SIGNATURES that are read here.
READ = {"Zip", "Tar", "Gzip", "Bzip2", "XZ", "LZMA"}
SCHEMA = "idx int, path string, size long, packed long, method string, is_dir boolean, is_link boolean, target string, encrypted boolean, mode int, modified timestamp_ntz, crc32 long, verdict string"
#: The same for Arrow, with the archive's name.
_ARROW = pa.schema([("archive", pa.string()), *[(f.split()[0], {"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}[f.split()[1]]) for f in SCHEMA.split(", ")]])
#: Bytes of archives, or rows about them, that a step holds besides the batch it was given, unless one archive has more.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 1000
_METHODS = {0: "Stored", 8: "Deflate", 12: "Bzip2", 14: "LZMA"}
_SINGLE = {b"\x1f\x8b\x08": ("Gzip", gzip.decompress), b"BZh": ("Bzip2", bz2.decompress), b"\xfd7zXZ\x00": ("XZ", lzma.decompress), b"]\x00\x00": ("LZMA", lzma.decompress)}


def _zip(data: bytes, test: bool) -> list[tuple]:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i, e in enumerate(z.infolist()):
            mode, link = e.external_attr >> 16, (e.external_attr >> 16) & 0xF000 == 0xA000
            verdict = "not_tested"
            if test and not e.is_dir() and not link:
                try:
                    verdict = "ok" if len(z.read(e)) == e.file_size else "wrong_size"
                except zipfile.BadZipFile as x:
                    verdict = "wrong_checksum" if "CRC" in str(x) else "unpacking_failed"
                except (RuntimeError, NotImplementedError):
                    verdict = "not_supported"
                except Exception:  # whatever a decoder says of broken data
                    verdict = "unpacking_failed"
            target = z.read(e).decode(errors="replace") if link and not e.flag_bits & 1 else None
            out.append((i, e.filename, e.file_size, e.compress_size, _METHODS.get(e.compress_type, "Unknown"), e.is_dir(), link, target, bool(e.flag_bits & 1), mode or None, pd.Timestamp(*e.date_time) if e.date_time[1] and e.date_time[2] else None, e.CRC, verdict))
    return out


def _tar(data: bytes, test: bool) -> list[tuple]:
    out = []
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for i, e in enumerate(t):
            link = e.issym() or e.islnk()
            verdict = "not_tested"
            if test and e.isfile():
                try:
                    body = t.extractfile(e).read()
                    verdict = "no_checksum" if len(body) == e.size else "wrong_size"
                except (tarfile.TarError, OSError, EOFError):
                    verdict = "unpacking_failed"
            out.append((i, e.name + "/" * e.isdir(), e.size, None, "None", e.isdir(), link, e.linkname if link else None, False, e.mode, pd.Timestamp(e.mtime, unit="s"), None, verdict))
    return out


def list_archive(data: bytes, name: str, test: bool = True, nested: bool = True) -> list[tuple]:
    """Rows of SCHEMA for an archive's entries. One that holds a single archive gives that one's entries.

    An archive of a format that is recognised and can't be read is one row without a path and with the verdict
    not_supported; broken archives and data of no known format give no rows.
    """
    try:
        if zipfile.is_zipfile(io.BytesIO(data)):
            rows = _zip(data, test)
            if nested and len(rows) == 1 and rows[0][1].lower().endswith((".zip", ".tar", ".tgz", ".tar.gz")):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    return list_archive(z.read(rows[0][1]), rows[0][1], test, False) or rows
            return rows
        single = next((v for k, v in _SINGLE.items() if data.startswith(k)), None)
        if data[257:262] == b"ustar":
            return _tar(data, test)
        if single:
            stem = name.rsplit("/", 1)[-1]
            stem = stem.rsplit(".", 1)[0] if "." in stem[1:] else stem
            try:
                body = single[1](data)
            except Exception as x:  # each decoder has errors of its own
                return [(0, stem, None, len(data), single[0], False, False, None, False, None, None, None, "wrong_checksum" if "CRC" in str(x) else "unpacking_failed")]
            if body[257:262] == b"ustar":
                return _tar(body, test)
            checked = single[0] != "LZMA"
            return [(0, stem, len(body), len(data), single[0], False, False, None, False, None, None, zlib.crc32(body), ("ok" if checked else "no_checksum") if test else "not_tested")]
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError, KeyError, RuntimeError, NotImplementedError):
        return []
    kind = recognised(data)
    return [_whole(len(data), kind)] if kind and kind not in READ else []


def recognised(data: bytes) -> str | None:
    """The format that a signature tells."""
    return next((kind for kind, at, code in SIGNATURES if data[at : at + len(code) // 2] == bytes.fromhex(code)), None)


def _whole(size: int, kind: str) -> tuple:
    """The row of an archive whose entries can't be read: it has no path."""
    return (0, None, None, size, kind, False, False, None, False, None, None, None, "not_supported")


def give_back() -> None:
    """Return to the system what allocators hold without using it: packers and batches leave much behind in workers, which stay for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def archive_entries(files: DataFrame, name: str = "path", content: str = "content", test: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries of the archives in a column of bytes, with their archive's name. keep: columns of files that each of its entries gets too."""

    def made(rows, kept, types):
        out = pd.DataFrame(rows, columns=_ARROW.names)
        out["modified"] = pd.to_datetime(out["modified"])
        for c in ("size", "packed", "mode", "crc32"):
            out[c] = out[c].astype("Int64")
        columns = [pa.Array.from_pandas(out[f.name], type=f.type, safe=False) for f in _ARROW]
        more = [pa.array([k[i] for k in kept], type=t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, *more], names=[*_ARROW.names, *keep])

    def work(batches):
        for batch in batches:
            types = [batch.schema.field(k).type for k in keep]
            rows, kept = [], []
            for n, data, *more in zip(batch.column("name"), batch.column("content"), *[batch.column(k) for k in keep], strict=True):
                n, more = n.as_py(), [x.as_py() for x in more]
                rows += [(n, *r) for r in list_archive(data.as_py(), n, test)]
                kept += [more] * (len(rows) - len(kept))
                if len(rows) >= CHUNK_ROWS:
                    yield made(rows, kept, types)
                    rows, kept = [], []
            if rows:
                yield made(rows, kept, types)
            del batch, rows, kept
            give_back()

    given = files.filter(F.col(content).isNotNull()).select(F.col(name).cast("string").alias("name"), F.col(content).alias("content"), *keep)
    return given.mapInArrow(work, ", ".join(["archive string", SCHEMA, *[f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keep]]))


def read_archives(spark: SparkSession, path: str, pattern: str = "*", test: bool = True) -> DataFrame:
    """Entries of the archives beneath a folder. Files are read whole, one at a time in a task."""
    return archive_entries(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path), test=test)


def read_listing(spark: SparkSession, path: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, modified) of the files beneath a folder; their content is not read. Hidden files are left out by the reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(~F.col("path").isin(*ignore) if ignore else F.lit(True)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
