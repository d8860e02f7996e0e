"""Checksums, character sets, URLs and wrapped text: vectorised functions where Spark has none."""

from __future__ import annotations

import re
import textwrap
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=8)
def crc_table(polynomial: int, width: int) -> list[int]:
    """Remainders of each byte for a reflected polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (polynomial if byte & 1 else 0)
        out.append(byte)
    return out


def crc(data: bytes, polynomial: int, width: int, start: int = 0, invert: int = 0) -> int:
    table, value = crc_table(polynomial, width), start
    for byte in data:
        value = table[(value ^ byte) & 0xFF] ^ (value >> 8)
    return value ^ invert


def crc16_ccitt(data: bytes) -> int:
    """Polynomial 1021, most significant bit first."""
    value = 0
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x1021 if value & 0x8000 else value << 1) & 0xFFFF
    return value


@F.pandas_udf(T.IntegerType())
def crc16(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else crc(bytes(x), 0xA001, 16)).astype("Int32")


@F.pandas_udf(T.IntegerType())
def crc16_reversed(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else crc16_ccitt(bytes(x))).astype("Int32")


@F.pandas_udf(T.StringType())
def crc64(data: pd.Series) -> pd.Series:
    """As sixteen hexadecimal digits: values don't fit a signed number."""
    ones = (1 << 64) - 1
    return data.map(lambda x: None if x is None else f"{crc(bytes(x), 0xC96C5795D7870F42, 64, ones, ones):016x}")


@F.pandas_udf(T.IntegerType())
def xor_sum(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else int(np.bitwise_xor.reduce(np.frombuffer(bytes(x), np.uint8), initial=0))).astype("Int32")


# --- character sets --------------------------------------------------------------------------------------------------

# Byte order marks, escape sequences, and the least and the certain confidence.
MARKS = ((b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xfe\xff", "UTF-16BE"), (b"\xff\xfe", "UTF-16LE"))
ESCAPES = ((b"~{", "HZ-GB-2312"), (b"\x1b$)A", "ISO-2022-CN"), (b"\x1b$)C", "ISO-2022-KR"), (b"\x1b$@", "ISO-2022-JP"), (b"\x1b$B", "ISO-2022-JP"), (b"\x1b(J", "ISO-2022-JP"))
LEAST, CERTAIN = 0.20, 0.95
#: Charsets of several bytes: their codec and the characters that make up most of a text in them.
WIDE = (("Shift_JIS", "shift_jis", "぀-ヿ"), ("EUC-JP", "euc_jp", "぀-ヿ"), ("GB18030", "gb18030", "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里"), ("CP949", "cp949", "가-힣"), ("Big5", "big5", "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡"))
#: Charsets of one byte: codec and the commonest letters of the languages written in them.
NARROW = (("windows-1251", "cp1251", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"), ("KOI8-R", "koi8_r", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"), ("IBM866", "cp866", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"), ("ISO-8859-5", "iso8859_5", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"), ("x-mac-cyrillic", "mac_cyrillic", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"), ("windows-1253", "cp1253", "αοιετνσςρπκμηυλωάόίέγήδθύώχφβξζψ"), ("windows-1255", "cp1255", "יוהלאתמרשבנעדקחפסגטזצכםןץךף"))


def _weight(text: str, common: str) -> float:
    high = [c for c in text if ord(c) > 127]
    return sum(bool(re.match(f"[{common}]", c)) for c in high) / len(high) if high else 0.0


def detect(data: bytes, escapes: bool = True) -> tuple[str | None, float]:
    """(charset, confidence): marks, escapes, then UTF-8, charsets of several bytes and of one, windows-1252 last; (None, 0) if nothing is sure enough.

    A mark counts only in more than three bytes. Bytes 0xA0 alone don't make a text more than ASCII. escapes: whether
    escape sequences name a charset; in bytes of a text that was decoded before they are characters like others.
    """
    if len(data) > 3:
        for mark, name in MARKS:
            if data.startswith(mark):
                return name, 1.0
    if not data:
        return None, 0.0
    if not any(b > 127 and b != 0xA0 for b in data):
        if escapes and (b"\x1b" in data or b"~{" in data):
            for code, name in ESCAPES:
                if code in data:
                    return name, CERTAIN
        return "US-ASCII", 1.0
    try:
        data.decode("utf-8")
        runs = len(re.findall(rb"[\xc2-\xf4][\x80-\xbf]+", data))
        return "UTF-8", 0.99 if runs >= 6 else 1 - 0.99 * 0.5**runs
    except UnicodeDecodeError as x:
        if x.reason == "unexpected end of data" and x.start > 0 and x.start >= len(data) - 3 and any(b > 127 for b in data[: x.start]):
            return "UTF-8", 0.9
    found = []
    for name, codec, common in WIDE:
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            continue
        narrow = sum(0xFF61 <= ord(c) <= 0xFF9F or 0xE000 <= ord(c) <= 0xF8FF for c in text)
        high = sum(ord(c) > 127 for c in text)
        found.append((min(0.99, (0.25 + 3 * _weight(text, common)) * (1 - narrow / max(high, 1))), name))
    for name, codec, common in NARROW:
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            continue
        letters = common[: len(common) // 2]
        runs = [len(r) for r in re.findall("[^\x00-\x7f]+", text)]
        joined = sum(n for n in runs if n > 1) / max(1, sum(runs))  # letters of these languages stand together, accents don't
        lower = joined * (_weight(text, letters) + 0.5 * _weight(text, letters.upper())) * _weight(text, common + common.upper()) ** 2
        found.append((min(0.99, lower * 1.2 if lower > 0.4 else lower * 0.2), name))
    try:
        text = data.decode("cp1252")
        word = sum(c.isalpha() for c in text if ord(c) > 127) / max(1, sum(ord(c) > 127 for c in text))
        joined = len(re.findall(r"[a-zA-Z][À-ÿ]|[À-ÿ][a-z]", text)) / max(1, sum(ord(c) > 127 for c in text))
        found.append((min(0.73, 0.5 * word * min(1, joined) + 0.23), "windows-1252"))
    except UnicodeDecodeError:
        pass
    confidence, name = max(found, default=(0.0, None))
    return (name, confidence) if confidence > LEAST else (None, 0.0)


_DETECTED = T.StructType([T.StructField("charset", T.StringType()), T.StructField("confidence", T.FloatType())])


@F.pandas_udf(_DETECTED)
def detect_charset(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detect(bytes(x)) if x is not None else (None, None) for x in data], columns=["charset", "confidence"])


@F.pandas_udf(_DETECTED)
def detect_text_charset(data: pd.Series) -> pd.DataFrame:
    """For the bytes of a column of strings: escape sequences don't count."""
    return pd.DataFrame([detect(bytes(x), escapes=False) if x is not None else (None, None) for x in data], columns=["charset", "confidence"])


#: Names that Python has another word for.
CODECS = {"x-mac-cyrillic": "mac_cyrillic", "macintosh": "mac_roman", "HZ-GB-2312": "hz", "US-ASCII": "ascii"}


@F.pandas_udf(T.StringType())
def decode_or_escape(data: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes as text in a charset; bytes that aren't valid in it, or a charset unknown, as ASCII with %xx."""

    def one(raw, name):
        if raw is None:
            return None
        try:
            return bytes(raw).decode(CODECS.get(name, name or "cp1252"))
        except (UnicodeDecodeError, LookupError):
            return "".join(chr(b) if b < 128 else f"%{b:02x}" for b in bytes(raw))

    return pd.Series([one(r, n) for r, n in zip(data, charset, strict=True)])


# --- URLs ------------------------------------------------------------------------------------------------------------


def normal_url(text: str | None) -> str | None:
    """A URL as one would type it, made whole: http or file if there is no scheme, www.X.com for a bare word; None if it can't be one."""
    if text is None:
        return None
    text = re.sub("[\n\r\t]", "", text)
    scheme, sep, rest = text.partition("://")
    if not sep:
        scheme, rest = ("file" if text[:1] in ("/", "~") else "http"), text
    elif not scheme or not all(c.isalpha() or c in "+-." for c in scheme):
        return None
    if not text:
        return None
    out = f"{scheme}://"
    login = re.match("[^@/]*@", rest)
    if login:
        out, rest = out + login[0], rest[login.end() :]
    host = re.match("[^:/]*", rest)[0]
    rest = rest[len(host) :]
    if not host:
        if scheme != "file" or not rest:
            return None
    elif host not in ("localhost", "~"):
        if any(not p or not p.isalnum() for p in re.split("[.-]", host)):
            return None
        if "." not in host:
            host = f"www.{host}.com"
    out += host
    if rest.startswith(":"):
        port = re.match(r":([+-]?\d+)", rest)
        if scheme == "file" or not port:
            return None
        out, rest = f"{out}:{int(port[1])}", rest[port.end() :]
    path = rest.removeprefix("/")
    if scheme == "file":
        if "//" in path:
            return None
    else:
        path = re.sub(r"(?:%[0-9a-fA-F]{2})+", _unescaped, path)
    return out + "/" + quote(path, safe="/:?#[]@!$&'()*+,;=-._~")


def _unescaped(m: re.Match) -> str:
    raw = bytes.fromhex(m[0].replace("%", ""))
    return raw.decode("utf-8", errors="ignore")


@F.pandas_udf(T.StringType())
def url_normalize(text: pd.Series) -> pd.Series:
    return text.map(normal_url)


def word_wrap(text: Column, width: int) -> Column:
    """Lines of at most width characters, broken between words."""

    @F.pandas_udf(T.StringType())
    def wrap(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "\n".join(y for line in x.split("\n") for y in (textwrap.wrap(line, width) or [""])))

    return wrap(text)
