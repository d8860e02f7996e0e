"""Names, search terms, globs and paths as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def natural_key(name: Column) -> Column:
    """A key whose order is that of names with case ignored and digit runs compared as numbers."""

    def part(x: Column) -> Column:
        """A run of digits without its leading zeros, after how many digits that leaves."""
        digits = F.regexp_replace(x, r"^0+(?=\d)", "")
        return F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(x)

    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, part), "")


def search_terms(query: str) -> list[int | str]:
    """Terms of a search: parts between single blanks; a part that is a whole integer is a number (unless it is the largest or smallest int)."""
    out: list[int | str] = []
    for part in (p for p in query.split(" ") if p):
        number = int(part) if re.fullmatch(r"[+-]?\d+", part) else None
        out.append(part if number is None or abs(number) >= (1 << 31) - 1 else number)
    return out


def matches(text: Column, query: str) -> Column:
    """All terms match: a string is contained, case ignored; a number equals some run of digits. No terms: true."""
    out = F.lit(True)
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    for term in search_terms(query):
        if isinstance(term, int):
            plain = F.transform(runs, lambda r: F.regexp_replace(r, r"^0+(\d)", "$1"))
            out &= F.array_contains(plain, str(term))
        else:
            out &= F.contains(F.lower(text), F.lit(term.lower()))
    return out


def matches_page(page: Column, query: str) -> Column:
    """Every term is a number that equals the page (counted from 1)."""
    out = F.lit(True)
    for term in search_terms(query):
        out &= (page == term) if isinstance(term, int) else F.lit(False)
    return out


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob: * and ? also match a slash, classes stay, a backslash quotes."""
    out, i = ["(?s)^"], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("]", "^", "!") else i + 1)) > 0:
            inside = glob[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[:1] == "!" else inside).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out) + "$"


def glob(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    found = glob_regex(pattern)
    return text.rlike(found.replace("(?s)", "(?si)") if ignore_case else found)


def hidden(path: Column) -> Column:
    return path.startswith(".") | F.contains(path, F.lit("/."))


def components(path: Column) -> Column:
    """Parts of a path between slashes, without empty ones."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def first_component(path: Column) -> Column:
    return F.coalesce(F.get(components(path), F.lit(0)), F.lit(""))


def canonical(path: Column, compat: bool = False) -> Column:
    """Parts without '.', and with 'a/..' gone. compat: paths that hold both '.' and '..' stay as they are."""
    parts = components(path)
    folded = F.aggregate(
        F.filter(parts, lambda x: x != "."), F.array().cast("array<string>"), lambda done, x: F.when((x == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))
    )
    if not compat:
        return folded
    return F.when(F.array_contains(parts, ".") & F.array_contains(parts, ".."), parts).otherwise(folded)


def sanitized(path: Column) -> Column:
    """A relative path that can't leave its folder: '..' becomes '__Parent__', an empty path '.'."""
    parts = F.transform(canonical(path), lambda x: F.when(x == "..", F.lit("__Parent__")).otherwise(x))
    return F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/"))


def path_string(parts: Column) -> Column:
    """Parts as one path; a slash inside a part becomes a colon."""
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("/"), F.lit(":"))), "/")


def parent(path: Column) -> Column:
    parts = components(path)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise("")


def has_prefix(path: Column, prefix: Column, compat: bool = False) -> Column:
    """path lies under prefix by components. compat: by characters, so that 'a/bc' lies under 'a/b'."""
    if compat:
        return F.startswith(path, prefix)
    a, b = canonical(path), canonical(prefix)
    return F.slice(a, F.lit(1), F.greatest(F.size(b), F.lit(1))) == F.when(F.size(b) == 0, F.slice(a, F.lit(1), F.lit(1))).otherwise(b)


def replace_set(text: Column, characters: str, by: str) -> Column:
    """Each run of the given characters becomes one replacement."""
    inside = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in characters)
    return F.regexp_replace(text, f"[{inside}]+", by.replace("\\", "\\\\").replace("$", "\\$"))


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first start and the next end (or the text's end); null without a start."""
    rest = F.regexp_extract(text, "(?s)" + re.escape(start) + "(.*)$", 1)
    return F.when(F.contains(text, F.lit(start)), F.substring_index(rest, end, 1))


def escape_controls(text: Column) -> Column:
    """Control characters as ^X."""
    out = text
    for c in range(32):
        out = F.replace(out, F.lit(chr(c)), F.lit("^" + chr(c + 64)))
    return F.replace(out, F.lit(chr(127)), F.lit("^?"))


def escape_bytes(data: Column) -> Column:
    """Bytes as text: ASCII as it is, others as %xx."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda h: F.when(h >= "80", F.concat(F.lit("%"), F.lower(h))).otherwise(F.unhex(h).cast("string"))), "")


def archive_stem(name: Column) -> Column:
    """Name of the folder that an archive is unpacked to: without its extension, or both of a double one."""
    once = F.regexp_replace(name, r"(.)\.[^./]*$", "$1")
    return F.when(name.rlike(r"(?i)\.(part[0-9]+\.rar|tar\.gz|tar\.bz2|tar\.lzma|sit\.hqx)$"), F.regexp_replace(once, r"(.)\.[^./]*$", "$1")).otherwise(once)


def one_line(name: Column) -> Column:
    return F.regexp_replace(name, "[\\n\\r\\u0085\\u2028\\u2029]", "")
