"""Sizes, flags, dates and geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds between epochs.
FROM_1904, FROM_1601, FROM_2000, CPM_EPOCH = -2082844800, -11644473600, 946684800, 283910400
# Orientation bits and what the eight TIFF orientations are.
FLIP_VERTICAL, FLIP_HORIZONTAL, ROTATED = 1, 2, 4
TIFF_ORIENTATION = (0, 0, 2, 3, 1, 6, 7, 5, 4)
# Edges.
MIN_X, MIN_Y, MAX_X, MAX_Y = 1, 2, 4, 8


def bytes_human(size: Column) -> Column:
    """Three significant digits and a unit from B to TB, by thousands; halves are rounded up."""
    size = size.cast("double")
    power = F.when(size < 1e3, 0).when(size < 1e6, 1).when(size < 1e9, 2).when(size < 1e12, 3).otherwise(4)
    value = size / F.pow(F.lit(1000.0), power)
    shown = F.when(value < 10, F.format_string("%.2f", value)).when(value < 100, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value))
    trimmed = F.when(F.contains(shown, F.lit(".")), F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")).otherwise(shown)
    return F.concat(trimmed, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), power + 1))


def bytes_short(size: Column) -> Column:
    """Bytes as they are, else two, one or no decimals of KB, MB or GB."""
    value = size.cast("double")
    value = F.when(size < 1000000, value / 1e3).when(size < 1000000000, value / 1e6).otherwise(value / 1e9)
    unit = F.when(size < 1000000, " KB").when(size < 1000000000, " MB").otherwise(" GB")
    shown = F.when(value < 10, F.format_string("%.2f", value)).when(value < 100, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value))
    return F.when(size < 1000, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(shown, unit))


def bytes_long(size: Column) -> Column:
    dotted = F.format_number(size, 0)
    return F.when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes"))).otherwise(F.concat(bytes_short(size), F.lit(" ("), dotted, F.lit(" bytes)")))


def compression_text(size: Column, packed: Column) -> Column:
    """Saved share, six wide; dashes if a size is unknown or 0."""
    share = 100 * (1 - packed.cast("double") / F.nullif(size, F.lit(0)).cast("double"))
    known = (F.coalesce(size, F.lit(0)) != 0) & (F.coalesce(packed, F.lit(0)) != 0)
    return F.when(known, F.when(share <= -100, F.format_string("%5.0f%%", share)).otherwise(F.format_string("%5.1f%%", share))).otherwise(" -----")


def flags_text(value: Column, letters: str, flip: int = 0) -> Column:
    """Letters for the bits that are set, highest first, and dashes for the others."""
    top = len(letters) - 1
    value = value.bitwiseXOR(flip)
    return F.concat(*[F.when(value.bitwiseAND(1 << (top - i)) != 0, c).otherwise("-") for i, c in enumerate(letters)])


def posix_text(mode: Column) -> Column:
    return F.concat(flags_text(mode, "rwxrwxrwx"), F.lit(" ("), F.lower(F.conv(mode.cast("string"), 10, 8)), F.lit(")"))


def dos_text(flags: Column) -> Column:
    return F.concat(flags_text(flags, "ADVSHR"), F.lit(" (0x"), F.lpad(F.lower(F.hex(flags)), 2, "0"), F.lit(")"))


def amiga_text(bits: Column) -> Column:
    return F.concat(flags_text(bits, "hsparwed", 0x0F), F.lit(" (0x"), F.lpad(F.lower(F.hex(bits)), 2, "0"), F.lit(")"))


def windows_text(flags: Column) -> Column:
    # the blanks in the pattern stay where a bit is set, too
    return F.concat(flags_text(flags, "EIOCLPTN AD SHR"), F.lit(" (0x"), F.lpad(F.lower(F.hex(flags)), 4, "0"), F.lit(")"))


def yes_no(value: Column) -> Column:
    return F.when(value == 1, "Yes").when(value == 0, "No").otherwise(F.lower(F.hex(value)))


def os_type(code: Column) -> Column:
    """A four-character code; what can't be shown is a question mark."""
    letters = []
    for shift in (24, 16, 8, 0):
        c = F.shiftright(code, shift).bitwiseAND(255)
        letters.append(F.when(c.between(32, 127), F.char(c)).otherwise("?"))
    return F.concat(*letters)


def parse_number(text: Column, base: int) -> Column:
    """The number that a text begins with, after blanks and a sign, in base 8, 10 or 16; 0 if there is none."""
    digits = {8: "0-7", 10: "0-9", 16: "0-9a-fA-F"}[base]
    sign = F.when(F.regexp_extract(text, r"^\s*([+-]?)", 1) == "-", -1).otherwise(1)
    found = F.regexp_extract(text, rf"^\s*[+-]?{'(?:0[xX])?' if base == 16 else ''}([{digits}]+)", 1)
    return (F.when(found == "", F.lit(0)).otherwise(F.conv(found, base, 10).cast("long")) * sign).cast("long")


def snap_one(scale: Column) -> Column:
    return F.when(F.abs(scale - 1.0) < 0.01, F.lit(1.0)).otherwise(scale)


def date_2000(seconds: Column) -> Column:
    return F.timestamp_micros((seconds.cast("long") + FROM_2000) * 1000000)


def date_1904(seconds: Column) -> Column:
    return F.timestamp_micros((seconds.cast("long") + FROM_1904) * 1000000)


def date_1601(seconds: Column) -> Column:
    return F.timestamp_micros((seconds.cast("long") + FROM_1601) * 1000000)


def date_filetime(ticks: Column) -> Column:
    """Ticks of 100 ns since 1601."""
    return F.timestamp_micros(F.call_function("div", ticks.cast("long"), F.lit(10).cast("long")) + FROM_1601 * 1000000)


def date_dos(packed: Column) -> Column:
    """The 32-bit date and time of DOS, to two seconds; null if its fields are no date."""
    bits = lambda shift, mask: F.shiftright(packed.cast("long"), shift).bitwiseAND(mask).cast("int")
    return F.try_make_timestamp(bits(25, 127) + 1980, bits(21, 15), bits(16, 31), bits(11, 31), bits(5, 63), (bits(0, 31) * 2).cast("decimal(16,6)"))


def date_cpm(date: Column, time: Column) -> Column:
    seconds = time.bitwiseAND(31) * 2 + F.shiftright(time, 5).bitwiseAND(63) * 60 + F.shiftright(time, 11).bitwiseAND(31) * 3600 + date.cast("long") * 86400
    return F.timestamp_seconds(seconds + CPM_EPOCH)


def best_date(*dates: Column) -> Column:
    return F.coalesce(F.date_format(F.coalesce(*dates), "yyyy-MM-dd HH:mm"), F.lit("----------------"))


def tiff_orientation(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, TIFF_ORIENTATION)), code.cast("int")), F.lit(0))


def add_orientation(a: Column, b: Column) -> Column:
    """One orientation after another: flips of the second swap axes if only the first is rotated."""
    swapped = F.shiftright(b.bitwiseAND(FLIP_HORIZONTAL), 1).bitwiseOR(F.shiftleft(b.bitwiseAND(FLIP_VERTICAL), 1))
    turned, both = (a.bitwiseAND(ROTATED) != 0), (a.bitwiseAND(ROTATED) != 0) & (b.bitwiseAND(ROTATED) != 0)
    out = a.bitwiseXOR(F.when(turned & ~both, swapped).otherwise(b))
    return F.when(both, out.bitwiseXOR(FLIP_VERTICAL | FLIP_HORIZONTAL)).otherwise(out)


def reading_edges(place: Column, left_to_right: Column) -> Column:
    """Edges of a page's home, end and end-top, by reading direction."""
    near, far = F.when(left_to_right, MIN_X).otherwise(MAX_X), F.when(left_to_right, MAX_X).otherwise(MIN_X)
    return F.when(place == "home", near + MAX_Y).when(place == "end", far + MIN_Y).when(place == "end_top", far + MAX_Y).otherwise(0)


def fit_scale(width: Column, height: Column, view_width: float, view_height: float, only: str = "") -> Column:
    """The scale at which a picture fits a view; only 'down' or 'up'."""
    scale = F.least(F.lit(view_width) / F.round(width), F.lit(view_height) / F.round(height))
    return F.least(scale, F.lit(1.0)) if only == "down" else F.greatest(scale, F.lit(1.0)) if only == "up" else scale


def thumb_scale(width: Column, height: Column, size: float) -> Column:
    return F.least(F.lit(1.0), F.lit(size) / width, F.lit(size) / height)


def rect_difference(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Up to four rectangles (x, y, w, h) that cover a without b: above, below, left, right. An empty b leaves a."""
    ax, ay, aw, ah = (c.cast("double") for c in a)
    bx, by, bw, bh = (c.cast("double") for c in b)
    low = F.greatest(ay, by)
    side = by + bh - low
    zero = F.lit(0.0)
    rect = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    parts = F.array(rect(ax, by + bh, aw, F.greatest(ay + ah - by - bh, zero)), rect(ax, ay, aw, F.greatest(by - ay, zero)), rect(ax, low, F.greatest(bx - ax, zero), side), rect(bx + bw, low, F.greatest(ax + aw - bx - bw, zero), side))
    return F.when((bw <= 0) | (bh <= 0), F.array(rect(ax, ay, aw, ah))).otherwise(F.filter(parts, lambda r: (r.w > 0) & (r.h > 0)))


def rects_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (a[0] < b[0] + b[2]) & (b[0] < a[0] + a[2]) & (a[1] < b[1] + b[3]) & (b[1] < a[1] + a[3])
