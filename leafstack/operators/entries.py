"""Entries of archives: runs, totals, forks, differences, verdicts and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafstack.functions import numbers as N


def solid_runs(df: DataFrame, by: list[str], position: str, thing: str) -> DataFrame:
    """Runs of equal neighbours (nulls are equal): first_index, next_index (of the row after it in its run) and is_solid (not the first of its run)."""
    order = Window.partitionBy(*by).orderBy(position)
    new = (~F.col(thing).eqNullSafe(F.lag(thing).over(order))) | (F.row_number().over(order) == 1)
    df = df.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "run").orderBy(position)
    return df.withColumn("first_index", F.first(position).over(inside)).withColumn("next_index", F.lead(position).over(inside)).withColumn("is_solid", F.row_number().over(inside) > 1)


def total(size: str = "size", known_only: bool = False) -> Column:
    """Sum of sizes; -1 if one is unknown, unless unknown ones are to be passed over."""
    whole = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    return whole if known_only else F.when(F.count("*") == F.count(size), whole).otherwise(F.lit(-1).cast("long"))


def representative_size(size: Column, packed: Column, no_data: Column) -> Column:
    return F.when(no_data, F.lit(0)).otherwise(F.coalesce(size, packed, F.lit(1000))).cast("long")


def verdict(tested: Column, supported: Column, unpacked: Column, size_ok: Column, has_checksum: Column, checksum_ok: Column) -> Column:
    """What a test of an entry says; the first that applies."""
    return (
        F.when(~tested, "not_tested").when(~supported, "not_supported").when(~unpacked, "unpacking_failed").when(has_checksum & ~checksum_ok, "wrong_checksum").when(~size_ok, "wrong_size").when(~has_checksum, "no_checksum").otherwise("ok")
    )


#: Verdicts that count as passed, failed or unknown.
OUTCOME = {"ok": "passed", "not_supported": "failed", "unpacking_failed": "failed", "wrong_size": "failed", "wrong_checksum": "failed", "no_checksum": "unknown"}


def verdict_counts(df: DataFrame, by: list[str], column: str = "verdict") -> DataFrame:
    of = lambda kind: F.count_if(F.col(column).isin(*[v for v, k in OUTCOME.items() if k == kind])).alias(kind)
    return df.groupBy(*by).agg(of("passed"), of("failed"), of("unknown"))


def difference(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """What a new listing adds, keeps, changes and removes."""
    a, b = old.select(F.col(key), F.col(stamp).alias("was")), new.select(F.col(key), F.col(stamp).alias("now"))
    both = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "kept").otherwise("changed").alias("change"))


def merge_forks(df: DataFrame, by: list[str], position: str, name: str, is_resource: str) -> DataFrame:
    """Logical entries of data and resource forks that follow each other under one name.

    Only the latest entry of a name can be completed. So forks of a name that alternate pair up two by two from where
    the alternation begins, and a fork of the kind just seen begins a new entry.
    """
    order = Window.partitionBy(*by, name).orderBy(position)
    fresh = F.coalesce(F.col(is_resource) == F.lag(is_resource).over(order), F.lit(True))
    df = df.withColumn("chain", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, name, "chain").orderBy(position)
    df = df.withColumn("pair", F.floor((F.row_number().over(inside) - 1) / F.lit(2)))
    return df.groupBy(*by, name, "chain", "pair").agg(F.min(position).alias("entry_index"), F.min(F.when(~F.col(is_resource), F.col(position))).alias("data_index"), F.min(F.when(F.col(is_resource), F.col(position))).alias("resource_index")).drop("chain", "pair")


def fork_pairs(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Names that exactly two entries of a group have."""
    return df.groupBy(*by, name).agg(F.count("*").alias("n")).filter("n = 2").drop("n")


def flags(mode: Column, dos: Column, windows: Column, link: Column) -> list[Column]:
    """Kinds that an entry's mode, DOS or Windows attributes and link target tell."""
    kind = F.coalesce(mode, F.lit(0)).bitwiseAND(0xF000)
    return [
        (link.isNotNull() | (kind == 0xA000)).alias("is_link"), (kind == 0x4000).alias("is_dir"), (kind == 0x2000).alias("is_character_device"), (kind == 0x6000).alias("is_block_device"), (kind == 0x1000).alias("is_fifo"),
        (F.coalesce(dos, windows, F.lit(0)).bitwiseAND(2) != 0).alias("is_hidden"),
    ]


def finder_info(info: Column) -> Column:
    """Type, creator and flags from the 10 first bytes of Finder info, most significant byte first."""
    number = lambda at, n: F.conv(F.hex(F.substring(info, at, n)), 16, 10).cast("long")
    return F.when(F.octet_length(info) >= 10, F.struct(number(1, 4).alias("type"), number(5, 4).alias("creator"), number(9, 2).cast("int").alias("flags"), F.shiftright(number(9, 2).cast("int"), 1).bitwiseAND(7).alias("label")))


def long_line(index: Column, is_dir: Column, is_resource: Column, is_link: Column, encrypted: Column, size: Column, packed: Column, code: Column, date: Column, name: Column) -> Column:
    """A line of the long listing."""
    mark = lambda c, letter: F.when(F.coalesce(c, F.lit(False)), letter).otherwise("-")
    shown = F.coalesce(F.lpad(size.cast("string"), F.greatest(F.lit(11), F.length(size.cast("string"))), F.lit(" ")), F.lit(" ----------"))
    number = index.cast("string")
    return F.concat(F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit(" ")), F.lit(". "), mark(is_dir, "D"), mark(is_resource, "R"), mark(is_link, "L"), mark(encrypted, "E"), F.lit("- "), shown, F.lit(" "), N.compression_text(size, packed), F.lit("  "), F.rpad(F.coalesce(code, F.lit("----")), 4, " "), F.lit("  "), date, F.lit("  "), name, F.when(F.coalesce(is_dir, F.lit(False)), "/").otherwise(""))


def volume_order(name: Column, first: str) -> list[Column]:
    """Sort keys of volumes: the one with the first extension leads, the others follow case-insensitively."""
    return [F.when(F.lower(name).endswith(first), 0).otherwise(1).asc(), F.lower(name).asc(), name.asc()]


def volume_offsets(df: DataFrame, by: list[str], order: str, size: str) -> DataFrame:
    """Where each volume begins in the concatenation of its group's volumes."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
